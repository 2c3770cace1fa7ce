"""Stand-in inputs derived from the driver tables (see FIXTURES.md §3).

Every stand-in is a Spark transformation of the given tables, so its size
grows with them:

* text tokens      ``[128000] + UTF-8 bytes`` of ``documents.text``
* codec frames     the same bytes in 7-slot frames, slot 0 ``div 32``
* codec streams    the full frames of those bytes split into c0 / c1 / c2
* speaker vectors  ``embeddings`` joined on ``vec_id = doc_id % #vectors``
* segments         ``conversations``: role = speaker, turn = order, length = time
* waveforms        ``events.value`` per user in ``(ts, event_id)`` order
* video URLs       built from ``pages.page_id`` in the accepted forms + one that fails
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.functions.arrays import assemble_speaker, dedupe_frames, let, utf8_bytes
from voxloom.operators.inference import byte_encode_batch
from voxloom.operators.sampling import rank_in_group
from voxloom.session import ship_package
from voxloom.sources.readers import read_table

SEGMENT_CHARS_PER_SECOND = 100.0
SEGMENT_OVERLAP_CHARS = 50
WAVE_SR = 16000          # rate given to event waveforms
SLICE_SR = 1000          # rate used for segment slicing (1 sample = 1 ms)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    parts = spark.sparkContext.defaultParallelism if spread else None
    return read_table(spark, f"{sf_dir}/{name}.parquet", min_partitions=parts)


def doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the UTF-8 byte array of the text."""
    d = table(spark, sf_dir, "documents", spread=True)
    return d.select("doc_id", "text", "lang", "source", utf8_bytes("text").alias("bytes"))


#: rows whose stand-in ids are built at once
STAND_IN_ROWS = 1000


def _frames(ids: pa.ListArray) -> pa.ListArray:
    """Codec frames of the bytes behind each row's first id: slot 0 ``div 32``,
    each slot offset into its own codebook (``functions.arrays.frames_from_bytes``)."""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    lens = np.maximum(sizes - 1, 0)
    values = ids.flatten().to_numpy(zero_copy_only=False)
    body = np.ones(len(values), bool)
    body[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    b, starts = values[body], np.cumsum(lens) - lens
    slot = ((np.arange(len(b)) - np.repeat(starts, lens)) % V.SLOTS_PER_FRAME).astype(np.int32)
    codes = np.where(slot == 0, b >> 5, b) + (slot * np.int32(V.CODEBOOK_SIZE) + np.int32(V.AUDIO_OFFSET))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(codes, pa.int32()), mask=ids.is_null())


def with_stand_ins(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text_ids`` and ``codes_list`` of their ``text``, in their order."""
    ship_package(rows.sparkSession)
    at, ints = rows.columns.index("text"), T.ArrayType(T.IntegerType())
    schema = T.StructType([*rows.schema.fields, T.StructField("text_ids", ints), T.StructField("codes_list", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STAND_IN_ROWS):
                b = batch.slice(lo, STAND_IN_ROWS)
                ids = byte_encode_batch(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns, ids, _frames(ids)], names)

    names = schema.names
    return rows.mapInArrow(run, schema)


def texts(spark: SparkSession, sf_dir: str, with_embedding: bool = True) -> DataFrame:
    """Documents before their ids are built: ``doc_id, text, lang[, speaker_embedding]``."""
    rows = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text", "lang")
    return with_vectors(spark, sf_dir, rows) if with_embedding else rows


def with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``doc_id``) with the ``speaker_embedding`` of their documents."""
    emb = table(spark, sf_dir, "embeddings")
    n_vec = emb.count()
    rows = rows.withColumn("vec_id", F.col("doc_id") % n_vec)
    return rows.join(emb.select("vec_id", F.col("embedding").alias("speaker_embedding")), "vec_id").drop("vec_id")


def bulk_rows(spark: SparkSession, sf_dir: str, with_embedding: bool = True) -> DataFrame:
    """Bulk-corpus rows ``doc_id, text, lang, text_ids, codes_list[, speaker_embedding]``."""
    rows = with_stand_ins(texts(spark, sf_dir, with_embedding))
    vector = ["speaker_embedding"] if with_embedding else []
    return rows.select("doc_id", "text", "lang", "text_ids", "codes_list", *vector)


def codec_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three codec streams (1, 2, 4 codes per frame) from the full 7-byte frames."""
    d = doc_bytes(spark, sf_dir)

    def streams(b):
        # picked frame by frame (n/7 lambda calls), not by filtering every byte
        nf = F.floor(F.size(b) / 7).cast("int")
        seq = F.sequence(F.lit(0), nf - 1)

        def per_frame(body):
            return F.when(nf == 0, F.array().cast("array<int>")).otherwise(body)

        return F.struct(
            per_frame(F.transform(seq, lambda f: F.get(b, 7 * f))).alias("c0"),
            per_frame(F.flatten(F.transform(seq, lambda f: F.array(F.get(b, 7 * f + 1), F.get(b, 7 * f + 4))))).alias("c1"),
            per_frame(F.flatten(F.transform(seq, lambda f: F.array(
                F.get(b, 7 * f + 2), F.get(b, 7 * f + 3), F.get(b, 7 * f + 5), F.get(b, 7 * f + 6))))).alias("c2"))

    return d.select("doc_id", let("bytes", streams).alias("s")).select("doc_id", "s.c0", "s.c1", "s.c2")


def with_speaker_ids(rows: DataFrame, alt_placeholder_lang: str | None = None) -> DataFrame:
    """``rows`` (with ``text`` and ``lang``) with the ``input_ids`` of their speaker rows (Q5 on
    deduped frames), in their order.  Rows of ``alt_placeholder_lang`` use the small path's -100
    placeholder."""
    ph = F.lit(V.PLACEHOLDER)
    if alt_placeholder_lang:
        ph = F.when(F.col("lang") == alt_placeholder_lang, F.lit(V.IGNORE_LABEL)).otherwise(ph)
    ids = assemble_speaker("text_ids", dedupe_frames("codes_list"), ph)
    return with_stand_ins(rows).select(*(F.col(f"`{c}`") for c in rows.columns), ids.alias("input_ids"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarisation-like segments from conversations: ``file, speaker, seg_order,
    start, end, text``; each segment overlaps the next by half a second."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # characters of the earlier turns of the conversation, without a window per conversation
    c = rank_in_group(c, "conv_id", ["turn"], "_off", weight=F.length("text"))
    return c.select(F.col("conv_id").alias("file"), F.col("role").alias("speaker"), F.col("turn").alias("seg_order"),
                   "text", "_off").select(
        "file", "speaker", "seg_order", "text",
        (F.col("_off") / SEGMENT_CHARS_PER_SECOND).alias("start"),
        ((F.col("_off") + F.length("text") + SEGMENT_OVERLAP_CHARS) / SEGMENT_CHARS_PER_SECOND).alias("end"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcribed words per conversation: turns as words, ``system`` turns typed
    as spacing."""
    c = table(spark, sf_dir, "conversations")
    w = F.struct(F.col("turn"), F.struct(
        F.when(F.col("role") == "system", F.lit("spacing")).otherwise(F.lit("word")).alias("type"),
        F.col("text").alias("text")).alias("w"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(w)).alias("_w")).select(
        "conv_id", F.transform("_w", lambda x: x["w"]).alias("words"))


def wave_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form waveform ``file, t, value`` from events per user.

    A decoded file carries its sample index; here it is numbered in
    ``(ts, event_id)`` order per user with ``rank_in_group``.
    """
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    # sample index per user without a window per user (a hot user is split by time)
    e = rank_in_group(e, "user_id", ["ts", "event_id"], "t", _epoch_micros(e, "ts"))
    return e.select(F.col("user_id").alias("file"), "t", "value", "event_type", "event_id")


def _epoch_micros(df: DataFrame, col: str):
    """Microseconds since the epoch, time-zone free for TIMESTAMP_NTZ columns."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_micros(col)


def video_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in every accepted form, keyed by page, plus the page URL itself (no
    video id, must fail)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    vid = F.concat(F.lit("v"), F.col("page_id").cast("string"))
    form = F.col("page_id") % 5
    url = (F.when(form == 0, F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=1")))
           .when(form == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), vid, F.lit("&feature=share")))
           .when(form == 2, F.concat(F.lit("https://youtube.com/shorts/"), vid))
           .when(form == 3, F.concat(F.lit("https://m.youtube.com/watch?app=desktop&v="), vid))
           .otherwise(F.col("url")))
    return p.select("page_id", url.alias("url"))
