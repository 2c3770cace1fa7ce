"""The three data paths of the corpus build, composed from the operators.

Every function takes and returns DataFrames; nothing is collected.  Models
(codec, speaker encoder, tokenizer) are not part of the library: their outputs
arrive as columns, or a caller runs them with ``operators.inference.map_model``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.functions import arrays as A
from voxloom.functions import text as TX
from voxloom.operators import align, ingest, packing, sampling
from voxloom.operators import segments as SEG
from voxloom.operators.inference import RetryPolicy, call_with_retry
from voxloom.session import written


# --- curated path: URL lists -> main-speaker audio -> speaker rows -----------
def download_jobs(urls: DataFrame, done: DataFrame | None, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """S6 -> P1 -> P2 -> S10: ``(video_id, out_path)`` still to fetch, and the
    URLs without a video id (quarantine)."""
    x = urls.select("url", TX.video_id("url").alias("video_id"))
    good = x.filter(F.col("video_id").isNotNull()).select("video_id", TX.output_path(out_dir, "video_id").alias("out_path"))
    if done is not None:
        good = ingest.skip_done(good, done.select(F.col(done.columns[0]).alias("video_id")), "video_id")
    return good.dropDuplicates(["video_id"]), x.filter(F.col("video_id").isNull()).select("url")


def main_speaker_audio(segments: DataFrame, samples: DataFrame, sr: int, bin_width: int = 4096) -> DataFrame:
    """A1 -> A2 -> J3 -> R4/J2: samples of each file's main speaker, long form
    ``(file, start, t, value)``; ordering by ``(start, t)`` gives the joined audio (R3)."""
    mine = SEG.main_speaker_segments(segments)
    return SEG.slice_waveform(samples, mine.select("file", "start", "end"), "file", "t", sr=sr, bin_width=bin_width)


WORDS_TYPE = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))


def transcripts(audio: DataFrame, clients, transcribe, key: str = "stem", path_col: str = "path",
                policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """M3 -> P8: call a caller-supplied transcription client per file (failed files
    again with the next of ``clients()``), keep ``type == 'word'`` entries and
    join them with one space.  A file whose calls all fail gets an empty
    transcript (later dropped by P5) and keeps its error text.
    ``transcribe(client, path)`` returns a list of ``{'type', 'text'}`` dicts."""
    words = call_with_retry(audio.select(key, path_col), path_col, clients, transcribe, "words", WORDS_TYPE, policy)
    return words.select(key, F.coalesce(TX.transcript_from_words("words"), F.lit("")).alias("text"), "status", "error")


def speaker_rows(transcripts: DataFrame, codes: DataFrame, embeddings: DataFrame, key: str = "stem",
                 placeholder: int = V.IGNORE_LABEL) -> DataFrame:
    """J1 -> P5 -> Q15 -> Q3 -> Q5: ``(stem, input_ids, speaker_embedding)``.

    ``transcripts(stem, text)``, ``codes(stem, codes_list)`` (flat, offset codes)
    and ``embeddings(stem, speaker_embedding)``; the small path uses -100 as the
    placeholder."""
    t = transcripts.select(key, TX.py_strip("text").alias("text")).filter(F.length("text") > 0)
    rows = t.join(codes, key).join(embeddings, key)
    ids = A.assemble_speaker(A.byte_tokens("text"), A.dedupe_frames("codes_list"), placeholder)
    return rows.select(key, ids.alias("input_ids"), "speaker_embedding")


# --- bulk path: corpus rows -> packed training sequences ---------------------
def bulk_speaker_rows(rows: DataFrame, key: str, text_ids: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """S1 -> Q15 -> Q3 -> Q5 -> P11 (+ P7): speaker rows with the placeholder
    check and an ``error`` for rows whose encode failed (NULL codes or
    embedding, D7), so they can be split off with ``ingest.write_with_quarantine``
    instead of ending the job.  ``rows`` has ``key, text, codes_list,
    speaker_embedding`` (or ready ``text_ids``); columns of ``keep`` stay."""
    tid = F.col(text_ids) if text_ids else A.byte_tokens("text")
    error = (F.when(F.col("codes_list").isNull(), F.lit("no audio codes"))
             .when(F.col("speaker_embedding").isNull(), F.lit("no speaker embedding")))
    out = rows.select(key, A.assemble_speaker(tid, A.dedupe_frames("codes_list")).alias("input_ids"),
                      "speaker_embedding", error.alias("error"), *(keep or []))
    return out.withColumn("placeholder_ok", F.coalesce(A.count_value("input_ids", V.PLACEHOLDER) == 1, F.lit(False)))


def pack_corpus(rows: DataFrame, key: str, outer: int = V.OUTER_SHARDS, inner: int = V.INNER_SHARDS,
                limit: int = V.PACK_LIMIT, seed: int = V.SHUFFLE_SEED, mode: str = "contiguous",
                drop_tail: bool = False, dim: int | None = None, chunk_rows: int = packing.CHUNK_ROWS,
                build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """O1 -> K4 -> K1 -> K2/K3: seeded shuffle, two-level shards, next-fit packing
    of each shard.  Output has ``outer_shard`` for the per-shard sink (K5).

    Rows that cannot be packed safely (``packing.packable``, with vectors of width
    ``dim`` if given) are left out; write them to quarantine from ``rows`` first
    (``ingest.write_with_quarantine``; ``unpackable_rows`` names and counts them).
    Rows are written to the checkpoint folder with the number of their ids; the count and the
    bins' lengths then read narrow columns of that table.  With ``build`` the ids come late:
    ``rows`` are what it adds ``input_ids`` to (row by row, keeping the other columns), such as texts,
    they are shuffled as they come, and built where they are packed (``packing.pack_rows``).  ``inner`` sets the
    bins' boundaries and is therefore never derived here; the parallelism of the
    packer does not depend on it (``chunk_rows``)."""
    kept = rows.columns if build else [c for c in rows.columns if c in (key, "input_ids", "speaker_embedding")]
    rows = (build(rows) if build else rows).select(*(F.col(f"`{c}`") for c in kept), packing.packable(dim=dim).alias("_fit"), F.size("input_ids").alias("_n"))
    rows = written(rows, "corpus").where("_fit").drop("_fit")
    n = rows.count()
    ranked = sampling.seeded_shuffle(rows, key, seed, n_rows=n)
    s = sampling.two_level_shards(ranked, "idx", n, outer, inner, mode)
    s = s.withColumn("shard", (F.col("outer_shard") * inner + F.col("inner_shard")).cast("long"))
    s = written(s.select(*(F.col(f"`{c}`") for c in kept), "shard", "inner_idx", "_n"), "sharded")
    packed = packing.pack_rows(s, "shard", "inner_idx", "input_ids", "speaker_embedding", limit=limit,
                               drop_tail=drop_tail, chunk_rows=chunk_rows, len_col="_n", build=build)
    return packed.withColumn("outer_shard", F.floor(F.col("shard") / inner).cast("int"))


def unpackable_rows(rows: DataFrame, key: str, dim: int | None = None,
                    vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows ``pack_corpus`` leaves out, with the reason: ``(key, reason)``.

    ``vectors`` may add ``speaker_embedding`` to rows of ``key``, keeping the other columns: the ids
    are then judged where they are built, and only the verdicts are joined with the vectors."""
    judged = rows.select(key, *([] if vectors else ["speaker_embedding"]), F.col("input_ids").isNull().alias("_no_ids"), packing.ids_fit().alias("_ids_fit"))
    judged = vectors(judged) if vectors else judged
    reason = (F.when(F.col("_no_ids"), F.lit("no ids")).when(F.col("speaker_embedding").isNull(), F.lit("no speaker embedding"))
              .otherwise(F.lit("ids and vector do not match")))
    return judged.where(~(F.col("_ids_fit") & packing.vector_fits(dim=dim))).select(key, reason.alias("reason"))


def model_inputs(packed: DataFrame, keys=("shard", "bin"), dim: int = V.SPEAKER_DIM,
                 max_len: int = V.MAX_LEN_PACKED) -> tuple[DataFrame, DataFrame]:
    """P12 -> P13 -> Q10 -> Q7 and J4/W2: per packed row the normalised ids,
    masked labels, mask, the P12 flag and per-token ``segment_ids`` (D13);
    and the placeholder slots
    ``(keys, k, pos, vector)`` that receive the projected embeddings (M4/M5)."""
    keys = list(keys)
    extra = ["row_lengths"] if "row_lengths" in packed.columns else []
    ids = packed.select(*keys, A.normalise_placeholder("input_ids").alias("ids"), "speaker_embeddings", *extra)
    seg = [A.truncate(A.segment_ids("row_lengths"), max_len).alias("segment_ids")] if extra else []
    rows = ids.select(*keys, A.truncate("ids", max_len).alias("input_ids"),
                      A.truncate(A.mask_labels("ids"), max_len).alias("labels"),
                      align.placeholders_match("ids", "speaker_embeddings", dim).alias("placeholders_ok"), *seg)
    rows = rows.withColumn("attention_mask", A.attention_mask("input_ids"))
    return rows, align.align_placeholders(packed, keys, dim=dim).where(F.col("pos") < max_len)


# --- training rows without speaker, and the sampling side --------------------
def plain_training_rows(rows: DataFrame, key: str, max_len: int = V.MAX_LEN_PLAIN, head_div: int | None = 5,
                        seed: int = V.SHUFFLE_SEED) -> DataFrame:
    """O2 -> O1 -> Q15 -> Q4 -> Q7 -> Q8 -> Q9 (``rows``: key, text, codes_list)."""
    if head_div:
        rows = sampling.head_fraction(rows, key, head_div, idx_col="_head").drop("_head")
    shuffled = sampling.seeded_shuffle(rows, key, seed)
    ids = shuffled.select(key, "idx", A.truncate(A.assemble_plain(A.byte_tokens("text"), "codes_list"), max_len)
                          .alias("input_ids"))
    return ids.select(key, "idx", "input_ids", A.attention_mask("input_ids").alias("attention_mask"),
                      F.col("input_ids").alias("labels"))


def decode_generated(generated: DataFrame, tokens_col: str = "output_tokens") -> DataFrame:
    """Q11 -> P9 -> Q2 -> P10 over model output rows: codec streams plus checks."""
    s = generated.withColumn("_span", A.audio_span(tokens_col))
    s = s.withColumn("_u", A.unflatten_frames("_span"))
    return s.select("*", A.frame_shape_ok("_span").alias("shape_ok"), (F.size("_span") == 0).alias("is_empty"),
                    A.codes_in_range("_u.c0", "_u.c1", "_u.c2").alias("codes_ok"),
                    F.col("_u.c0").alias("c0"), F.col("_u.c1").alias("c1"), F.col("_u.c2").alias("c2")).drop("_span", "_u")
