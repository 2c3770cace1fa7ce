"""Codec-frame operators in long form.

The array form lives in ``voxloom.functions.arrays``; these are the same frame
dedupe with one row per kept code:

* ``dedupe_frames_long`` dedupes each code array and explodes what is left: the
  whole utterance lies in one row, so neither a join nor a ranking is needed;
* ``dedupe_frame_rows`` works on a table that already holds one row per frame:
  rows are brought together by ``(key, chunk of frames)``, where frame i meets
  frame i+1, and the chunks' sizes give the kept positions, so no step puts a
  whole utterance into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.arrays import dedupe_frames, let
from voxloom.session import ship_package, written


def frames_long(df: DataFrame, key: str, codes_col: str, with_next: bool = False) -> DataFrame:
    """One row per frame: ``key, frame, slots[, next0]`` (the last frame may be
    partial; ``next0`` is slot 0 of the following frame, NULL for the last)."""
    def body(v):
        n_frames = F.ceil(F.size(v) / 7).cast("int")
        if with_next:
            item = lambda f: F.struct(F.slice(v, f * 7 + 1, 7).alias("slots"), F.get(v, f * 7 + 7).alias("next0"))
        else:
            item = lambda f: F.struct(F.slice(v, f * 7 + 1, 7).alias("slots"))
        return F.when(n_frames > 0, F.transform(F.sequence(F.lit(0), n_frames - 1), item))

    out = df.select(key, F.posexplode(let(codes_col, body)).alias("frame", "_f"))
    return out.select(key, "frame", "_f.*")


def dedupe_frames_long(df: DataFrame, key: str, codes_col: str) -> DataFrame:
    """W1 + Q3 from code arrays: drop frame i when slot 0 equals slot 0 of frame
    i+1.  Output one row per kept code ``key, pos, code`` with ``pos`` its
    position after the dedupe."""
    return df.select(key, F.posexplode(dedupe_frames(codes_col)).alias("pos", "code"))


#: frames of a chunk
CHUNK_FRAMES = 4096
#: codes handed on at once, about
BATCH_CODES = 1_000_000


def _changed(col: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it."""
    i = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return i[1:] != i[:-1]


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _copies(frame: np.ndarray, slot0: pa.Array) -> np.ndarray:
    """How often each row of a chunk stays: once unless the next frame starts alike; where rows
    repeat a frame, once for each row of the next frame that does not."""
    if (frame[1:] > frame[:-1]).all():
        alike = pc.equal(slot0[:-1], slot0[1:]).fill_null(False).to_numpy(zero_copy_only=False)
        return 1 - np.append(alike & (frame[1:] == frame[:-1] + 1), False).astype(np.int64)
    starts = slot0.to_pylist()
    following: dict[int, list] = {}
    for f, x in zip(frame.tolist(), starts):
        following.setdefault(f - 1, []).append(x)
    return np.array([sum(y is None or x is None or x != y for y in following[f]) if f in following else 1
                     for f, x in zip(frame.tolist(), starts)], np.int64)


def _kept_codes(parts: list[tuple], compare: bool) -> pa.Array:
    """The codes that stay of a chunk.  ``parts``: frames, sizes, codes of runs of rows, and whether
    they are the next chunk's first frame, which is only looked at."""
    parts = sorted(parts, key=lambda x: (x[3], x[0][0]))
    frame, size = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    codes = pa.concat_arrays([x[2] for x in parts])
    own = ~np.repeat([x[3] for x in parts], [len(x[0]) for x in parts])
    start = np.cumsum(size, dtype=np.int64) - size
    order = np.argsort(frame, kind="stable")
    frame, size, start, own = frame[order], size[order], start[order], own[order]
    copies = own.astype(np.int64)
    if compare:
        copies *= _copies(frame, codes.take(pa.array(start, pa.int64(), mask=size == 0)))
    start, size = np.repeat(start, copies), np.repeat(size, copies)
    return codes.take(pa.array(np.arange(size.sum()) + np.repeat(start - (np.cumsum(size, dtype=np.int64) - size), size)))


def dedupe_frame_rows(frames: DataFrame, key: str = "key") -> DataFrame:
    """W1 + Q3 on a table of frame rows ``(key, frame, slots)``: each row meets the
    rows of the next frame of its key.

    Rows of the same chunk of CHUNK_FRAMES frames that lie next to each other become one row
    before they are shuffled, once, by (key, chunk); a chunk's first frame is also sent to the chunk before
    it.  The codes kept are written per chunk, and the chunks' sizes give the positions."""
    ship_package(frames.sparkSession)
    codes_type = frames.schema["slots"].dataType
    fields = [T.StructField("_key", frames.schema[key].dataType), T.StructField("_chunk", T.LongType())]
    longs = T.ArrayType(T.LongType())
    run_type = T.StructType([*fields, T.StructField("frame", longs), T.StructField("size", T.ArrayType(T.IntegerType())),
                             T.StructField("codes", codes_type), T.StructField("ahead", T.BooleanType())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, chunk, frame, slots = b.columns
            n = b.num_rows
            if not n:
                continue
            at = np.flatnonzero(np.concatenate([[True], _changed(k) | _changed(chunk)]))
            size = slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes, ends = slots.flatten(), np.concatenate([[0], np.cumsum(size)])
            rows = np.diff(np.append(at, n))
            yield pa.RecordBatch.from_arrays([k.take(pa.array(at)), chunk.take(pa.array(at)), _lists(rows, frame.fill_null(0)), _lists(rows, pa.array(size, pa.int32())),
                                              _lists(np.diff(ends[np.append(at, n)]), codes), pa.array(np.zeros(len(at), bool))], run_type.names)
            f = frame.fill_null(1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(f % CHUNK_FRAMES == 0)
            if len(first):
                one, each = np.minimum(size[first], 1), np.ones(len(first), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [k.take(pa.array(first)), pa.array(f[first] // CHUNK_FRAMES - 1), _lists(each, pa.array(f[first])), _lists(each, pa.array(one, pa.int32())),
                     _lists(one, codes.take(pa.array(ends[first][one > 0]))), pa.array(each.astype(bool))], run_type.names)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple = ()
        parts: list[tuple] = []
        out: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal held
            if not all(p[3] for p in parts):
                codes = _kept_codes(parts, None not in group)
                out.append((*group, codes))
                held += len(codes)

        def batch() -> pa.RecordBatch:
            rb = pa.RecordBatch.from_arrays([pa.array([k for k, *_ in out], key_type), pa.array([c for _, c, _ in out], pa.int64()),
                                             _lists(np.array([len(x) for *_, x in out]), pa.concat_arrays([x for *_, x in out]))], ["_key", "_chunk", "codes"])
            out.clear()
            return rb

        for b in batches:
            key_type = b.schema.field(0).type
            ends = [np.concatenate([[0], np.cumsum(b.column(i).value_lengths().to_numpy())]).tolist() for i in (2, 4)]
            frame, size = (b.column(i).flatten().to_numpy() for i in (2, 3))
            codes, ahead = b.column(4).flatten(), b.column(5).to_pylist()
            for i, g in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if g != group:
                    close()
                    group, parts = g, []
                    if held >= BATCH_CODES:
                        yield batch()
                        held = 0
                lo, hi = ends[0][i], ends[0][i + 1]
                parts.append((frame[lo:hi], size[lo:hi], codes.slice(ends[1][i], ends[1][i + 1] - ends[1][i]), ahead[i]))
        close()
        if out:
            yield batch()

    chunk = F.floor(F.col("frame") / CHUNK_FRAMES).cast("long")
    rows = frames.select(F.col(key).alias("_key"), chunk.alias("_chunk"), F.col("frame").cast("long").alias("frame"), "slots").mapInArrow(runs, run_type)
    rows = rows.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk")
    left = written(rows.mapInArrow(kept, T.StructType([*fields, T.StructField("codes", codes_type)])), "kept-frames")
    # a struct is never NULL, so NULL keys meet in the join too
    left = left.withColumn("_g", F.struct("_key", "_chunk"))
    earlier = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = left.select("_g", "_key", "_chunk", F.size("codes").cast("long").alias("n")).withColumn("_off", F.sum("n").over(earlier))
    placed = left.join(offsets.where("_off > 0").select("_g", "_off"), "_g", "left")
    return placed.select(F.col("_key").alias(key), F.posexplode("codes").alias("_j", "code"), F.coalesce("_off", F.lit(0).cast("long")).alias("_off")).select(
        key, (F.col("_off") + F.col("_j")).alias("pos"), "code")
