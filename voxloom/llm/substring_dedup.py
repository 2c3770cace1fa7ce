"""Removal of passages that repeat across documents, by Rabin-Karp windows.

Every window of WINDOW consecutive words of every document gets a Rabin-Karp
hash (a polynomial over the words' 64-bit hashes, rolled by prefix sums).  A
word goes if a window that covers it also starts in a document with a smaller
id.

Documents are range-partitioned by id into blocks, so "an earlier document" is
one of an earlier block or an earlier one of the same block:

1. each block sends its distinct window hashes, sorted, to hash buckets (one
   packed row per block and bucket, so a window that a third of all documents
   share is sent once per block, not once per document);
2. a bucket counts in which blocks each hash occurs and answers every block
   but the first with the hashes it repeats;
3. each block takes its documents and its answers, finds the repeats among its
   own documents, and merges the repeated windows into maximal intervals.

A block holds about ``BLOCK_WINDOWS`` windows.  Beyond about 10^10 windows
blocks and buckets grow with the square root of their number, so that a packed row
keeps ``PIECE`` hashes: 5 * 10^7 windows (0.4 GB of hashes) at 10^13.

Defined results: a null text has no words; words are maximal runs of
characters other than ASCII white space, unchanged; documents shorter than a
window keep all words; rows that repeat an id are documents of their own,
neither of which is the earlier one; rows without an id keep all words and
remove none; an empty table gives an empty result.  All rows of one id lie in one
block.  Windows are compared by 64-bit hashes: a window that no earlier document
has is taken for a repeat with a probability of about windows / 2^64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C
from voxloom.llm.shingles import BASE, CHUNK, INVERSE, long_word_hashes, mix, powers, word_hashes

WINDOW = 50
#: windows of a block, and hashes of a bucket, about
BLOCK_WINDOWS = 2_000_000
#: hashes in a packed row, at least, about
PIECE = 256
#: bytes of text per window, about (it sets the number of blocks only)
BYTES_PER_WINDOW = 6

RESULT = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text binary"

def rolled(w: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every window of the word hashes ``w``: the sum of
    w[i + k] / base^k, from prefix sums, mixed."""
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers(INVERSE, len(w)))])
    return mix((sums[window:] - sums[:-window]) * powers(BASE, n))


def window_hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's index, word position) of every window, text by text."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    block: list[bytes] = []
    first = size = 0

    def flush() -> None:
        offsets = np.cumsum([0] + [len(t) + 1 for t in block])
        w, starts = word_hashes(b" ".join(block), lower=False)
        cut = np.searchsorted(starts, offsets)
        h = rolled(w, window)
        doc = np.repeat(np.arange(len(block)), np.diff(cut))
        at = np.arange(len(h))
        inside = at + window <= cut[doc[:len(h)] + 1]
        at, doc = at[inside], doc[:len(h)][inside]
        found.append((h[inside], first + doc, at - cut[doc]))

    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            if block:
                flush()
            h = rolled(long_word_hashes(text, lower=False), window)
            found.append((h, np.full(len(h), i), np.arange(len(h))))
            block, first, size = [], i + 1, 0
            continue
        block.append(text)
        size += len(text)
        if size > CHUNK:
            flush()
            block, first, size = [], i + 1, 0
    if block:
        flush()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, d, p = (np.concatenate(x) for x in zip(*found))
    return h, d, p


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart (so their zeros compress)."""
    d = np.diff(hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def sent_hashes(blocks: DataFrame, buckets: int, window: int) -> DataFrame:
    """(bucket, block, hashes): the distinct window hashes of each block, dealt
    to buckets by their leading bits."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def rows(block: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.unique(np.concatenate(parts))
        cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        some = np.flatnonzero(np.diff(cut)).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int32()),
             pa.array([packed(h[cut[b]:cut[b + 1]]) for b in some], pa.binary())], ["bucket", "block", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], 0
        for batch in batches:
            block = batch.column(0).to_numpy()
            for lo, hi in runs(block):
                if block[lo] != now or held > 4 * BLOCK_WINDOWS:
                    if held:
                        yield rows(now, parts)
                    now, parts, held = int(block[lo]), [], 0
                h = window_hashes([t or b"" for t in batch.column(1).slice(lo, hi - lo).to_pylist()], window)[0]
                if len(h):
                    parts.append(h)
                    held += len(h)
        if held:
            yield rows(now, parts)

    return blocks.select("block", "text").mapInArrow(run, "bucket int, block int, hashes binary")


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each run of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def earlier_hashes(sent: DataFrame) -> DataFrame:
    """(block, hashes): the hashes of a block that an earlier block has too."""

    def answers(block: list[int], data: list[bytes]) -> pa.RecordBatch:
        parts = [unpacked(x) for x in data]
        h = np.concatenate(parts)
        of = np.repeat(np.array(block, np.int32), [len(x) for x in parts])
        o = np.lexsort((of, h))
        h, of = h[o], of[o]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        again = of != of[first]
        h, of = h[again], of[again]
        o = np.argsort(of, kind="stable")
        h, of = h[o], of[o]
        cut = runs(of)
        return pa.RecordBatch.from_arrays([pa.array([int(of[lo]) for lo, _ in cut], pa.int32()),
                                           pa.array([packed(h[lo:hi]) for lo, hi in cut], pa.binary())], ["block", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, data = None, [], []
        for batch in batches:
            for b, k, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if b != now:
                    if data:
                        yield answers(block, data)
                    now, block, data = b, [], []
                block.append(k)
                data.append(x)
        if data:
            yield answers(block, data)

    d = sent.repartition("bucket").sortWithinPartitions("bucket", "block")
    return d.select("bucket", "block", "hashes").mapInArrow(run, "block int, hashes binary")


def repeated(ids: np.ndarray, texts: list[bytes], earlier: np.ndarray, window: int) -> list[np.ndarray]:
    """Per text (sorted by id) the maximal intervals of words to remove, as rows
    of start and end.  ``earlier``: sorted hashes that earlier blocks have."""
    h, doc, at = window_hashes(texts, window)
    gone = np.zeros(len(h), bool)
    if len(earlier) and len(h):
        gone = earlier[np.minimum(np.searchsorted(earlier, h), len(earlier) - 1)] == h
    if len(h):
        o = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[o][1:] != h[o][:-1]])
        first = o[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        gone[o] |= ids[doc[o]] > ids[doc[first]]
    doc, at = doc[gone], at[gone]
    # a window joins the interval before it where they overlap or touch
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
    start = np.flatnonzero(opens)
    last = np.concatenate([start[1:], [len(doc)]]) - 1 if len(start) else start
    spans = np.stack([at[start], at[last] + window], axis=1) if len(start) else np.zeros((0, 2), np.int64)
    cut = np.searchsorted(doc[start], np.arange(len(texts) + 1))
    return [spans[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _without(words: list[bytes], spans: np.ndarray) -> bytes:
    kept, at = [], 0
    for lo, hi in spans.tolist():
        kept += words[at:lo]
        at = hi
    return b" ".join(kept + words[at:])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, removed (maximal intervals of word
    positions, end exclusive) and kept_text (the other words, joined by one space)."""
    spark = docs.sparkSession
    C.ready(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = max(1, size // BYTES_PER_WINDOW)
    each = max(BLOCK_WINDOWS, math.isqrt(PIECE * windows))
    n = -(-windows // each)
    buckets = max(n, min(int(spark.conf.get("spark.sql.shuffle.partitions")), each // PIECE))
    named = rows.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    blocks = C.materialize(named.repartitionByRange(n, "doc_id").withColumn("block", F.spark_partition_id()), "blocks")
    earlier = C.materialize(earlier_hashes(sent_hashes(blocks, buckets, window)), "earlier")

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids = texts.column("doc_id").to_numpy()
        o = np.argsort(ids, kind="stable")
        data = texts.column("text").to_pylist()
        data = [data[i] or b"" for i in o]
        known = [unpacked(x) for x in answers.column("hashes").to_pylist()]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        spans = repeated(ids[o], data, known, window)
        # bytes.split() cuts at the same ASCII white space
        words = [t.split() for t in data]
        removed = [[{"start": a, "end": b} for a, b in s.tolist()] for s in spans]
        return pa.table([pa.array(ids[o], pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                         pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         pa.array([_without(w, s) for w, s in zip(words, spans)], pa.binary())],
                        names=["doc_id", "n_words", "removed", "kept_text"])

    out = blocks.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(run, RESULT)
    out = out.withColumn("kept_text", F.col("kept_text").cast("string"))
    w = C.words(F.col("text"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    alone = rows.where("doc_id is null").select("doc_id", F.size(w).cast("long").alias("n_words"), none.alias("removed"),
                                                F.array_join(w, " ").alias("kept_text"))
    return out.unionByName(alone)
