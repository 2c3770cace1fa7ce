"""Hard negatives by segment summary filtering.

Vectors become integers, floor(256 * x).  Each is cut into segments of
consecutive components; the table stores, per segment, the sum and the sum of
squares, hence its mean and deviation.  For two segments of length L

    L * (mean * mean' - dev * dev') <= inner product <= L * (mean * mean' + dev * dev')

and a coarser segment's summary is the sum of its two halves.  An anchor meets
the rows in blocks: bounds over ``LEVELS`` segments, coarse to fine, drop the rows
that cannot enter a list (its score range, and its k-th best lower bound so
far); each finer level is computed for what is left only, and what is left
after the last is scored exactly.  Dropping is by strict bounds, so the result
equals that of scoring everything.

Anchors are dealt to anchor blocks and rows to row blocks; every pair of blocks
is a group of its own with at most about ``ANCHORS`` x ``BLOCK_ROWS`` vectors,
whatever the table's size.  Each returns its best few per anchor, and a window
over those few gives the final lists.

Defined results: rows whose id, label or vector is null, or whose vector holds
a null or non-finite component, take no part; nor do those with a component so
large that scores would not fit 64 bits (|floor(256 x)| > sqrt(2^56 / dimensions)).
Shorter vectors count as padded with zeros.  Rows that repeat id, label and
vector count once; rows that share an id only are rows of their own, and their
equal scores are ordered by a hash of the row.  No positives or no row in range: no
rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm import common as C

#: numbers of segments, each twice the one before; the last is stored
LEVELS = (4, 8, 16)
BLOCK_ROWS = 4096
ANCHORS = 1024
#: anchors handled at once in a group
SLICE = 64
#: share of pairs from which a level is computed for all of them
DENSE = 0.1


# -- vectors and summaries -----------------------------------------------------

def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector, dims) of the usable rows; vector: 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, data, dims = [], [], []
            for i, v in enumerate(b.column(2)):
                if not v.is_valid:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
                limit = math.isqrt((1 << 56) // max(1, len(x)))
                if len(x) and not (np.isfinite(x).all() and (np.abs(x) <= limit / 256.0).all()):
                    continue
                q = np.floor(256.0 * x).astype(np.int64)
                keep.append(i)
                data.append(q.tobytes())
                dims.append(len(q))
            some = b.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(data, pa.binary()), pa.array(dims, pa.int32())],
                                             ["vec_id", "label", "vector", "dims"])

    return rows.mapInArrow(run, "vec_id long, label long, vector binary, dims int")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        x = np.frombuffer(v.as_py(), np.int64)
        out[i, :len(x)] = x
    return out


def summarized(rows: DataFrame, dims: int) -> DataFrame:
    """Adds ``summary``: sums and sums of squares of the finest segments."""
    width = padded(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("vector"), width).reshape(b.num_rows, LEVELS[-1], -1).astype(np.float64)
            s = np.concatenate([q.sum(axis=2), (q * q).sum(axis=2)], axis=1)
            yield b.append_column("summary", pa.array([x.tobytes() for x in s], pa.binary()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("summary", T.BinaryType())]))


def padded(dims: int) -> int:
    return max(1, -(-dims // LEVELS[-1])) * LEVELS[-1]


class Vectors:
    """The vectors of one side of a group and their summaries by level."""

    def __init__(self, t: pa.Table, width: int):
        self.exact = matrix(t.column("vector"), width)
        stored = np.array([np.frombuffer(x.as_py(), np.float64) for x in t.column("summary")]).reshape(t.num_rows, -1)
        s, sq = stored[:, :LEVELS[-1]], stored[:, LEVELS[-1]:]
        self.levels = {}
        for n in LEVELS[::-1]:
            of = width // n
            dev = np.sqrt(np.maximum(sq - s * s / of, 0))
            self.levels[n] = (s / math.sqrt(of), dev)  # L * mean * mean' is the product of these
            s, sq = (x.reshape(len(x), n // 2, 2).sum(axis=2) for x in (s, sq))
        # products of doubles are exact below 2^53
        self.small = np.abs(self.exact).max(initial=0) ** 2 * width < 1 << 53

    def part(self, pick: slice) -> "Vectors":
        out = object.__new__(Vectors)
        out.exact, out.small = self.exact[pick], self.small
        out.levels = {n: (m[pick], d[pick]) for n, (m, d) in self.levels.items()}
        return out


def products(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """a[i] . b[j] for the pairs, through one matrix product where there are many."""
    i, j = pairs
    if len(i) > DENSE * len(a) * len(b):
        return (a @ b.T)[i, j]
    out = np.empty(len(i), np.result_type(a, b))
    for lo in range(0, len(i), 1 << 17):
        hi = lo + (1 << 17)
        out[lo:hi] = np.einsum("ij,ij->i", a[i[lo:hi]], b[j[lo:hi]])
    return out


def best(anchors: Vectors, rows: Vectors, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Per anchor and range p, the k allowed rows with the largest score in
    [low[:, p], high[:, p]], ties to the earlier row: arrays of anchor, p, row, score."""
    below, above = np.full(allowed.shape, -np.inf), np.full(allowed.shape, np.inf)
    ranges = range(low.shape[1])
    alive = {p: allowed for p in ranges}

    def screen() -> np.ndarray:
        left = np.zeros(allowed.shape, bool)
        for p in ranges:
            lo, hi = low[:, p:p + 1], high[:, p:p + 1]
            a = alive[p] & (above >= lo) & (below <= hi)
            if allowed.shape[1] > k:
                sure = np.where(a & (below >= lo) & (above <= hi), below, -np.inf)
                a &= above >= np.partition(sure, -k, axis=1)[:, -k:][:, :1]
            alive[p] = a
            left |= a
        return left

    left = allowed
    for n in LEVELS:
        (am, ad), (rm, rd) = anchors.levels[n], rows.levels[n]
        pairs = np.nonzero(left)
        if not len(pairs[0]):
            break
        mid, dev = products(am, rm, pairs), products(ad, rd, pairs)
        slack = 1e-9 * (np.abs(mid) + dev) + 1e-6  # rounding
        below[pairs] = np.maximum(below[pairs], mid - dev - slack)
        above[pairs] = np.minimum(above[pairs], mid + dev + slack)
        left = screen()
    pairs = np.nonzero(left)
    if anchors.small and rows.small:
        score = products(anchors.exact.astype(np.float64), rows.exact.astype(np.float64), pairs).astype(np.int64)
    else:
        score = products(anchors.exact, rows.exact, pairs)
    found = []
    for p in ranges:
        i, j = pairs
        in_p = alive[p][i, j] & (score >= low[i, p]) & (score <= high[i, p])
        i, j, s = i[in_p], j[in_p], score[in_p]
        o = np.lexsort((j, -s, i))
        i, j, s = i[o], j[o], s[o]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], i[1:] != i[:-1]]), np.arange(len(i)), 0)) if len(i) else i
        top = np.arange(len(i)) - first < k
        found.append((i[top], np.full(int(top.sum()), p), j[top], s[top]))
    return tuple(np.concatenate(x) for x in zip(*found))


# -- blocks --------------------------------------------------------------------

def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run, schema: str) -> DataFrame:
    """``run`` on every pair of an anchor block (``ab``) and a row block (``rb``)."""
    left = rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    right = anchors.drop("rb").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(run, schema)


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("vec_id", "ascending"), ("key", "ascending")])


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), "key"), F.lit(n)).cast("int")


def _slices(n: int) -> list[slice]:
    return [slice(i, min(n, i + SLICE)) for i in range(0, n, SLICE)]


POSITIVE = "anchor_key long, key long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, anchor_key long, p int, positive_id long, positive_score long, key long, negative_id long, negative_score long"


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row that ``anchor`` (a condition on vec_id and label) picks, and each of its first
    ``positives`` other rows of its label by score: the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    C.ready(spark)
    used = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("vec_id is not null and label is not null")
    keyed = integers(used).withColumn("key", F.xxhash64("vec_id", "label", "vector")).dropDuplicates(["vec_id", "label", "vector"])
    keyed = C.materialize(keyed, "integers")
    n, dims = keyed.agg(F.count(F.lit(1)), F.max("dims")).first()
    width = padded(dims or 0)
    n_rb = max(1, -(-n // BLOCK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256))
    all_rows = C.materialize(summarized(keyed.drop("dims"), dims or 0).withColumn("rb", _block("row", n_rb)), "vectors")
    asked = all_rows.where(anchor)
    n_ab = max(1, -(-asked.count() // ANCHORS))
    asked = asked.withColumn("ab", _block("anchor", n_ab))

    def near(r: pa.Table, a: pa.Table) -> pa.Table:
        r, a = _ordered(r), _ordered(a)
        found = []
        if r.num_rows and a.num_rows:
            rv, av = Vectors(r, width), Vectors(a, width)
            rl, al, rk, ak = (t.column(c).to_numpy() for c in ("label", "key") for t in (r, a))
            for part in _slices(a.num_rows):
                some = av.part(part)
                allowed = (al[part][:, None] == rl[None, :]) & (ak[part][:, None] != rk[None, :])
                wide = np.full((len(allowed), 1), np.inf)
                i, _, j, s = best(some, rv, allowed, -wide, wide, positives)
                found.append((ak[part][i], rk[j], r.column("vec_id").to_numpy()[j], s))
        return _table(found, POSITIVE)

    def hard(r: pa.Table, a: pa.Table) -> pa.Table:
        r, a = _ordered(r), _ordered(a)
        found = []
        if r.num_rows and a.num_rows:
            rv, av = Vectors(r, width), Vectors(a, width)
            rl, al, rk, ak, ri, ai = (t.column(c).to_numpy() for c in ("label", "key", "vec_id") for t in (r, a))
            listed = a.column("near").to_pylist()
            score = np.full((len(listed), positives), np.nan)
            ids = np.zeros((len(listed), positives), np.int64)
            exact = np.zeros((len(listed), positives), np.int64)
            for x, row in enumerate(listed):
                for p, y in enumerate(row):
                    score[x, p] = exact[x, p] = y["positive_score"]
                    ids[x, p] = y["positive_id"]
            # integer range of the score; none where there is no such positive
            lo = np.where(np.isnan(score), np.inf, -((-low * exact) // 100))
            hi = np.where(np.isnan(score), -np.inf, (high * exact) // 100)
            for part in _slices(a.num_rows):
                i, p, j, s = best(av.part(part), rv, al[part][:, None] != rl[None, :], lo[part], hi[part], negatives)
                i = i + part.start
                found.append((ai[i], ak[i], p, ids[i, p], exact[i, p], rk[j], ri[j], s))
        return _table(found, NEGATIVE)

    top = Window.partitionBy("anchor_key").orderBy(F.desc("positive_score"), "positive_id", "key")
    close = _met(all_rows, asked, n_rb, n_ab, near, POSITIVE).withColumn("p", F.row_number().over(top)).where(F.col("p") <= positives)
    per = close.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("p", "positive_id", "positive_score"))).alias("near"))
    listed = C.materialize(asked.join(per, asked["key"] == per["anchor_key"]).drop("anchor_key"), "positives")
    first = Window.partitionBy("anchor_key", "p").orderBy(F.desc("negative_score"), "negative_id", "key")
    out = _met(all_rows, listed, n_rb, n_ab, hard, NEGATIVE).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(found: list[tuple[np.ndarray, ...]], schema: str) -> pa.Table:
    cols = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    data = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * len(cols)
    return pa.table([pa.array(x.astype(np.int64)).cast(kinds[t]) for x, (_, t) in zip(data, cols)], names=[c for c, _ in cols])
