"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector shared by all
grades and ordered thresholds.  x holds the square roots of the shares of
hashed byte 3- and 5-grams of the whole text, so its length is 1 whatever the
text's.  The expected grade is the sum of the tail probabilities; a document
is kept if the tail probability at ``min_grade`` is at least ``threshold``.

The model is fitted on at most ``MAX_LABELLED`` rated documents, chosen by a
hash of their id; every document is scored.

Defined results: a null or empty text (or one under three bytes) has no
features and is rejected with expected grade 0; ratings that are null or
belong to no document are ignored, of several for one document the lowest
holds; with fewer than two grades to learn from every non-empty text is kept;
repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C

BITS = 13
DIM = 1 << BITS
#: rated documents the model is fitted on, at most
MAX_LABELLED = 3000
CHUNK = 1 << 20

SCORES = "expected_grade double, tail double, kept boolean"


def hashed_shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of each hashed n-gram (zeros if none)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(data), CHUNK):
        b = np.frombuffer(data[at:at + CHUNK + 4], np.uint8).astype(np.uint32)
        inner = min(CHUNK, len(data) - at)  # n-grams that start in this chunk
        if len(b) >= 3:
            g = (b[:-2] | b[1:-1] << 8 | b[2:] << 16)[:inner]
            counts += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=DIM)
        if len(b) >= 5:
            g = (b[:-4] | b[1:-3] << 8 | b[2:-2] << 16 | b[3:-1] << 24)[:inner] ^ (b[4:] * np.uint32(2246822519))[:inner]
            counts += np.bincount((g * np.uint32(3266489917)) >> np.uint32(32 - BITS), minlength=DIM)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else np.zeros(DIM, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), .., P(grade >= K-1), one row per row of ``x``."""
        return _sigmoid((x @ self.weights)[:, None] - self.thresholds[None, :])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, steps: int = 200, ridge: float = 2e-5, rate: float = 0.4) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood.  Thresholds stay
    ordered: the first is free, the gaps are exponentials."""
    top = int(grade.max())
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(0.01, 0.99)
    theta0 = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta0), 0.1))
    par = np.concatenate([np.zeros(x.shape[1]), theta0[:1], gaps]).astype(np.float64)
    m, v = np.zeros_like(par), np.zeros_like(par)
    d = x.shape[1]
    rows = np.arange(len(grade))
    for t in range(1, steps + 1):
        w, th = par[:d], par[d] + np.concatenate([[0.0], np.cumsum(np.exp(par[d + 1:]))])
        s = x @ w.astype(np.float32)
        tail = np.concatenate([np.ones((len(s), 1)), _sigmoid(s[:, None] - th[None, :]), np.zeros((len(s), 1))], 1)
        upper, lower = tail[rows, grade], tail[rows, grade + 1]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        gs = -(du - dl) / p / len(s)
        gth = np.zeros(top)
        np.add.at(gth, grade[grade > 0] - 1, (du / p / len(s))[grade > 0])
        np.add.at(gth, grade[grade < top], (-dl / p / len(s))[grade < top])
        tail_sum = np.cumsum(gth[::-1])[::-1]
        g = np.concatenate([x.T @ gs.astype(np.float32) + ridge * w, tail_sum[:1], tail_sum[1:] * np.exp(par[d + 1:])])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        par -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8) * min(1.0, 2 - 2 * t / (steps + 1))
    th = par[d] + np.concatenate([[0.0], np.cumsum(np.exp(par[d + 1:]))])
    return OrdinalModel(par[:d].astype(np.float32), th)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the labels table: 0 poor, 1 acceptable but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED) -> OrdinalModel | None:
    """``ratings``: doc_id, grade (0 ..).  None if fewer than two grades."""
    C.ready(docs.sparkSession)
    chosen = ratings.select(F.col("doc_id").alias("rated_id"), "grade").orderBy(F.xxhash64("rated_id"), "rated_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("rated_id"), F.col(text_col).alias("rated_text")).join(F.broadcast(chosen), "rated_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, val = [], []
            for text in b.column(1):
                x = hashed_shares(text.as_py())
                on = np.flatnonzero(x)
                idx.append(on.astype("<u2").tobytes())
                val.append(x[on].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                                             ["rated_id", "grade", "idx", "val"])

    # repeated documents could exceed the bound; the limit keeps it
    got = rows.select(F.col("rated_id").cast("long"), "rated_text", F.col("grade").cast("int")).mapInArrow(
        extract, "rated_id long, grade int, idx binary, val binary").limit(max_labelled).collect()
    got.sort(key=lambda r: (r["rated_id"], bytes(r["idx"])))
    grade = np.array([r["grade"] for r in got], np.int64)
    present = np.unique(grade)
    if len(present) < 2:
        return None
    x = np.zeros((len(got), DIM), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["idx"], "<u2")] = np.frombuffer(r["val"], "<f4")
    del got
    return fit_ordinal(x, np.searchsorted(present, grade))


def _scores(model: OrdinalModel | None, min_tail: int, threshold: float):
    sent = (None, None) if model is None else (model.weights, model.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if sent[0] is None else OrdinalModel(*sent)
        for b in batches:
            n = b.num_rows
            expected, tail = np.zeros(n), np.zeros(n)
            for i, text in enumerate(b.column(b.num_columns - 1)):
                x = hashed_shares(text.as_py())
                if x.any():
                    t = own.tails(x[None, :])[0] if own else np.ones(1)
                    expected[i], tail[i] = t.sum(), t[min(min_tail, len(t)) - 1]
            extra = [pa.array(expected), pa.array(tail), pa.array(tail >= threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], [*b.schema.names[:-1], "expected_grade", "tail", "kept"])

    return run


def score(docs: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text",
          min_grade: int = 1, threshold: float = 0.5) -> DataFrame:
    """``id_col``, expected_grade, tail (P(grade >= min_grade)), kept."""
    C.ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(_scores(model, min_grade, threshold), "id long, " + SCORES).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", min_grade: int = 1,
              threshold: float = 0.5) -> DataFrame:
    """The rows whose document is kept, all columns unchanged."""
    C.ready(docs.sparkSession)
    names = [f"in_{i}" for i in range(len(docs.columns))]
    d = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    t = F.col(names[docs.columns.index(text_col)])
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, d.schema.fields)) + ", " + SCORES
    out = d.select(*names, t.alias("t")).mapInArrow(_scores(model, min_grade, threshold), schema)
    return out.where("kept").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
