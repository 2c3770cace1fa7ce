"""Batch-inference stage (M1-M4, Q15 encoder hook).

A caller-supplied model runs over a table in Arrow batches: ``make_model`` is
called once per task or per Python worker (never per row), ``fn(model, pandas.DataFrame)`` returns a
pandas frame of the output schema.  Parallelism is the partition count (M2).
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.session import ship_package


_WORKER_MODELS: dict[str, object] = {}


def worker_model(name: str, make_model: Callable[[], object]) -> object:
    """The model of this Python worker process, loaded at its first use."""
    if name not in _WORKER_MODELS:
        _WORKER_MODELS[name] = make_model()
    return _WORKER_MODELS[name]


def map_model(df: DataFrame, make_model: Callable[[], object], fn: Callable[[object, pd.DataFrame], pd.DataFrame],
              schema: T.StructType | str, partitions: int | None = None, name: str | None = None) -> DataFrame:
    """M1 + M2: apply a model to every row.  With ``name`` the model is loaded
    once per Python worker and shared by its tasks, else once per task."""
    if partitions:
        df = df.repartition(partitions)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker_model(name, make_model) if name else make_model()
        for pdf in batches:
            yield fn(model, pdf)

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class RetryPolicy:
    """How often a value may be tried, which errors are worth another try, and
    the wait before each further pass (growing, bounded)."""
    attempts: int = 2
    retryable: Callable[[Exception], bool] = lambda e: True
    first_wait: float = 0.0
    growth: float = 2.0
    longest_wait: float = 30.0

    def wait_before(self, done: int) -> float:
        return min(self.longest_wait, self.first_wait * self.growth ** (done - 1)) if done else 0.0


class Outcome(NamedTuple):
    value: object
    status: str
    error: str | None
    attempts: int


class ResourcePool:
    """A task's resources (clients, keys), taken from an iterable one after
    another; ``current`` is None once they are used up."""

    def __init__(self, resources: Iterable[object]) -> None:
        self._rest = iter(resources)
        self.current = next(self._rest, None)

    def replace(self) -> None:
        self.current = next(self._rest, None)


#: results handed on at once, and characters (or bytes) of the values they come from, about
SETTLED_ROWS = 256
SETTLED_CHARS = 1_000_000


def settled(values: Sequence[object], pool: ResourcePool, call: Callable, policy: RetryPolicy) -> Iterator[tuple[list[int], list[Outcome]]]:
    """M3 for a batch: the batch is worked through in passes.  Each pass calls
    the pool's current resource on all values still open; what failed with a
    retryable error goes into the next pass, with the next resource.  Yields
    positions and outcomes in pieces as they are settled, so the results of a
    whole batch are never held together."""
    at: list[int] = []
    got: list[Outcome] = []
    held = 0
    open_: dict[int, str | None] = dict.fromkeys(range(len(values)))
    for done in range(policy.attempts):
        if not open_ or pool.current is None:
            break
        time.sleep(policy.wait_before(done))
        failed: dict[int, str | None] = {}
        for i in open_:
            try:
                outcome = Outcome(call(pool.current, values[i]), "ok", None, done + 1)
            except Exception as e:  # noqa: BLE001 - the caller's client may raise anything
                text = f"{type(e).__name__}: {e}"
                if policy.retryable(e) and done + 1 < policy.attempts:
                    failed[i] = text
                    continue
                outcome = Outcome(None, "error", text, done + 1)
            at.append(i)
            got.append(outcome)
            held += len(values[i]) if isinstance(values[i], str | bytes) else 1
            if len(at) >= SETTLED_ROWS or held >= SETTLED_CHARS:
                yield at, got
                at, got, held = [], [], 0
        open_ = failed
        if open_:
            pool.replace()
    spent = policy.attempts if pool.current is not None else 0
    at.extend(open_)
    got.extend(Outcome(None, "error", text or "no resource left", spent) for text in open_.values())
    if at:
        yield at, got


def resolve(values: Sequence[object], pool: ResourcePool, call: Callable, policy: RetryPolicy) -> list[Outcome]:
    """The outcomes of ``settled`` in the order of ``values``."""
    out = {i: o for at, got in settled(values, pool, call, policy) for i, o in zip(at, got)}
    return [out[i] for i in range(len(values))]


def call_with_retry(df: DataFrame, input_col: str, resources: Callable[[], Iterable[object]], call: Callable,
                    out_col: str = "result", out_type: T.DataType = T.StringType(),
                    policy: RetryPolicy = RetryPolicy()) -> DataFrame:
    """M1 + M3: run ``call(resource, value)`` on every row.  ``resources()``
    gives a task its pool.  Adds ``out_col``, ``status`` ('ok' / 'error'),
    ``error`` and ``attempts``; a failing row never fails the job (P7).
    A task holds the results of ``SETTLED_ROWS`` rows, not those of an Arrow batch."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, out_type), T.StructField("status", T.StringType()),
                                              T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ResourcePool(resources())
        for pdf in batches:
            if not len(pdf):
                yield _with_outcomes(pdf, [])
            for at, got in settled(list(pdf[input_col]), pool, call, policy):
                yield _with_outcomes(pdf.iloc[at].copy(), got)

    def _with_outcomes(pdf: pd.DataFrame, got: list[Outcome]) -> pd.DataFrame:
        pdf[out_col] = [o.value for o in got]
        pdf["status"] = [o.status for o in got]
        pdf["error"] = [o.error for o in got]
        pdf["attempts"] = np.array([o.attempts for o in got], np.int32)
        return pdf

    return df.mapInPandas(run, schema)


def byte_encode_batch(texts: pa.Array) -> pa.Array:
    """``[start_of_text] + UTF-8 bytes`` of a string array, from its buffers:
    no step per row.  NULL stays NULL."""
    raw = texts.cast(pa.large_binary())
    n = len(raw)
    valid = raw.is_valid().to_numpy(zero_copy_only=False)
    lens = np.zeros(n, np.int64)
    lens[valid] = pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False)[valid]
    data = b"".join(raw.drop_null().to_pylist()) if raw.null_count else raw.buffers()[2]
    first = 0 if raw.null_count or not n else int(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset])
    body = np.frombuffer(data or b"", np.uint8)[first:first + int(lens.sum())]
    sizes = np.where(valid, lens + 1, 0)
    ends = np.cumsum(sizes)
    out = np.empty(int(sizes.sum()), np.int32)
    heads = (ends - sizes)[valid]
    inner = np.ones(len(out), bool)
    inner[heads] = False
    out[heads] = V.START_OF_TEXT
    out[inner] = body
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out), mask=pa.array(~valid))


def encode_text(df: DataFrame, text_col: str = "text", out_col: str = "text_ids",
                encoder: Callable[[pd.Series], pd.Series] | None = None, make_encoder: Callable | None = None) -> DataFrame:
    """Q15 through M1: run a (caller-supplied) tokenizer over a text column."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    if encoder is None and make_encoder is None:
        at = df.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, byte_encode_batch(b.column(at))], [*b.schema.names, out_col])

        ship_package(df.sparkSession)
        return df.mapInArrow(run, schema)
    enc_factory = make_encoder or (lambda: encoder)

    def fn(enc, pdf):
        pdf[out_col] = enc(pdf[text_col])
        return pdf

    return map_model(df, enc_factory, fn, schema)


def _narrow(good: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """``good`` without its true entries that ``keep`` drops."""
    out = good.copy()
    out[np.flatnonzero(good)[~keep]] = False
    return out


def project_embeddings(df: DataFrame, emb_col: str, weights: np.ndarray, out_col: str = "projection") -> DataFrame:
    """M4: linear projection without bias, ``emb @ weights`` (``d x D``).

    The weight matrix is broadcast once (its size is fixed by the model, not the
    data) and applied per Arrow batch with one numpy matmul.  A vector that is
    NULL, holds a NULL or has another width projects to NULL.
    """
    w = np.asarray(weights, dtype=np.float64)
    d, out_dim = w.shape
    bw = df.sparkSession.sparkContext.broadcast(w)
    out_field = T.StructField(out_col, T.ArrayType(T.DoubleType()))
    schema = T.StructType(df.schema.fields + [out_field])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mat = bw.value
        for rb in batches:
            col = rb.column(rb.schema.get_field_index(emb_col))
            lens = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            good = lens == d
            rows = col.filter(pa.array(good))
            vals = rows.flatten()
            proj = vals.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d) @ mat
            if vals.null_count:  # a vector with a NULL component has no projection either
                whole = ~vals.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), d).any(axis=1)
                proj, good = proj[whole], _narrow(good, whole)
            sizes = np.where(good, out_dim, 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            arr = pa.ListArray.from_arrays(offsets, pa.array(proj.reshape(-1), pa.float64()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays(list(rb.columns) + [arr], names=list(rb.schema.names) + [out_col])

    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
