"""Hard negatives against brute force, with odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, k=5, n=10, low=30, high=90):
    used = []
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(abs(x) > 1e6 for x in v):
            continue
        row = (i, lab, tuple(math.floor(256 * x) for x in v))
        if row not in used:
            used.append(row)
    out = []
    for a in used:
        if not anchor(a[0]):
            continue
        dot = {id(r): sum(x * y for x, y in zip(a[2], r[2])) for r in used}
        mine = sorted((r for r in used if r is not a and r[1] == a[1]), key=lambda r: (-dot[id(r)], r[0]))[:k]
        for p in mine:
            s = dot[id(p)]
            hard = sorted((r for r in used if r[1] != a[1] and low * s <= 100 * dot[id(r)] <= high * s), key=lambda r: (-dot[id(r)], r[0]))[:n]
            out += [(a[0], p[0], i + 1, r[0], s, dot[id(r)]) for i, r in enumerate(hard)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("rank", F.lit("x")).withColumn("KEY", F.lit(1)).withColumn("rb", F.lit(0))
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0).collect())


def vectors(seed, n, dims=24, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, dims))
    x = centers[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dims))
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, rng.integers(0, labels, n)))]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 12)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 70)
    rows = vectors(1, 400)
    rows += [(1000 + i, rows[0][1], 0 if i % 2 else 3) for i in range(150)]  # many equal vectors: ties by id
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2010, [nan] * 24, 1), (2020, [inf] + [0.0] * 23, 1), (2030, [None] * 24, 1), (2040, [0.0] * 24, None),
             (None, [1.0] * 24, 1), (2050, [], 1), (2060, [1.0, 2.0], 1), (2070, [0.0] * 24, 1), (2080, [1e30] * 24, 1),
             rows[7], rows[20]]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(16) * 5e4).tolist(), i % 3) for i in range(60)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0] * 4, 1)]) == []
    assert found(spark, [(0, [1.0] * 4, 1), (1, [1.0] * 4, 1), (2, [0.5] * 4, 2)]) == [(0, 1, 1, 2, 4 * 65536, 2 * 65536)]
    assert found(spark, [(0, None, 1), (1, [1.0], None)]) == []


@pytest.mark.parametrize("n", hn.LEVELS)
def test_bounds_hold_and_tighten(n):
    import pyarrow as pa
    rng = np.random.default_rng(n)
    q = np.floor(256 * rng.standard_normal((50, 64))).astype(np.int64)
    s = q.reshape(50, hn.LEVELS[-1], -1).astype(float)
    t = pa.table({"vector": [x.tobytes() for x in q], "summary": [np.concatenate([a, b]).tobytes() for a, b in zip(s.sum(2), (s * s).sum(2))]})
    v = hn.Vectors(t, 64)
    mean, dev = v.levels[n]
    exact = q @ q.T
    assert (np.abs(exact - mean @ mean.T) <= dev @ dev.T + 1e-3).all()
    if n > hn.LEVELS[0]:
        coarse_mean, coarse_dev = v.levels[n // 2]
        assert ((mean @ mean.T + dev @ dev.T) <= (coarse_mean @ coarse_mean.T + coarse_dev @ coarse_dev.T) + 1e-3).all()
