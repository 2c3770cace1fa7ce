"""Approximate nearest neighbours by low-dimensional stable projections.

Unit vectors are projected to ``DIMS`` Gaussian (2-stable) coordinates.  A
squared projected distance is the squared true distance times a chi-square
variable with ``DIMS`` degrees of freedom, so once the projected frontier r
satisfies r^2 >= quantile(P_STOP) * d_k^2, a neighbour nearer than the current
k-th (d_k) has been missed with probability 1 - P_STOP at most.

The index is a kd-tree over the projections: its splits come from a sample of
bounded size, every vector is put into a leaf, and a leaf larger than
``LEAF_ROWS`` is dealt to blocks.  A query searches its own leaf, which gives
d_k, then every leaf whose box lies within the stopping radius.  Inside a leaf,
points are taken by growing projected distance and verified against the
original vectors until the chi-square test holds.

Vectors that are equal form a class that is stored, and searched for, once; a
class keeps its k + 1 smallest distinct ids, more can never be among k answers.

Defined results: vectors that are null, all zero, hold null or non-finite
components, or have another dimension than most (ties: the smaller) take no
part, as queries or candidates; rows that repeat an id with its vector count once;
rows that share an id only are rows of their own, as queries and as each other's
candidates; equal scores go to the smaller id; a query has
fewer than k rows only if there are fewer candidates; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm import common as C

DIMS = 8
P_STOP = 0.98
LEAF_ROWS = 2048
#: classes the tree's splits are taken from, at most, and per leaf, at least
SAMPLE_ROWS = 100_000
SAMPLE_PER_LEAF = 32
#: queries of one leaf searched together
QUERY_ROWS = 1024
SEED = 20_240_229


def chi_square_cdf(x: float, dims: int = DIMS) -> float:
    """For an even number of degrees of freedom."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h ** i / math.factorial(i) for i in range(dims // 2))


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, dims) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, DIMS))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


class KdTree:
    """Median splits on the widest dimension; leaves numbered in order."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.dim: list[int] = []
        self.at: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        lo, hi = [], []

        def build(p: np.ndarray, want: int, low: np.ndarray, high: np.ndarray) -> int:
            spread = p.max(0) - p.min(0) if len(p) else np.zeros(DIMS)
            if want < 2 or len(p) < 16 or spread.max() <= 0:
                lo.append(low)
                hi.append(high)
                return -len(lo)
            d = int(spread.argmax())
            at = float(np.median(p[:, d]))
            if not ((p[:, d] < at).any()):
                at = float(np.nextafter(p[:, d].min(), np.inf))
            node = len(self.dim)
            self.dim.append(d)
            self.at.append(at)
            self.left.append(0)
            self.right.append(0)
            h2, l2 = high.copy(), low.copy()
            h2[d], l2[d] = at, at
            self.left[node] = build(p[p[:, d] < at], want // 2, low, h2)
            self.right[node] = build(p[p[:, d] >= at], want - want // 2, l2, high)
            return node

        inf = np.full(DIMS, np.inf)
        self.root = build(points, leaves, -inf, inf)
        self.low, self.high = np.array(lo), np.array(hi)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            less = points[rows, self.dim[node]] < self.at[node]
            todo += [(self.left[node], rows[less]), (self.right[node], rows[~less])]
        return out

    def distances(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every leaf's box."""
        d = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        return (d * d).sum(1)


def search_leaf(points: np.ndarray, norms: np.ndarray, ids: list[np.ndarray], proj: np.ndarray, query: np.ndarray,
                qproj: np.ndarray, bound: float, k: int, stop: float, mine: int = -1, block: int = 64) -> list[tuple[float, int, bool]]:
    """The k best (cosine, id, whether of row ``mine``) of a leaf, without those beyond ``bound``, the
    squared distance of the k-th best known elsewhere.  Blocks of growing
    projected distance double in size; the test is made before each."""
    near = ((proj - qproj) ** 2).sum(1)
    order = np.flatnonzero(near <= stop * bound)
    order = order[np.argsort(near[order], kind="stable")]
    qn = math.sqrt(float((query * query).sum()))
    best: list[tuple[float, int, bool]] = []
    at = 0
    while at < len(order) and near[order[at]] <= stop * bound:
        rows = order[at:at + block]
        at, block = at + block, 2 * block
        # a quick product first; what may enter the best, ties included, is measured exactly
        rows = rows[points[rows] @ query / (norms[rows] * qn) >= 1 - bound / 2 - 1e-9]
        if not len(rows):
            continue
        cos = (points[rows] * query).sum(1) / (norms[rows] * qn)
        best += [(-c, int(i), bool(r == mine)) for c, r in zip(cos.tolist(), rows) for i in ids[r]]
        best = sorted(best)[:k]
        if len(best) == k:
            bound = min(bound, max(0.0, 2 + 2 * best[-1][0]))
    return [(-c, i, own) for c, i, own in best]


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in col]) if len(col) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``queries``: boolean column over ``vectors``.  Returns query_id, rank,
    vec_id, score."""
    spark = vectors.sparkSession
    C.ready(spark)
    e = F.col(f"`{vec_col}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col(f"`{id_col}`").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    v = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), e.alias("v"), queries.alias("is_query"))
    top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], schema)
    dim = top["d"]
    v = v.where(F.size("v") == dim)
    same = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), "v"))).alias("same")
    v = v.select("id", "v", "is_query", same).dropDuplicates(["id", "same"])
    # k + 1 smallest ids of each class, first per salt: a class may hold a third of all rows
    small = v.withColumn("salt", F.pmod("id", F.lit(16)))
    for part in (["same", "salt"], ["same"]):
        small = small.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    classes = C.materialize(small.groupBy("same").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")), "vectors")
    n = classes.count()
    asked = v.where("is_query").select("same", F.col("id").alias("query_id"))
    wanted = classes.join(asked.select("same").distinct(), "same").select("same", "v")

    every = max(1, n // SAMPLE_ROWS)
    g = projection(dim)

    def projected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"same": f["same"], "p": [x.tobytes() for x in unit(_matrix(f["v"])) @ g] if len(f) else []})

    some = classes.where(F.pmod(F.xxhash64("same"), F.lit(every)) == 0).select("same", "v").mapInPandas(projected, "same string, p binary")
    got = some.orderBy("same").limit(SAMPLE_ROWS).select("p").collect()
    sample = np.array([np.frombuffer(r["p"]) for r in got]) if got else np.zeros((0, DIMS))
    tree = KdTree(sample, max(1, min(n // LEAF_ROWS, len(got) // SAMPLE_PER_LEAF)))
    stop = chi_square_quantile(P_STOP)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["leaf"] = tree.leaf(unit(_matrix(f["v"])) @ g) if len(f) else np.zeros(0, np.int64)
            yield f

    index = C.materialize(classes.mapInPandas(place, "same string, ids array<long>, v array<float>, leaf long".replace(
        "array<float>", classes.schema["v"].dataType.simpleString())), "index")
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    blocks = {leaf: -(-c // (2 * LEAF_ROWS)) for leaf, c in sizes.items()}
    how_many = F.create_map(*(F.lit(x).cast("long") for kv in blocks.items() for x in kv)) if blocks else None
    kind = classes.schema["v"].dataType.simpleString()

    def visit(q: DataFrame) -> DataFrame:
        """q: same, v, leaf, bound -> same, score, vec_id, own (k + 1 best per block; own: of the query's class)."""
        q = C.materialize(q, "visits")
        load = q.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("q_parts"))
        nblk = F.element_at(how_many, F.col("leaf"))
        points = index.join(F.broadcast(load), "leaf").select(
            "leaf", F.pmod(F.xxhash64("same"), nblk).alias("block"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("part"), "same", "ids", "v")
        asks = q.join(F.broadcast(load), "leaf").select(
            "leaf", F.explode(F.sequence(F.lit(0).cast("long"), nblk - 1)).alias("block"),
            F.pmod(F.xxhash64("same"), F.col("q_parts")).cast("int").alias("part"), "same", "v", "bound")

        def run(p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple[str, float, int, bool]] = []
            if len(p) and len(a):
                x, y = _matrix(p["v"]), _matrix(a["v"])
                px, py = unit(x) @ g, unit(y) @ g
                ids = list(p["ids"])
                norms = np.sqrt((x * x).sum(1))
                row = {s: i for i, s in enumerate(p["same"])}
                for i, (s, bound) in enumerate(zip(a["same"], a["bound"])):
                    out += [(s, *found) for found in search_leaf(x, norms, ids, px, y[i], py[i], bound, k + 1, stop, row.get(s, -1))]
            return pd.DataFrame(out, columns=["same", "score", "vec_id", "own"]).astype({"score": float, "vec_id": "int64", "own": bool})

        keys = ["leaf", "block", "part"]
        return points.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(run, "same string, score double, vec_id long, own boolean")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("same").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n")

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["leaf"] = tree.leaf(unit(_matrix(f["v"])) @ g) if len(f) else np.zeros(0, np.int64)
            f["bound"] = np.inf
            yield f

    first = C.materialize(best(visit(wanted.mapInPandas(home, f"same string, v {kind}, leaf long, bound double"))), "near")
    # squared distance of the (k+1)-th best so far; unknown if fewer
    known = first.groupBy("same").agg(F.when(F.count(F.lit(1)) > k, F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))).otherwise(
        F.lit(float("inf"))).alias("bound"))
    filled = np.array(sorted(sizes), np.int64)

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            p = unit(_matrix(f["v"])) @ g
            own = tree.leaf(p)
            rows, leaves = [], []
            for i, bound in enumerate(f["bound"].to_numpy()):
                near = filled[tree.distances(p[i])[filled] <= stop * bound]
                near = near[near != own[i]]
                rows += [i] * len(near)
                leaves += near.tolist()
            out = f.iloc[rows][["same", "v"]].copy()
            out["leaf"] = leaves
            out["bound"] = f["bound"].to_numpy()[rows] if rows else []
            yield out.astype({"leaf": "int64", "bound": float})

    more = wanted.join(known, "same", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).mapInPandas(
        reach, f"same string, v {kind}, leaf long, bound double")
    found = C.materialize(best(first.unionByName(visit(more))), "nearest")
    answers = asked.join(found, "same").where("not (own and vec_id = query_id)")
    w = Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
