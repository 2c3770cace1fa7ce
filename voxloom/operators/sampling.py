"""Ordering, sampling and sharding.

A global row index is the basis of head fractions, contiguous batches and
contiguous shards.  It is computed without a one-partition window, in the same
way at every size: rows are cut into buckets of a numeric lead of the sort order
(arithmetically for uniform hash orders, else at approximate quantiles),
bucket totals give each bucket's offset (a table of at most ``buckets``
rows), and a window partitioned by bucket numbers the rows inside it.
``rank_in_group`` cuts each group the same way for positions and running sums
inside groups, so a hot group is split instead of landing in one task.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.session import written

ROWS_PER_BUCKET = 2_000_000      # upper bound of rows ranked by one task


def seeded_key(keys, seed: int = V.SHUFFLE_SEED) -> Column:
    """O1 sort key: ``md5('<seed>:<key>...')`` — deterministic, seed-dependent and
    independent of partitioning."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _hash_lead(hex_col: Column) -> Column:
    # 60 leading bits of a hex digest: monotone in the digest's string order.
    return F.conv(F.substring(hex_col, 1, 15), 16, 10).cast("long")


def _by_quantiles(work: DataFrame, buckets: int) -> DataFrame:
    """Add ``_b``: the bucket of ``_lead`` between approximate quantiles, -1 for
    NULL; NaN is the last bucket."""
    probs = [i / buckets for i in range(1, buckets)]
    qs = work.stat.approxQuantile("_lead", probs, 1.0 / (8 * buckets)) if probs else []
    # an infinite quantile is no split of its own: the outer ones cover it
    cuts = sorted(set(q for q in qs if q is not None and math.isfinite(q)))
    splits = [-math.inf, *(cuts or [0.0]), math.inf]
    cut = Bucketizer(splits=splits, inputCol="_lead", outputCol="_b", handleInvalid="keep").transform(work)
    return cut.withColumn("_b", F.when(F.col("_lead").isNull(), F.lit(-1.0)).otherwise(F.col("_b")))


def _by_ranges(work: DataFrame, order_cols: list, buckets: int) -> DataFrame:
    """Add ``_b``: the range of the composite key ``order_cols`` (any types,
    NULLs first), then of a hash of the row, that a row falls in.  Split points
    are sampled anew whenever a range exchange runs, so the cut rows are written."""
    hashed = [F.col(f"`{f.name}`") for f in work.schema.fields if "map" not in f.dataType.simpleString()]
    cut = work.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(buckets, *order_cols, "_tie")
    return written(cut.withColumn("_b", F.spark_partition_id().cast("double")).drop("_tie"), "ranges")


def with_global_index(df: DataFrame, order_cols, idx_col: str = "idx", lead: Column | None = None,
                      rows_per_bucket: int = ROWS_PER_BUCKET, n_rows: int | None = None,
                      uniform_range: tuple[float, float] | None = None,
                      min_buckets: int | None = None, weight: Column | None = None) -> DataFrame:
    """Add a 0-based position of every row in the total order ``order_cols``
    (or, with ``weight``, the sum of ``weight`` over all earlier rows).

    ``order_cols`` should be unique per row; rows that tie in all of them get
    distinct positions next to each other, in no fixed order.  NULLs come first,
    as in ``orderBy``, and NaN last.  ``lead`` is a numeric expression monotone
    non-decreasing in that order (defaults to the first order column).  Rows are
    cut into ``max(min_buckets, n / rows_per_bucket)`` buckets of ``lead``
    (``min_buckets`` defaults to the shuffle width): arithmetically when
    ``lead`` is uniform on ``uniform_range`` (hash orders), else at approximate
    quantiles; rows whose ``lead`` is NULL are a bucket of their own.  Bucket
    totals (one number per bucket) give the offsets, which are put on the rows
    themselves; a window partitioned by bucket finishes the count inside it.
    Since the buckets follow ``lead``, many rows with one leading value spread
    over several buckets as long as ``lead`` varies among them.

    Without ``lead``, an order of several columns, or one that does not start
    with a number, is cut at split points over all order columns and a hash of
    the row: a leading value that all rows share is split by what follows it.
    Rows are written once for that; only rows equal in every column stay together.
    """
    order_cols = list(order_cols)
    n = df.count() if n_rows is None else n_rows
    spark = df.sparkSession
    if min_buckets is None:
        min_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min_buckets, math.ceil(n / rows_per_bucket))
    work = df.withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long"))
    by_ranges = lead is None and (len(order_cols) > 1 or not isinstance(df.select(order_cols[0]).schema[0].dataType, T.NumericType))
    if not by_ranges:
        work = work.withColumn("_lead", (lead if lead is not None else F.col(order_cols[0])).cast("double"))
    if by_ranges:
        work = _by_ranges(work, order_cols, buckets)
    elif uniform_range is not None:
        lo, hi = uniform_range
        work = work.withColumn("_b", F.least(F.floor((F.col("_lead") - lo) * (buckets / (hi - lo))),
                                             F.lit(buckets - 1)).cast("double"))
        work = work.withColumn("_b", F.when(F.col("_lead").isNull(), F.lit(-1.0)).otherwise(F.col("_b")))
    else:
        work = _by_quantiles(work, buckets)
    w = Window.partitionBy("_b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_w").over(w), F.lit(0).cast("long"))
    # one total per bucket: a table of at most `buckets` rows
    totals = sorted((float(r["_b"]), int(r["t"])) for r in work.groupBy("_b").agg(F.sum("_w").alias("t")).collect())
    offsets, acc = [], 0
    for b, t in totals:
        offsets.append((b, acc))
        acc += t
    off_df = spark.createDataFrame(offsets, T.StructType([
        T.StructField("_b", T.DoubleType()), T.StructField("_off", T.LongType())]))
    return (work.join(F.broadcast(off_df), "_b")
            .withColumn(idx_col, F.col("_off") + before)
            .drop("_b", "_off", "_lead", "_w"))


def rank_in_group(df: DataFrame, group_col: str, order_cols, out_col: str, lead: Column | None = None,
                  weight: Column | None = None, min_buckets: int | None = None) -> DataFrame:
    """Position of each row inside its group (``weight``: sum of ``weight`` over
    the group's earlier rows) without a window over a whole group.

    Rows are cut by approximate quantiles of ``lead``, a numeric expression
    non-decreasing in ``order_cols`` (defaults to the first of them), and ranked
    inside ``(group, bucket)``; a hot group spreads over the buckets, since no
    bucket holds much more than its share of all rows.  Bucket totals per group,
    a partial aggregate, give the offsets; they are joined on the same keys that
    the window is partitioned by, so the rows are shuffled once.  Groups may be
    of any type, and rows with a NULL group are a group of their own.
    ``order_cols`` must make rows unique within a group.
    """
    order_cols = list(order_cols)
    buckets = min_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a struct is never NULL, so NULL groups meet in the join too
    work = (df.withColumn("_g", F.struct(F.col(group_col).alias("g")))
            .withColumn("_lead", (lead if lead is not None else F.col(order_cols[0])).cast("double"))
            .withColumn("_w", (weight if weight is not None else F.lit(1)).cast("long")))
    work = _by_quantiles(work, buckets)
    none = F.lit(0).cast("long")
    inside = Window.partitionBy("_g", "_b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # at most `buckets` + 1 totals per group
    starts = (work.groupBy("_g", "_b").agg(F.sum("_w").alias("_t"))
              .select("_g", "_b", F.coalesce(F.sum("_t").over(earlier), none).alias("_off")))
    ranked = work.withColumn("_in", F.coalesce(F.sum("_w").over(inside), none))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out_col]
    return ranked.join(starts, ["_g", "_b"]).select(*kept, (F.col("_off") + F.col("_in")).alias(out_col))


def seeded_shuffle(df: DataFrame, key: str, seed: int = V.SHUFFLE_SEED, idx_col: str = "idx",
                   n_rows: int | None = None) -> DataFrame:
    """O1: deterministic permutation; ``idx`` is the row's position after it.
    Every row gets one position, also where keys are NULL or repeat (such rows
    lie next to each other).  Hash-bucketed, no sampling pass."""
    hashed = df.withColumn("_o1", seeded_key([key], seed))
    return with_global_index(hashed, ["_o1", key], idx_col, lead=_hash_lead(F.col("_o1")), n_rows=n_rows,
                             uniform_range=(0.0, float(16 ** 15))).drop("_o1")


def head_fraction(df: DataFrame, key: str | list[str], fraction_div: int = 5, idx_col: str = "idx",
                  n_rows: int | None = None) -> DataFrame:
    """O2: the first ``n div fraction_div`` rows in ``key`` order (one column or
    several), NULLs first."""
    n = df.count() if n_rows is None else n_rows
    return with_global_index(df, [key] if isinstance(key, str) else key, idx_col, n_rows=n).filter(F.col(idx_col) < n // fraction_div)


def head_n(df: DataFrame, order_cols, n: int = V.HEAD_SAMPLE) -> DataFrame:
    """O3: the first ``n`` rows in a total order (a top-k, not a full sort)."""
    return df.orderBy(*order_cols).limit(n)


def head_rows(df: DataFrame, key: str, order: Column, n: int = V.HEAD_SAMPLE) -> DataFrame:
    """O3 before expensive columns are built: the rows of ``df`` whose ``key`` is
    among the first ``n`` by ``(order, key)``.  The top-k runs on the narrow
    keys and a semi join prunes the rows."""
    keys = df.select(key).withColumn("_o", order)
    return df.join(head_n(keys, ["_o", key], n).select(key), key, "left_semi")


def row_batches(df: DataFrame, idx_col: str = "idx", batch_rows: int = V.BATCH_ROWS,
                batch_col: str = "batch") -> DataFrame:
    """Contiguous batches ``[k*batch_rows, (k+1)*batch_rows)`` of a global index."""
    return df.withColumn(batch_col, F.expr(f"{idx_col} div {int(batch_rows)}"))


def mean_length_head(df: DataFrame, ids_col: str, order_cols, n: int = V.HEAD_SAMPLE) -> DataFrame:
    """A3: mean token count over the first ``n`` rows (divides by rows present)."""
    return head_n(df.select(*order_cols, F.size(ids_col).alias("_len")), order_cols, n).agg(
        F.count("*").alias("sample_rows"), F.avg("_len").alias("avg_length"))


def _contiguous_starts(n: int, shards: int) -> list[int]:
    q, m = divmod(n, shards)
    return [k * q + min(k, m) for k in range(shards + 1)]


def shard_of(idx_col: str, n: int, shards: int, mode: str = "contiguous") -> Column:
    """K4: shard of the 0-based row index column ``idx_col`` among ``n`` rows cut
    in ``shards`` shards.

    contiguous: the first ``n % shards`` shards get one extra row; strided: ``idx % shards``.
    """
    if mode == "strided":
        return F.expr(f"cast({idx_col} % {shards} as int)")
    if mode != "contiguous":
        raise ValueError(f"unknown shard mode {mode!r}")
    q, m = divmod(n, shards)
    if q == 0:
        return F.expr(f"cast({idx_col} as int)")
    big = m * (q + 1)
    return F.expr(f"cast(if({idx_col} < {big}, {idx_col} div {q + 1}, {m} + ({idx_col} - {big}) div {q}) as int)")


def two_level_shards(df: DataFrame, idx_col: str, n: int, outer: int = V.OUTER_SHARDS,
                     inner: int = V.INNER_SHARDS, mode: str = "contiguous") -> DataFrame:
    """K4 twice: ``outer_shard`` of the table, ``inner_shard`` of each outer shard,
    plus ``inner_idx`` (position inside the inner shard).

    Shard boundaries depend only on ``n`` and the shard counts: the outer
    starts are a literal array of ``outer + 1`` numbers, the inner shard
    follows from the outer shard's size with integer arithmetic.
    """
    if mode == "strided":
        return (df.withColumn("outer_shard", F.expr(f"cast({idx_col} % {outer} as int)"))
                .withColumn("inner_shard", F.expr(f"cast(({idx_col} div {outer}) % {inner} as int)"))
                .withColumn("inner_idx", F.expr(f"({idx_col} div {outer}) div {inner}")))
    if mode != "contiguous":
        raise ValueError(f"unknown shard mode {mode!r}")
    o_arr = ", ".join(f"{x}L" for x in _contiguous_starts(n, outer))
    out = (df.withColumn("outer_shard", shard_of(idx_col, n, outer, "contiguous"))
           .withColumn("_ostart", F.expr(f"get(array({o_arr}), outer_shard)"))
           .withColumn("_osize", F.expr(f"get(array({o_arr}), outer_shard + 1) - _ostart"))
           .withColumn("_pos", F.expr(f"{idx_col} - _ostart"))
           .withColumn("_qi", F.expr(f"_osize div {inner}"))
           .withColumn("_mi", F.expr(f"_osize % {inner}"))
           .withColumn("inner_shard", F.expr(
               "cast(if(_pos < _mi * (_qi + 1), _pos div (_qi + 1), _mi + (_pos - _mi * (_qi + 1)) div greatest(_qi, 1)) as int)"))
           .withColumn("inner_idx", F.expr("_pos - (inner_shard * _qi + least(inner_shard, _mi))")))
    return out.drop("_ostart", "_osize", "_pos", "_qi", "_mi")
