import hashlib

from pyspark.sql import functions as F

from voxloom.operators import sampling
from tests import oracles as O


def test_global_index_multi_bucket_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 100003).alias("k"))
    idx = sampling.with_global_index(df, ["k"], "idx", rows_per_bucket=400)
    got = sorted((r["k"], r["idx"]) for r in idx.collect())
    expect = sorted((k, i) for i, k in enumerate(sorted(r["k"] for r in df.collect())))
    assert got == expect


def test_global_index_keeps_wide_rows(spark):
    df = spark.range(0, 300).select(F.col("id").alias("key"), (F.col("id") * 2).alias("payload"))
    idx = sampling.with_global_index(df, ["key"], "idx", rows_per_bucket=50)
    assert sorted((r["key"], r["idx"], r["payload"]) for r in idx.collect()) == [(i, i, 2 * i) for i in range(300)]


def test_seeded_shuffle_is_md5_order_and_partition_independent(spark):
    base = spark.range(0, 700).select(F.col("id").alias("doc_id"))
    expect = sorted(range(700), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    for parts in (1, 7):
        got = sampling.seeded_shuffle(base.repartition(parts), "doc_id").orderBy("idx").collect()
        assert [r["doc_id"] for r in got] == expect
    multi = sampling.with_global_index(base.withColumn("_o1", sampling.seeded_key(["doc_id"])), ["_o1", "doc_id"], "idx",
                                       lead=sampling._hash_lead(F.col("_o1")), rows_per_bucket=100)
    assert [r["doc_id"] for r in multi.orderBy("idx").collect()] == expect


def test_head_fraction_and_batches(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("k"))
    head = sampling.head_fraction(df, "k", 5)
    assert sorted(r["k"] for r in head.collect()) == list(range(200))
    b = sampling.row_batches(sampling.with_global_index(df, ["k"]), "idx", 100)
    counts = dict((r["batch"], r["count"]) for r in b.groupBy("batch").count().collect())
    assert counts == {**{i: 100 for i in range(10)}, 10: 3}


def test_shards_contiguous_and_strided(spark):
    for n, shards in [(1003, 10), (7, 10), (50, 50), (51, 50)]:
        df = spark.range(0, n).select(F.col("id").alias("idx"))
        got = dict((r["idx"], r["s"]) for r in df.select("idx", sampling.shard_of("idx", n, shards).alias("s")).collect())
        assert got == {i: O.contiguous_shard(i, n, shards) for i in range(n)}
        st = dict((r["idx"], r["s"]) for r in df.select("idx", sampling.shard_of("idx", n, shards, "strided").alias("s")).collect())
        assert st == {i: i % shards for i in range(n)}


def test_two_level_shards(spark):
    n, outer, inner = 1003, 10, 7
    df = spark.range(0, n).select(F.col("id").alias("idx"))
    got = {r["idx"]: (r["outer_shard"], r["inner_shard"], r["inner_idx"])
           for r in sampling.two_level_shards(df, "idx", n, outer, inner).collect()}
    for i in range(n):
        o = O.contiguous_shard(i, n, outer)
        members = [j for j in range(n) if O.contiguous_shard(j, n, outer) == o]
        pos = members.index(i)
        s = O.contiguous_shard(pos, len(members), inner)
        inner_members = [p for p in range(len(members)) if O.contiguous_shard(p, len(members), inner) == s]
        assert got[i] == (o, s, inner_members.index(pos))
    strided = {r["idx"]: (r["outer_shard"], r["inner_shard"], r["inner_idx"])
               for r in sampling.two_level_shards(df, "idx", n, outer, inner, "strided").collect()}
    assert all(strided[i] == (i % outer, (i // outer) % inner, (i // outer) // inner) for i in range(n))


def test_mean_length_head_divides_by_rows_present(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1)) for i in range(5)], "k long, ids array<int>")
    r = sampling.mean_length_head(df, "ids", ["k"], n=10000).collect()[0]
    assert r["sample_rows"] == 5 and r["avg_length"] == 3.0


def test_rank_in_group_splits_a_hot_group(spark):
    rows = [(0, t, t % 5) for t in range(3000)] + [(g, t, 1) for g in range(1, 40) for t in range(10)]
    df = spark.createDataFrame(rows, "g long, t long, w long")
    # the hot group must land in several buckets
    cut = sampling._by_quantiles(df.withColumn("_lead", F.col("t").cast("double")), 8)
    assert cut.filter("g = 0").select("_b").distinct().count() >= 6
    r = sampling.rank_in_group(df, "g", ["t"], "rank", min_buckets=8)
    got = {(x["g"], x["t"]): x["rank"] for x in r.collect()}
    assert all(got[(g, t)] == t for (g, t, _) in rows)
    s = sampling.rank_in_group(df, "g", ["t"], "before", weight=F.col("w"), min_buckets=8)
    got = {(x["g"], x["t"]): x["before"] for x in s.collect()}
    acc = {}
    for g, t, w in rows:
        assert got[(g, t)] == acc.get(g, 0)
        acc[g] = acc.get(g, 0) + w


def test_rank_in_group_any_key(spark):
    """Groups that are NULL, strings or 64-bit ids; a NULL order key comes first."""
    ids = [None, 2 ** 62 + 1, 2 ** 62 + 2, -5]
    rows = [(g, t) for g in ids for t in [None, *range(50)]]
    df = spark.createDataFrame(rows, "g long, t long").repartition(4)
    for frame in (df, df.withColumn("g", F.concat(F.lit("k"), F.col("g").cast("string")))):
        got = sampling.rank_in_group(frame, "g", ["t"], "rank", min_buckets=6).collect()
        assert len(got) == len(rows)
        assert all(r["rank"] == (0 if r["t"] is None else r["t"] + 1) for r in got)
    assert sampling.rank_in_group(df.limit(0), "g", ["t"], "rank").count() == 0


def test_head_rows(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(20)], "k long, p string")
    assert {r["k"] for r in sampling.head_rows(df, "k", -F.col("k"), 3).collect()} == {17, 18, 19}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
def test_rank_in_group_property(spark, sizes, buckets, hot):
    """Rank and running sum inside groups equal a Python scan, whatever the
    bucket count, with one group made much larger than the rest."""
    sizes = list(sizes)
    sizes[hot % len(sizes)] *= 20
    rows = [(g, t, (g * 7 + t) % 4) for g, n in enumerate(sizes) for t in range(n)]
    df = spark.createDataFrame(rows, "g long, t long, w long")
    r = sampling.rank_in_group(df, "g", ["t"], "rank", min_buckets=buckets)
    s = sampling.rank_in_group(df, "g", ["t"], "before", weight=F.col("w"), min_buckets=buckets)
    ranks = {(x["g"], x["t"]): x["rank"] for x in r.collect()}
    sums = {(x["g"], x["t"]): x["before"] for x in s.collect()}
    acc = {}
    for g, t, w in rows:
        assert ranks[(g, t)] == t and sums[(g, t)] == acc.get(g, 0)
        acc[g] = acc.get(g, 0) + w


def test_global_index_orders_nulls_and_repeated_keys(spark):
    """NULLs first, NaN last, repeated keys next to each other, no row lost or doubled."""
    keys = [None] * 7 + [float("nan")] * 2 + [float(i % 40) for i in range(400)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k double, row long").repartition(5)
    order = sorted(keys, key=lambda k: (k is not None, k != k, k if k is not None and k == k else 0.0))
    for buckets in (1, 2, 16):
        got = sampling.with_global_index(df, ["k"], "idx", min_buckets=buckets).orderBy("idx").collect()
        assert [r["idx"] for r in got] == list(range(len(keys)))
        assert [str(r["k"]) for r in got] == [str(k) for k in order]
        assert sorted(r["row"] for r in got) == list(range(len(keys)))
    assert sampling.with_global_index(df.limit(0), ["k"], "idx").count() == 0
    shuffled = sampling.seeded_shuffle(df, "k").collect()
    assert sorted(r["idx"] for r in shuffled) == list(range(len(keys)))
    assert sampling.head_fraction(df, "k", 5).count() == len(keys) // 5


def test_global_index_splits_a_shared_leading_value(spark):
    """One value leads all rows: the buckets follow the columns behind it, of any type."""
    rows = [(1, None if i % 50 == 0 else f"k{i % 13}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b string, c long").repartition(6)
    want = [r[2] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2]))]
    assert [r["c"] for r in sampling.with_global_index(df, ["a", "b", "c"], "idx").orderBy("idx").collect()] == want
    cut = sampling._by_ranges(df, ["a", "b", "c"], 8).groupBy("_b").count().collect()
    assert len(cut) == 8 and max(r["count"] for r in cut) < 1000
    # ties in all order columns spread too, and every row gets one position
    tied = sampling.with_global_index(df, ["a", "a"], "idx")
    assert sorted(r["idx"] for r in tied.collect()) == list(range(2000))
    assert sampling._by_ranges(df, ["a"], 8).select("_b").distinct().count() == 8
    assert sampling.head_fraction(df, ["a", "b", "c"], 5).count() == 400
    assert sampling.with_global_index(df.limit(0), ["a", "b"], "idx").count() == 0
