"""The conversation prefix trie against brute force, with odd rows."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from voxloom.llm import conversation_trie as trie
from voxloom.llm import queries

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in made.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}

    def total(k):
        below = [total(x) for x in kids[k]]
        leaves = sum(x[0] for x in below) or 1
        saved = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved += sum(x[1] for x in below)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(made[c]) == len(k))))
        out[(min(members[k]), len(k))] = (min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved,
                                          hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        total(())
    return out


def found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, ROWS)
    if extra:
        df = df.withColumn("pos", F.lit("x")).withColumn("id", F.lit(1)).withColumn("DEPTH", F.lit(2))
    turns, convs = trie.shared_openings(df)
    nodes, ends = trie.prefix_trie(turns, convs)
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    both = nodes.join(trie.member_digests(ends), ["conv_id", "depth"], "left").withColumn("d", digest).collect()
    assert len(both) == len({(r["conv_id"], r["depth"]) for r in both})
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["d"]) for r in both}


def test_trie_equals_brute_force(spark):
    rows = []
    for c in range(60):  # a third share all turns, others share openings
        turns = [("user", "hello"), ("assistant", "hi"), ("user", f"q{c % 3}")] + [("assistant", f"a{c}")] * (c % 4)
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns[:3] if c % 3 == 0 else turns)]
    rows += [(100, i, "user" if i % 2 else "assistant", f"é{i % 7}") for i in range(700)]  # a chain over several spans
    rows += [(-7, 0, "user", "below zero"), (-5, 0, None, None), (None, 0, "user", "no conversation"), (205, None, "user", "null turn"),
             (205, 0, "user", "tie"), (205, 0, "user", "tie"), (205, 0, "assistant", "tie"), (206, 3, "", ""), (207, 1, "user", "a" * 50_000)]
    assert found(spark, rows, extra=True) == {k: v for k, v in brute([r for r in rows]).items()}


def test_trie_of_one_chain_and_of_nothing(spark):
    one = [(3, i, "user", str(i)) for i in range(5)]
    assert found(spark, one) == brute(one)
    assert found(spark, []) == {}


def test_totals_of_random_trees(spark):
    import random
    rng = random.Random(5)
    for shape in ("deep", "wide"):
        n = 300
        parent = [None] + [rng.randint(max(0, i - 2), i - 1) if shape == "deep" else rng.randint(0, i // 8) for i in range(1, n)]
        kids = defaultdict(list)
        for i, p in enumerate(parent):
            kids[p].append(i)
        value = [rng.randint(0, 50) for _ in range(n)]
        want = value[:]
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
        nodes = spark.createDataFrame([(i, p, len(kids[i]), v) for i, (p, v) in enumerate(zip(parent, value))], "id long, parent long, kids long, v long")
        got = {r["id"]: r["v"] for r in trie.subtree_totals(nodes, ["v"]).collect()}
        assert got == dict(enumerate(want))


def test_member_digest_streams_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 7)
    ends = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).cast("long").alias("conv_id"), F.lit(2).cast("long").alias("depth"),
                                    F.col("id").alias("member"))
    got = {r["conv_id"]: r["ends_sha256"] for r in trie.member_digests(ends).collect()}
    assert len(got) == 301
    assert got[1] == hashlib.sha256(",".join(map(str, range(700))).encode()).hexdigest()
    assert got[999] == hashlib.sha256(b"999").hexdigest()


def test_query_has_the_root(spark):
    got = queries.op11_conversation_trie(spark, "/root/testdata/sf0.001").where("depth = 0").collect()
    assert len(got) == 1 and got[0]["parent_conv_id"] is None
