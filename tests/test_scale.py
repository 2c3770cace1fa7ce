"""Bounded work per task: pieces, files, narrow rows."""

from pyspark.sql import types as T

from voxloom.operators import inference
from voxloom.operators.inference import ResourcePool, RetryPolicy


def test_retry_results_leave_in_pieces():
    """A batch's results are handed on as they are settled; what failed follows with the next resource."""
    def call(client, x):
        if client == "bad" and x % 10 == 3:
            raise RuntimeError("quota")
        return [x] * 5

    n = 4 * inference.SETTLED_ROWS
    pieces = list(inference.settled(list(range(n)), ResourcePool(["bad", "good"]), call, RetryPolicy()))
    assert len(pieces) > 3 and max(len(at) for at, _ in pieces) <= inference.SETTLED_ROWS
    got = {i: o for at, out in pieces for i, o in zip(at, out)}
    assert sorted(got) == list(range(n)) and sum(len(at) for at, _ in pieces) == n
    assert all(got[i] == ([i] * 5, "ok", None, 2 if i % 10 == 3 else 1) for i in range(n))
    long = list(inference.settled(["x" * inference.SETTLED_CHARS] * 3, ResourcePool(["good"]), lambda c, v: len(v), RetryPolicy()))
    assert [at for at, _ in long] == [[0], [1], [2]]


def test_call_with_retry_holds_no_whole_batch(spark):
    """Fewer results than an Arrow batch has rows are alive at a time."""
    df = spark.range(2000).coalesce(1).selectExpr("id", "cast(id AS string) AS path")
    alive: set = set()

    class Words(list):
        def __init__(self, *a):
            super().__init__(*a)
            alive.add(id(self))
            assert len(alive) <= 3 * inference.SETTLED_ROWS, "results of a whole batch are held"

        def __del__(self):
            alive.discard(id(self))

    out = inference.call_with_retry(df, "path", lambda: ["client"], lambda c, p: Words([p, p]), "words", T.ArrayType(T.StringType()))
    assert {r["id"]: (r["words"], r["status"]) for r in out.collect()} == {i: ([str(i)] * 2, "ok") for i in range(2000)}


def test_shingle_order_counts_every_document(spark):
    """The order's counts are those of all texts, also of far more than any sample would hold."""
    from voxloom.llm import jaccard_join as J
    n = 30_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('very common words come here ', id % 1000, ' and number ', id) AS text").repartition(4)
    sketched = J.C.materialize(J.fingerprints(docs, "doc_id", "text"), "test-marks")
    counts, hot = J.bucket_counts(sketched, n)
    want = J.np.zeros_like(counts)
    for _, s in J.shingle_sets([r["text"] for r in docs.collect()]):
        J.np.add.at(want, J.bucket_of(s), 1)
    assert (counts == want).all() and int((counts >= n).sum()) == 1 and 300 <= hot < n
    assert sketched.where("buckets is null").count() == n
    common = next(J.shingle_sets(["very common words come here"]))[1]
    _, s = next(J.shingle_sets(["very common words come here 7 and number 7"]))
    prefix, count = J.first_prefix(s, counts)
    assert len(prefix) == J.prefix_length(len(s)) and not set(common.tolist()) & set(prefix.tolist()) and (count < hot).all()


ODD_TEXTS = [(0, "", "en"), (1, None, "de"), (2, "abcdefgh" * 3, "en"), (3, "aé€😀" * 5, "de"), (4, "\x00\x7f 1234567", None), (None, "x", "fr"), (2, "again", "en")]


def test_stand_ins_are_the_ids_of_the_expressions(spark):
    from pyspark.sql import functions as F
    from voxloom.functions import arrays as A
    from voxloom.plans import fixtures as FX
    df = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, lang string").coalesce(1)
    got = FX.with_stand_ins(df).collect()
    b = A.utf8_bytes("text")
    want = df.select("*", F.concat(F.array(F.lit(128000)), b).alias("text_ids"), A.frames_from_bytes(b).alias("codes_list")).collect()
    assert got == want and got[1]["codes_list"] is None and got[0]["text_ids"] == [128000]


def test_ids_are_built_after_the_last_shuffle(spark):
    """pack_rows with ``build`` packs the same rows and shuffles texts, not ids."""
    import re

    from pyspark.sql import functions as F
    from voxloom.operators import packing
    from voxloom.plans import fixtures as FX, paths, registry
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 1 + cast(id % 90 AS int)) AS text",
                                       "if(id % 3 = 0, 'de', 'en') AS lang", "array(cast(id AS float), 1f) AS speaker_embedding")
    rows = docs.select("*", (F.col("doc_id") % 2).alias("shard"), F.floor(F.col("doc_id") / 2).alias("ord"))
    ids = registry.speaker_ids(rows)
    plain = packing.pack_rows(ids, "shard", "ord", limit=2000, chunk_rows=16)
    narrow = ids.withColumn("n_tok", F.size("input_ids")).drop("input_ids").localCheckpoint()
    late = packing.pack_rows(narrow, "shard", "ord", limit=2000, chunk_rows=16, len_col="n_tok", build=registry.speaker_ids)
    key = lambda r: (r["shard"], r["bin"])
    assert sorted(late.collect(), key=key) == sorted(plain.collect(), key=key) and late.count() > 4
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "input_ids" not in below and re.search("text", below)

    def built(d):
        return paths.bulk_speaker_rows(FX.with_stand_ins(d).drop("text_ids"), "doc_id", keep=[c for c in d.columns if c not in ("doc_id", "speaker_embedding")])

    corpus = paths.pack_corpus(docs, "doc_id", 2, 2, limit=2000, dim=2, build=built)
    whole = paths.pack_corpus(built(docs), "doc_id", 2, 2, limit=2000, dim=2)
    assert sorted(corpus.collect(), key=key) == sorted(whole.collect(), key=key)


def test_a_large_sealed_shard_is_many_files(spark, scratch, monkeypatch):
    import glob

    from voxloom.sources import sealed
    monkeypatch.setattr(sealed, "FILE_BYTES", 20_000)
    rows = spark.range(4000).selectExpr("id % 2 AS shard", "array_repeat(cast(id AS int), if(id % 2 = 0, 50, 1)) AS ids").coalesce(1)
    run = sealed.write_sealed(rows, scratch)
    files = {s: len(glob.glob(f"{scratch}/run={run}/shard={s}/*.parquet")) for s in (0, 1)}
    assert files[0] > 5 and files[1] >= 1
    back = sealed.read_sealed(spark, scratch, rows.schema)
    assert sorted(map(tuple, back.select("shard", "ids").collect())) == sorted(map(tuple, rows.collect()))
    assert {r["shard"]: r["n_rows"] for r in sealed.read_seals(spark, scratch).collect()} == {0: 2000, 1: 2000}


def test_frame_rows_meet_in_chunks(spark, monkeypatch):
    """Frames next to each other in different chunks, repeated rows, NULL keys and frames, empty slots: as by a join."""
    from pyspark.sql import functions as F
    from voxloom.operators import frames as FR
    monkeypatch.setattr(FR, "CHUNK_FRAMES", 4)
    monkeypatch.setattr(FR, "BATCH_CODES", 10)
    rows = [(k, f, [(f // (k + 1)) % 5, k, f, None][:4 - f % 2]) for k in range(3) for f in range(30)]
    rows += [(7, f, [f // 2, 1]) for f in range(9)] * 2 + [(None, f, [3, f]) for f in range(6)] + [(8, 0, []), (8, 1, [2]), (8, 3, [2]), (8, 4, [2, 5]), (9, -1, [4, 4]), (9, 0, [4, 1])]
    df = spark.createDataFrame(rows, "k long, frame int, slots array<int>")
    got = FR.dedupe_frame_rows(df.repartition(5), "k").collect()
    want, before = [], {}
    nxt = {}
    for k, f, s in rows:
        nxt.setdefault((k, f - 1), []).append(s[0] if s else None)
    for k, f, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        found = nxt.get((k, f), [None]) if k is not None else [None]
        for x in found:
            if s and x is not None and s[0] == x:
                continue
            want += [(k, before.get(k, 0) + j, c) for j, c in enumerate(s)]
            before[k] = before.get(k, 0) + len(s)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    frames = df.withColumn("frame", F.when(F.col("k") == 0, None).otherwise(F.col("frame"))).where("k = 0")
    assert FR.dedupe_frame_rows(frames, "k").count() == sum(len(s) for k, _, s in rows if k == 0)
    assert FR.dedupe_frame_rows(df.limit(0), "k").count() == 0
    plan = FR.dedupe_frame_rows(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "slots" not in plan  # written: no pass reads the frame rows again


def test_native_array_checks_keep_nulls(spark):
    """Counts and range checks without a lambda per value: NULL and odd arrays as before."""
    from pyspark.sql import functions as F
    from voxloom.functions import arrays as A
    rows = [([],), (None,), ([0, 4095],), ([4096, None],), ([1, None],), ([None],), ([-1, 5],), ([5, 5, None, 7],)]
    df = spark.createDataFrame(rows, "a array<int>")
    old_range, old_count = F.forall("a", lambda x: (x >= 0) & (x < 4096)), F.size(F.filter("a", lambda x: x == 5))
    got = df.select(A.codes_in_range("a").alias("r"), A.count_value("a", 5).alias("n")).collect()
    assert got == df.select(old_range.alias("r"), old_count.alias("n")).collect()
    plan = df.select(A.codes_in_range("a"), A.count_value("a", 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def pack_tables(spark, folder):
    """Documents with repeated and NULL ids and NULL texts, and vectors, one id twice."""
    docs = spark.range(400).selectExpr("if(id % 50 = 49, null, id - id % 9 % 2) AS doc_id", "if(id % 40 = 7, null, repeat(concat('w', id - id % 9 % 2, ' '), 1 + cast(id % 90 AS int))) AS text",
                                       "if(id % 3 = 0, 'de', 'en') AS lang")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.range(30).selectExpr("if(id = 3, 4, id) AS vec_id", "transform(sequence(1, 64), x -> cast(x + id AS float)) AS embedding").write.parquet(f"{folder}/embeddings.parquet")


def moved_columns(monkeypatch):
    """The columns that are joined with the vectors."""
    from voxloom.plans import fixtures as FX
    seen, join = [], FX.with_vectors
    monkeypatch.setattr(FX, "with_vectors", lambda spark, sf_dir, rows: (seen.append(rows.columns), join(spark, sf_dir, rows))[1])
    return seen


def test_bins_are_planned_without_texts(spark, scratch, monkeypatch):
    from voxloom.plans import registry
    pack_tables(spark, scratch)
    seen = moved_columns(monkeypatch)
    got = registry.packing_lengths(spark, scratch).drop("ord", "shard").collect()
    assert seen == [["doc_id", "n_tok"]]
    whole = registry.packing_input(spark, scratch)
    key = lambda r: (r["doc_id"], r["n_tok"] or -1)
    assert sorted(got, key=key) == sorted(whole.select("doc_id", "n_tok").collect(), key=key) and len(got) > 300
    places = [sorted(map(tuple, d.select("doc_id", "shard").distinct().collect())) for d in (registry.packing_lengths(spark, scratch), whole)]
    assert places[0] == places[1]


def test_rejects_are_judged_before_the_vectors(spark, scratch, monkeypatch):
    from pyspark.sql import functions as F
    from voxloom import vocab as V
    from voxloom.operators import packing
    from voxloom.plans import paths, registry
    ph = V.PLACEHOLDER
    ids = [None, [ph], [ph, None], [ph, ph], [5], [], [V.IGNORE_LABEL, 1]]
    vectors = [None, [1.0, 2.0], [1.0], [1.0, None], []]
    rows = [(len(vectors) * i + j, a, v) for i, a in enumerate(ids) for j, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, speaker_embedding array<float>")

    def joined(judged):
        assert "input_ids" not in judged.columns
        return judged.join(df.select("k", "speaker_embedding"), "k")

    for dim in (None, 2):
        whole = sorted(paths.unpackable_rows(df, "k", dim).collect())
        assert sorted(paths.unpackable_rows(df.drop("speaker_embedding"), "k", dim, vectors=joined).collect()) == whole
        ok = {r["k"] for r in df.where(packing.packable(dim=dim)).collect()}
        assert {r["k"] for r in whole} == set(range(len(rows))) - ok and len(ok) == (4 if dim is None else 2)
    pack_tables(spark, scratch)
    seen = moved_columns(monkeypatch)
    got = registry.pack_corpus_rejects(spark, scratch).collect()
    assert seen and not {"text", "input_ids"} & set(seen[0])
    want = paths.unpackable_rows(registry.bulk_built(registry.bulk_input(spark, scratch)), "doc_id", dim=64)
    want = want.groupBy("reason").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id")).collect()
    assert sorted(got) == sorted(want)


def test_a_turn_on_few_classes_moves_few_sets(spark, monkeypatch):
    from voxloom.llm import jaccard_join as J
    J.C.ready(spark)
    blob = lambda xs: bytearray(J.np.array(xs, J.np.uint64).tobytes())
    sets = spark.createDataFrame([(c, blob(range(c % 3, 10 + c % 3))) for c in range(500)] + [(None, blob([1]))], "cls long, shingles binary")
    pairs = spark.createDataFrame([(3, 6), (3, 4), (7, 7000), (None, 5)], "a long, b long")
    few, again = J.of_pairs(pairs, sets, sets)
    assert sorted(r["cls"] for r in few.collect()) == [3, 4, 5, 6, 7] == sorted(r["cls"] for r in again.collect())
    linked = sorted(J.verified(pairs, few).collect())
    monkeypatch.setattr(J, "BROADCAST_CLASSES", 0)
    assert J.of_pairs(pairs, sets)[0].count() == 501 and sorted(J.verified(pairs, sets).collect()) == linked == [(3, 4), (3, 6)]


def test_postings_of_large_groups_without_a_partner_need_no_second_look(spark):
    from voxloom.llm import jaccard_join as J
    J.C.ready(spark)
    rng = J.np.random.default_rng(7)
    for _ in range(200):
        n = rng.integers(1, rng.integers(2, 80), rng.integers(10, 40))
        p = J.np.array([rng.integers(0, J.prefix_length(int(x))) for x in n])
        want = [i >= J.FEW and any(j != i and min(n[i] - p[i], n[j] - p[j]) >= J.needed(int(n[i]), int(n[j])) for j in range(J.FEW, len(n)))
                for i in range(len(n))]
        assert J.unmet((n.astype(J.np.int64) << 31) + p).tolist() == want
    # (token, salt, cls, place): 12 copies' first shingles, 12 last ones of prefixes, 12 sets each twice the last one's size, a salted group
    groups = [(1, 0, lambda i: (20, 0)), (2, 0, lambda i: (20, 5)), (3, 0, lambda i: (1 << i, 0)), (4, 5, lambda i: (20, 5))]
    rows = [(t, salt, c, (at(c)[0] << 31) + at(c)[1]) for t, salt, at in groups for c in range(12)]
    df = spark.createDataFrame(rows, "token long, salt int, cls long, place long").coalesce(1).sortWithinPartitions("token", "salt", "cls")
    got = J.stars(df).where(f"kind = {J.POSTING}").groupBy("token").agg({"b": "sum", "a": "count"}).collect()
    assert sorted((r["token"], r["sum(b)"], r["count(a)"]) for r in got) == [(1, 10, 12), (2, 0, 12), (3, 0, 12), (4, 12, 12)]


def test_later_turns_look_only_at_groups_still_in_several_components(spark, monkeypatch):
    from itertools import permutations
    from voxloom.llm import jaccard_join as J
    sentence = lambda k: " ".join(f"s{k}w{j}" for j in range(30))
    orders = list(permutations(range(10), 3))
    texts = [" ".join(map(sentence, o)) for o in orders] + [sentence("x") + f" end{i}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, mixed = [], J.mixed_groups

    def spied(big, labels):
        out = J.C.materialize(mixed(big, labels), "test-mixed")
        seen.append((big.count(), out.count()))
        return out

    monkeypatch.setattr(J, "mixed_groups", spied)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in J.linked_documents(docs).collect()}
    least = {}
    for i, o in enumerate(orders):
        least.setdefault(frozenset(o), i)
    assert got == {i: (least[frozenset(o)], 5) for i, o in enumerate(orders)} | {len(orders) + i: (len(orders), 11) for i in range(12)}
    assert len(seen) > 1 and all(later[0] == earlier[1] for earlier, later in zip(seen, seen[1:])) and seen[0][1] < seen[0][0]


def test_component_rounds_of_few_edges_need_no_exchange(spark, monkeypatch):
    from voxloom.llm import jaccard_join as J
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(129, 200), (300, 301), (301, 300), (400, 400)]
    edges = spark.createDataFrame(path, "u long, v long").repartition(5)
    want = {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 130), 200]} | {300: 300, 301: 300}
    rounds, write = [], J.C.materialize

    def spied(df, tag):
        rounds.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(J.C, "materialize", spied)
    got = J.components(edges).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert len(rounds) > 2 and not any("Exchange" in plan for plan in rounds[1:])
    assert sorted(J.components(edges, len(path)).collect()) == sorted(got)
    rounds.clear()
    monkeypatch.setattr(J, "EDGES_PER_TASK", 10)
    assert sorted(J.components(edges).collect()) == sorted(got) and "Exchange" in rounds[1]
    assert J.components(edges.limit(0)).count() == 0
