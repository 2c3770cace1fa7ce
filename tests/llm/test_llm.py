"""The training-data operators against brute force, round trips and held-out
labels, with the defined results for odd input."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import (ann, chat, jaccard_join, mixing, packing, pii, quality_model, quality_rules, queries, token_counts,
                         toxicity)
from voxloom.llm.word_bpe import WordBpe

SF = "/root/testdata/sf0.001"
BPE = f"{queries.TOKENIZERS}/word_bpe_49k.json"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of green herbs and old silver coins near a quiet river "
ODD = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, " \n\t", None, "b", 3), (None, "one two", "en", "a", 7),
       (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (5, PROSE * 3, "en", "a", 1), (6, "word " * 30000, "en", "c", 1),
       (7, "x" * 200_000, "en", None, 1), (8, "9" * 50_000 + "@" * 100, "en", "b", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("SIZE_", F.lit(1)).withColumn("kept", F.lit("mine"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- quality rules --------------------------------------------------------------

def stats_of(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark, odd):
    both = sample(spark).select("doc_id", "text").union(odd.select("doc_id", "text")).union(
        spark.createDataFrame([(99, "a b c d e f g h a b c d e f g h i " + "a b c d e f g h"), (98, "é x\r\né x\r\n\n\nb c")], "doc_id long, text string"))
    got = quality_rules.text_stats(both).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got.collect():
        assert tuple(r)[1:] == stats_of(r["text"]), r["text"][:80]


def test_quality_verdicts_and_order(spark, odd, empty):
    got = quality_rules.quality_rules(sample(spark))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])
    rejected = [not r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(rejected) > 0.9
    assert got.count() == sample(spark).count()
    assert quality_rules.quality_rules(odd).count() == len(ODD)
    assert quality_rules.quality_rules(empty).count() == 0
    cheap, dear = quality_rules.Rule("a", F.lit(True)), quality_rules.Rule("b", F.lit(True))
    order = quality_rules.ordered([quality_rules.Measured(dear, 10.0, 0.5), quality_rules.Measured(cheap, 0.1, 0.1)])
    assert [r.name for r in order] == ["a", "b"]


# -- neighbours -----------------------------------------------------------------

def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((20, 16))
    v = (centers[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)
    v[1000:2000] = v[0]  # a third of all rows equal
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16),
                                                         (5150, [None] * 16), (5200, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    u = v.astype(np.float64)
    n = np.sqrt((u * u).sum(1))
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 3000, 50))
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        cos = u @ u[q] / (n * n[q])
        cos[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(cos, 12)))[:5]
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5]
        assert np.allclose([r["score"] for r in rs], [cos[r["vec_id"]] for r in rs], atol=1e-12)
        hits += len({r["vec_id"] for r in rs} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.95
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]
    assert ann.nearest(df.where("vec_id = 5000"), F.lit(True)).count() == 0


def test_neighbours_over_many_leaves(spark, monkeypatch):
    """Recall of the walk from leaf to leaf: no clusters, 40 leaves."""
    monkeypatch.setattr(ann, "LEAF_ROWS", 100)
    rng = np.random.default_rng(12)
    v = rng.standard_normal((4000, 24))
    built = []
    tree = ann.KdTree
    monkeypatch.setattr(ann, "KdTree", lambda *a: built.append(tree(*a)) or built[-1])
    got = ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    u = v / np.sqrt((v * v).sum(1))[:, None]
    cos = u[::50] @ u.T
    cos[np.arange(80), np.arange(0, 4000, 50)] = -9
    true = np.argsort(-cos, axis=1)[:, :5]
    rows = got.collect()
    assert len(built[0].low) >= 20 and len(rows) == 400
    hits = sum(r["vec_id"] in true[r["query_id"] // 50] for r in rows)
    assert hits / 400 >= 0.9


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(13)
    v = rng.standard_normal((100, 8)).tolist()
    rows = list(enumerate(v)) + [(0, v[0])] * 6 + [(3, v[3])] + [(50, v[51]), (50, v[52])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    distinct = sorted({(i, tuple(x)) for i, x in rows})
    for q in (0, 50):
        want = []
        for own in [x for i, x in distinct if i == q]:
            a = np.array(own)
            others = [(-round(float(a @ b / np.sqrt((a @ a) * (np.array(b) @ np.array(b)))), 9), i) for i, b in distinct if (i, b) != (q, own)]
            want += [(r + 1, i) for r, (_, i) in enumerate(sorted(others)[:5])]
        assert sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q) == sorted(want)


def test_chi_square():
    assert abs(ann.chi_square_cdf(ann.chi_square_quantile(0.98)) - 0.98) < 1e-9
    assert abs(ann.chi_square_quantile(0.95) - 15.507) < 1e-3


# -- packing ----------------------------------------------------------------------

def test_word_bpe_equals_the_tokenizer(spark):
    bpe = WordBpe.load(BPE)
    texts = [r["text"] for r in sample(spark).limit(150).collect()]
    texts += ["It's <|endoftext|> ok", "naïve ½ Ⅷ 'S don't I'LL 12a3 _x__ \x1c á İ", "µ ª", "A'S b'ß '' 'll", "ÀÉ×÷ \x85 \xa0", "", "日本 x", "é"]
    for t in texts:
        assert bpe.encode(t).tolist() == bpe.whole.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, odd, empty):
    docs = sample(spark)
    rows = packing.pack_documents(docs, BPE, keep_ids=True).collect()
    bpe = WordBpe.load(BPE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    parts = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        parts.setdefault(r["doc_id"], []).append(r)
    for d, t in texts.items():
        ps = sorted(parts[d], key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in ps])
        assert ids.tolist() == bpe.whole.encode(t, add_special_tokens=False).ids + [0]
        assert [p["start"] for p in ps] == [2048 * i for i in range(len(ps))] and all(p["length"] == 2048 for p in ps[:-1])
    check_sequences(rows)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) * 1.01 + 1
    check_sequences(packing.pack_documents(odd, BPE).collect())
    assert packing.pack_documents(empty, BPE).count() == 0


def test_sequences_hold_the_ids(spark, odd, empty):
    import corpus_pipeline
    docs = sample(spark).unionByName(odd.drop("SIZE_", "kept"))
    plain = packing.pack_documents(docs, BPE, keep_ids=True).cache()
    seqs = packing.sequences(plain).cache()
    got = packing.pieces_of(seqs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.select(*got.columns).collect()))
    short = packing.sequences(packing.pack_documents(docs, BPE, keep_ids=True, id_bytes=2), id_bytes=2)
    assert sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in packing.pieces_of(short).collect()) == sorted(
        (r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in plain.collect())
    for s in seqs.collect():
        assert len(s["ids"]) == 4 * sum(p["length"] for p in s["pieces"]) <= 4 * 2048
    assert packing.pieces_of(packing.sequences(packing.pack_documents(empty, BPE, keep_ids=True))).count() == 0
    last = corpus_pipeline.pack(spark, sample(spark), SF).collect()
    assert last and all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in last)
    assert any("voxloom-packed-" in f for f in queries.op3_best_fit_packing(spark, SF).inputFiles())


def check_sequences(rows):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 2048


def test_configuration_program():
    rng = np.random.default_rng(0)
    for n in (1, 50, 5000):
        hist = {int(k): int(c) for k, c in zip(*np.unique(rng.integers(1, 2049, n), return_counts=True))}
        configs = packing.solve(hist)
        got = {}
        for conf, c in configs:
            assert sum(conf) <= 2048 and c > 0
            for s in conf:
                got[s] = got.get(s, 0) + c
        assert got == hist
    assert packing.solve({}) == []


def exact_cover(lengths, capacity):
    """Fewest bins, by search over the bins that the largest piece may go in."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_covering_program_is_feasible_and_bounded():
    """The amounts cover the demand; bound <= exact optimum <= packed; the gap is small."""
    rng = np.random.default_rng(5)
    for trial in range(12):
        cap = int(rng.integers(20, 60))
        lengths = rng.integers(1 if trial % 2 else cap // 4, cap, 11)
        demand = np.bincount(lengths, minlength=cap + 1)
        p = packing.covering_program(demand, cap)
        cover = np.zeros(cap + 1)
        for c, x in p.amounts.items():
            assert sum(c) <= cap and x > 0
            np.add.at(cover, list(c), x)
        assert (cover >= demand - 1e-6).all() and abs(sum(p.amounts.values()) - p.value) < 1e-6
        best = exact_cover(lengths.tolist(), cap)
        used = sum(k for _, k in packing.solve(dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)))), cap))
        assert p.bound <= best + 1e-9 and best <= used <= best + 1 and p.bound <= p.value <= 1.1 * p.bound
    for lengths in (rng.integers(1, 2048, 3000), rng.choice([900, 600, 500, 410], 3000), rng.integers(700, 1400, 5000)):
        p = packing.covering_program(np.bincount(lengths, minlength=2049), 2048)
        assert p.value <= 1.06 * p.bound
    # three lengths that best fit decreasing packs badly
    few = dict(zip(*map(np.ndarray.tolist, np.unique(rng.choice([900, 600, 500, 410], 3000), return_counts=True))))
    demand = np.bincount(np.repeat(list(few), list(few.values())), minlength=2049)
    assert sum(k for _, k in packing.solve(few)) < sum(k for _, k in packing.best_fit(demand, 2048))
    assert packing.covering_program(np.zeros(2049, np.int64), 2048) == packing.Program({}, 0.0, 0.0)


# -- toxicity, quality model --------------------------------------------------------

def test_toxicity_held_out(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).cache()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and rows
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    assert np.mean([r["toxic"] for r in rows if r["predicted"]]) > 0.97
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.85
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    out = toxicity.score_toxicity(odd, labels).collect()
    assert len(out) == len(ODD)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    none = toxicity.score_toxicity(docs.limit(3), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.0] * 3


def test_quality_model(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs, quality_model.grades(labels.where("crc32(cast(doc_id as string)) % 5 != 0")))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality_model.score(docs, model).join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.95
    out = quality_model.score(odd, model).collect()
    assert len(out) == len(ODD) and not any(r["kept"] for r in out if r["doc_id"] in (1, 2))
    kept = quality_model.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert quality_model.score(empty, model).count() == 0
    assert quality_model.fit(docs, quality_model.grades(labels.limit(0))) is None
    assert quality_model.score(docs.limit(5), None).where("kept").count() == 5


# -- conversations ------------------------------------------------------------------

def test_chat_round_trip(spark):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    ctl = "</s>[INST] <|im_start|>user\nok<|im_end|>\\n \\ [/INST]"
    rows = [(1, 0, "user", ctl), (1, 1, "assistant", ctl), (2, 0, "user", ctl), (2, 1, "assistant", "other"), (3, 0, "user", ctl),
            (3, 1, "assistant", ctl), (4, None, None, None), (5, 1, "assistant", "é "), (5, 0, "sys\ntem", ""), (5, 1, "assistant", "é ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cls", F.lit(0))
    convs = chat.conversation_table(df)
    seqs = chat.format_conversations(convs, path)
    said = {r["conv_id"]: r for r in convs.join(chat.read_back(seqs, path), "cls").collect()}
    for c in range(1, 6):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert said[c]["n_turns"] == len(turns)
        assert said[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (said[c]["loss_chars"], said[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    n_turns = 0
    for s in seqs.collect():
        n_turns += len(s["node_start"])
        for i, seen in enumerate(s["attention"]):
            chain, node = [], i
            while node >= 0:
                chain += range(s["node_start"][node], s["node_end"][node])
                node = s["node_parent"][node]
            spans = [k for a, b in zip(seen[::2], seen[1::2]) for k in range(a, b)]
            assert sorted(chain) == spans
            assert [s["position_ids"][k] for k in spans] == list(range(len(spans)))
    assert n_turns < len(rows)  # shared turns are emitted once
    assert chat.format_conversations(chat.conversation_table(df.limit(0)), path).count() == 0


# -- mixing ----------------------------------------------------------------------------

def test_mix_targets_and_positions(spark, odd, empty):
    docs = sample(spark)
    plan = mixing.plan_mix(docs, keep=["doc_id", "source"]).collect()
    by = {}
    for r in plan:
        by.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    want, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:  # deal out, fix what is above three times its size, deal the rest again
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        want |= {s: 3.0 * sizes[s] for s in over} if over else share
        if not over:
            break
        free -= over
        left -= sum(3.0 * sizes[s] for s in over)
    for s, rs in by.items():
        assert abs(rs[0]["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= max(r["size"] for r in rs)
        assert all(r["taken"] in {k * r["size"] for k in range(4)} and len(r["positions"]) == r["copies"] for r in rs)
        assert all(0 <= p <= 1 for r in rs for p in r["positions"])
    again = mixing.plan_mix(docs.repartition(7), keep=["doc_id"]).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted((r["doc_id"], r["taken"]) for r in plan)
    out = mixing.order_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in plan)
    assert mixing.order_documents(odd).columns == odd.columns
    assert mixing.plan_mix(empty).count() == 0


def test_mix_plan_is_counted_in_the_written_corpus(spark, odd, empty):
    both = sample(spark).unionByName(odd.drop("SIZE_", "kept"))
    copies, plan = mixing.mixed_corpus(both)
    want = mixing.plan_mix(both).select("doc_id", "size", "taken").collect()
    rows = plan.collect()
    assert sorted(map(str, ((r["doc_id"], r["size"], r["taken"]) for r in rows))) == sorted(map(str, map(tuple, want)))
    assert all((r["first_position"] is None) == (r["taken"] == 0) for r in rows)
    written = copies.collect()
    texts = {r["text"] for r in both.collect()}
    assert sum(r["size"] for r in written) == sum(r["taken"] for r in rows) > 0
    assert {r["in_1"] for r in written} <= texts and all(len(WORD.findall(r["in_1"])) == r["size"] for r in written)
    assert mixing.mixed_corpus(empty)[1].count() == 0
    op6 = queries.op6_mixing(spark, SF)
    assert any("voxloom-mixed-" in f for f in op6.inputFiles())


def test_training_time_inverts_the_schedule(spark):
    for sched in mixing.SCHEDULES:
        got = spark.range(0, 101).select(mixing.training_time(F.col("id") / 100, sched).alias("t")).collect()
        ts = np.array([r["t"] for r in got])
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, np.linspace(0, 1, len(sched)), sched)
        cum = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(ts, grid, cum / cum[-1]), np.arange(101) / 100, atol=1e-4)


# -- Jaccard join -------------------------------------------------------------------------

def components_of(texts):
    sets = {}
    for i, t in texts.items():
        w = [x.encode().lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("bound", [jaccard_join.BROADCAST_CLASSES, 0])
def test_jaccard_components(spark, empty, monkeypatch, bound):
    monkeypatch.setattr(jaccard_join, "BROADCAST_CLASSES", bound)
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    base = rng.choice(vocab, 60).tolist()
    texts = {}
    for i in range(120):  # a large group of copies with one to four edits
        w = list(base)
        for _ in range(int(rng.integers(1, 5))):
            w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    passage = " ".join(rng.choice(vocab, 50))
    for i in range(200, 260):  # a passage in otherwise different documents
        texts[i] = passage + " " + " ".join(f"p{rng.integers(0, 10**6)}" for _ in range(40))
    texts |= {300: "a b c", 301: "A  b\tc", 302: "a b d", 303: "", 304: None, 305: " \n", 306: "a b c d e", 307: "a b c d e f", 308: base and " ".join(base).upper()}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").withColumn("cls", F.lit(1)).withColumn("rep", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(df).collect()}
    assert got == components_of(texts)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(df.union(df.limit(3))).collect()}
    assert kept == {c for _, c in got.values()}
    assert jaccard_join.similarity_components(empty).count() == 0


def test_jaccard_keeps_links_between_sets_of_different_size(spark):
    """Copies with words added: the shorter set's prefix may end after the longer one's."""
    rng = np.random.default_rng(11)
    texts = {}
    for i in range(300):
        w = [f"w{i}x{j}" for j in range(int(rng.integers(20, 80)))]
        more = [f"m{i}x{j}" for j in range((len(w) - 4) // 3)]  # just at the threshold
        texts[2 * i], texts[2 * i + 1] = " ".join(w), " ".join(w + more)
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_components(df).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_keep_one_with_ids_that_repeat_with_other_texts(spark):
    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(5, text("a")), (5, text("b")), (5, text("b")), (6, text("b") + " z"), (7, text("c")), (8, text("c") + " z"), (8, text("d")),
            (9, text("a") + " z"), (10, ""), (10, text("e")), (None, text("a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, map(tuple, jaccard_join.keep_one(df).collect())))
    want = [(5, text("a")), (5, text("b")), (7, text("c")), (8, text("d")), (10, ""), (10, text("e")), (None, text("a"))]
    assert kept == sorted(map(str, want))
    assert kept == sorted(map(str, map(tuple, jaccard_join.keep_one(df.repartition(7)).collect())))


def test_jaccard_enumerates_the_links_inside_components(spark, odd, empty):
    """120 near copies, a class of equal texts among them, and some that link with few of the others."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(int(rng.integers(1, 3))):
            w[int(rng.integers(0, 100))] = f"e{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    texts |= {200: texts[0], 201: texts[0].upper(), 300: "a b c", 301: "A b c", 302: "", 303: None, 304: "alone in the world here now"}
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    linked = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in jaccard_join.linked_documents(df).collect()}
    assert {i: r["n_links"] for i, r in rows.items()} == {i: sum(a == i for a, _ in linked) for i in texts}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == components_of(texts)
    assert len(linked) > 2000
    assert jaccard_join.linked_documents(odd).count() == len(ODD)
    assert jaccard_join.linked_documents(empty).count() == 0


def test_jaccard_links_of_rows_without_an_id(spark):
    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(1, text("a")), (None, text("a") + " z"), (3, text("a") + " y"), (None, text("a")), (None, text("b")), (None, text("b") + " z"),
            (4, "lone words without any partner in the table"), (5, text("a") + " z"), (None, None)]
    got = jaccard_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(str((r["doc_id"], r["component_id"], r["n_links"])) for r in got if r["n_shingles"])
    assert found == sorted(map(str, [(1, 1, 4), (None, 1, 4), (3, 1, 4), (None, 1, 4), (5, 1, 4), (None, None, 1), (None, None, 1), (4, 4, 0)]))
    assert [(r["component_id"], r["n_links"]) for r in got if not r["n_shingles"]] == [(None, 0)]


def test_sketches_share_a_token_where_sets_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 200))).astype(np.uint64))
        b = a.copy()
        b[rng.random(len(b)) < 0.14] = 1
        b = np.unique(b)
        if jaccard_join.linked(a, b):
            for order in (2, 3):
                assert len(np.intersect1d(jaccard_join.sketch(a, order), jaccard_join.sketch(b, order)))


def test_jaccard_odd_rows(spark, odd):
    rows = jaccard_join.similarity_components(odd).collect()
    assert len(rows) == len(ODD) and jaccard_join.keep_one(odd).columns == odd.columns


# -- token counts -----------------------------------------------------------------------------

def test_trie_counts_equal_plain_counts(spark, odd, empty):
    path = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
    model = token_counts.Unigram.load(path)
    docs = sample(spark).select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id != 7 or doc_id is null"))

    def plain(word):
        best, count = [0.0], [0]
        model.extend(token_counts.MARK + word, best, count, 0)
        return count[-1]

    memo = {}
    got = sorted(map(tuple, token_counts.count_tokens(docs, path).collect()), key=repr)
    want = []
    for d, t in docs.collect():
        w = WORD.findall(t or "")
        for x in set(w) - memo.keys():
            memo[x] = plain(x)
        want.append((d, len(w), sum(memo[x] for x in w)))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, path).count() == 0


# -- personal data ------------------------------------------------------------------------------

def base_spans(text):
    out = []
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
             "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, pattern in plain.items():
        for m in re.finditer(pattern, text or ""):
            v = m.group()
            d = [int(c) for c in v if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in v.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c%d@e.fg x@y", "mail é.x@host.example.com, a@b..c", "1.2.3.4.5.6.7.8 and 256.1.1.1 0.0.0.0 001.002.003.255",
          "4111 1111 1111 1111 and 4111-1111-1111-1111-4 4111111111111112", "+1 (017) 555-7713 and +4930123456 +1 2", "++1 222 333 4444 5",
          "𝒳𝒴 a@b.co 𝒳 10.0.0.1", "+1 (487) 555-7209 4736962573099581 tail", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x']


def test_personal_data_base_spans(spark, odd, empty):
    docs = sample(spark).select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id != 8")).union(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    found = pii.find_pii(docs, ["doc_id", "text"])
    for r in found.collect():
        base = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]]
        assert base == base_spans(r["text"]), (r["text"] or "")[:80]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert spans == sorted(spans) and {(pii.KINDS.index(k), a, b) for k, a, b in base} <= set(spans)
    assert pii.find_pii(empty).count() == 0
    assert pii.find_pii(odd).count() == len(ODD)


def test_redaction(spark, odd):
    text = "write to bob@mail.example.com or 97.51.17.173 now"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "clean text", "z")], "doc_id long, text string, pii_cand string")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] == "write to [EMAIL] or [IP] now" and got[2]["text"] is None and got[3]["text"] == "clean text"
    assert got[1]["pii_cand"] == "x" and pii.redact(df).columns == df.columns
    assert pii.redact(odd).columns == odd.columns


def test_long_and_base64_secrets(spark):
    rng = np.random.default_rng(4)

    def key(n, more=""):
        return "A1b" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more), n - 3))

    secrets = [key(128), key(129), key(400), key(44, "+/") + "==", "/" + key(63, "+/"), "eyJhbGciOiJSUzI1NiJ9." + key(300, "_-") + "." + key(342, "_-"),
               "eyJhbGciOiJSUzI1NiJ9." + key(20) + "." + key(22), "".join(rng.choice(list("0123456789abcdef"), 256))]
    shapes = ["token: {} and more", "secret key={}, then", "Authorization: Bearer {}", 'password = "{}"']
    texts = [(i, shapes[i % 4].format(s), s) for i, s in enumerate(secrets * 4)]
    df = spark.createDataFrame(texts, "doc_id long, text string, secret string")
    for r in pii.find_pii(df, ["text", "secret"]).collect():
        at = r["text"].index(r["secret"])
        spans = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]]
        assert any(k == "secret" and a <= at and b >= at + len(r["secret"]) for k, a, b in spans), (r["text"][:60], spans)
    assert not [r for r in pii.redact(df).collect() if r["secret"][-20:] in r["text"] or r["secret"][:20] in r["text"]]
    local = "x" * 80
    spoken = spark.createDataFrame([(1, f"mail 1 {local} [at] {local} [dot] photography")], "doc_id long, text string")
    hit = pii.with_candidates(spoken, [], "text", "cand").first()["cand"]
    assert [(c["start"], c["end"]) for c in hit if c["kind"] == 0] == [(7, 7 + 80 + 6 + 80 + 18)]
    long = spark.createDataFrame([(1, "1a" * 100_000 + "=" * 100_000 + " 1" + "a.b/c" * 60_000 + " eyJ" + "a.." * 60_000)], "doc_id long, text string")
    assert pii.find_pii(long).count() == 1


def test_free_spans_equal_all_pairs(spark):
    """One pass forward and one back drop what comparing all pairs drops."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        room = int(rng.integers(5, 200))
        def spans(n):
            out = []
            for _ in range(n):
                a = int(rng.integers(0, room))
                out.append((int(rng.integers(0, 5)), a, a + int(rng.integers(1, 12)), 0.5))
            return sorted(set(out))
        rows.append((i, spans(int(rng.integers(0, 12))), spans(int(rng.integers(0, 15)))))
    big = [(4, 3 * j, 3 * j + 2 + j % 2 * 2, 0.5) for j in range(3000)]
    rows.append((300, [(0, 9 * j + 1, 9 * j + 3, 1.0) for j in range(900)], big))
    df = spark.createDataFrame(rows, f"i int, base array<{pii._SPAN}>, extra array<{pii._SPAN}>")
    got = {r["i"]: sorted(map(tuple, r["f"])) for r in df.select("i", pii.free_spans(F.col("base"), F.col("extra")).alias("f")).collect()}
    for i, base, extra in rows:
        hit = lambda e, b: b[1] < e[2] and e[1] < b[2]
        want = [e for k, e in enumerate(extra) if not any(hit(e, b) for b in [*base, *extra[:k]])]
        assert got[i] == want, i


def test_many_spans_in_one_text(spark):
    """Redaction of 60,000 spans in one text, equal to the pieces put together by hand."""
    import time
    mail, words = "bob.{}@mail.example.com", "write to 𝒳 "
    text = "".join(words + mail.format(j) + " or 97.51.17.173 now\n" for j in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "x" * 700 + " a@b.co " + "é" * 600)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got[1] == (words + "[EMAIL] or [IP] now\n") * 30_000
    assert got[2] == "x" * 700 + " [EMAIL] " + "é" * 600
    assert time.time() - began < 60


def test_span_features_enter_the_classifier():
    """Spans with the same votes are told apart by what the features say of other votes."""
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.5
    rows = {}
    for t in truth:
        votes = tuple(int(t if rng.random() < a else not t) for a in (0.9, 0.9, 0.85)) + (-1, -1)
        feats = (int(t), 0, int(rng.random() < 0.5), 0, 1)
        rows[(0, *votes, *feats)] = rows.get((0, *votes, *feats), 0) + 1
    w = pii.fit([(*k, n) for k, n in rows.items()]).weights[0]
    assert len(w) == 1 + 2 * pii.N_LABELERS + len(pii.FEATURES)
    assert w[11] > 0.3 and abs(w[13]) < 0.1


def test_label_model_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.8, 0.6, 0.55)], 1)
    rows = {}
    for v in map(tuple, votes.tolist()):
        rows[v] = rows.get(v, 0) + 1
    model = pii.fit([(0, *v, n) for v, n in rows.items()])
    acc = [a - b for a, b in model.accuracy[0]]
    assert acc[0] > acc[2] > acc[3] and abs(model.prior[0] - 0.6) < 0.05
    assert json.dumps(model.weights[1]) == json.dumps([0.0] * 11)


# -- the pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = sample(spark)
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good, unique, clean, mixed, packed = seen
    comp = components_of({r["doc_id"]: r["text"] for r in good.collect()})
    assert {r["doc_id"] for r in unique.collect()} == {c for _, c in comp.values()}
    assert clean.count() == unique.count()
    assert not [r for r in clean.collect() if base_spans(r["text"])]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
    check_sequences(packed.collect())
