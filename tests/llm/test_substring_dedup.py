"""Removal of repeated passages against brute force, with odd rows."""

import re

import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import substring_dedup as dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k:k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone[k:k + window] = [True] * window
        spans, at = [], 0
        while at < len(w):
            end = at
            while end < len(w) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = max(end, at + 1)
        out.append((i, len(w), tuple(spans), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def found(spark, rows, window, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    if extra:
        df = df.withColumn("block", F.lit("x")).withColumn("KEPT_TEXT", F.lit("y"))
    got = dedup.remove_repeats(df, window=window).collect()
    return sorted(((r["doc_id"], r["n_words"], tuple((s["start"], s["end"]) for s in r["removed"]), r["kept_text"]) for r in got), key=repr)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    passages = [[f"p{k}w{rng.integers(0, 40)}" for _ in range(rng.integers(5, 60))] for k in range(6)]
    rows = []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(0, 80))]
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, 6)]
            a = rng.integers(0, len(w) + 1)
            lo = rng.integers(0, 5)
            w[a:a] = p[lo:len(p) - rng.integers(0, 5)]
        rows.append((int(i) if i % 3 else 7 * i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    return rows


ODD = [(None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h i j k l"),
       (4, "a b c d e f g h i j k l"), (5, "x a b c d e f g h i j k l y"), (5, "x"), (6, "word " * 40_000), (8, "word " * 200), (9, "é f " * 30),
       (10, "é f " * 30), (11, "A b c d e f g h i j k l")]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(1) + ODD + [(1000 + i, "same words here again and again " * 4) for i in range(60)]
    for windows in (2_000_000, 300):  # one block, and many
        monkeypatch.setattr(dedup, "BLOCK_WINDOWS", windows)
        monkeypatch.setattr(dedup, "PIECE", 4)
        assert found(spark, rows, 10, extra=True) == brute(rows, 10)


def test_shortest_passage_and_touching_intervals(spark):
    p, q = [f"p{i}" for i in range(50)], [f"q{i}" for i in range(50)]
    rows = [(1, " ".join(p + ["x"] + q)), (2, " ".join(["y"] + p + q + ["z"])), (3, " ".join(p[:49])), (4, " ".join(["m"] + p[1:] + ["n"]))]
    got = found(spark, rows, 50)
    assert got == brute(rows, 50)
    assert got[1] == (2, 102, ((1, 101),), "y z")
    assert got[2][2] == got[3][2] == ()


def test_empty_table(spark):
    assert found(spark, [], 50) == []
    assert found(spark, [(None, "a b")], 50) == [(None, 2, (), "a b")]


def test_packed_hashes_round_trip():
    x = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (dedup.unpacked(dedup.packed(x)) == x).all()


def test_rolled_hash_follows_the_words():
    w = np.random.default_rng(4).integers(0, 1 << 62, 500).astype(np.uint64)
    w[300:360] = w[100:160]
    h = dedup.rolled(w, 50)
    assert (h[100:111] == h[300:311]).all()
    assert len(np.unique(h)) == len(h) - 11
    assert len(dedup.rolled(w[:49], 50)) == 0
