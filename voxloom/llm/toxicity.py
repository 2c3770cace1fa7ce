"""Toxicity: gradient-boosted trees over dense features, calibrated.

Features of the whole text: densities of a lexicon (a fixed list plus words
and word beginnings that the training fold shows to be typical of toxic
documents), how close its
words stand to second-person words, capitals, punctuation, and obfuscation
(words of the lexicon written with digits and signs).  Spark ML fits the trees
on one part of at most ``MAX_LABELLED`` labelled documents and an isotonic
regression on the rest maps their margin to a probability.

Defined results: a null or empty text has all features 0 and gets the score
the model gives to that; labels that are null are ignored, of several for one
document the highest holds; without labels of both kinds every score is the
share of label 1 (0 without labels); repeated rows are scored one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C

#: labelled documents the model is fitted on, at most
MAX_LABELLED = 12000
#: words and word beginnings added to the lexicon from the training fold, at most
MAX_LEARNED = 1000
#: bytes of a word beginning
BEGIN = 7

# fixed values
LEXICON = ("idiot idiots moron morons stupid trash worthless pathetic disgusting loser losers clown scum dumb "
           "dumbass imbecile filthy vermin jerk bastard bitch asshole retard scumbag freak crap fool").split()
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch tu te toi ton vous votre vos "
                 "usted ustedes tus vosotros ti").split()
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_PLAIN = bytes.maketrans(_UPPER + _PUNCT, bytes(range(97, 123)) + b" " * len(_PUNCT))
_LEET_FROM, _LEET_TO = b"01345789@$!", b"oieastbgasi"
_LEET = bytes.maketrans(_UPPER + bytes(c for c in _PUNCT if c not in _LEET_FROM) + _LEET_FROM,
                        bytes(range(97, 123)) + b" " * sum(c not in _LEET_FROM for c in _PUNCT) + _LEET_TO)
_MIXED = re.compile(rb"[A-Za-z][0-9@$*!][A-Za-z]")

FEATURES = ("lexicon_log", "lexicon_density", "weighted_density", "lexicon_distinct", "window_hits", "proximity",
            "second_person", "capitals", "punctuation", "exclamation", "obfuscated_log", "obfuscation", "words_log")


def terms(data: bytes) -> set[bytes]:
    """Distinct words of a text, and the beginnings of longer ones (``*``)."""
    words = set(data.translate(_PLAIN).split())
    return words | {w[:BEGIN] + b"*" for w in words if len(w) > BEGIN}


def features(text: str | None, weights: dict[bytes, float], second: frozenset[bytes]) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    plain = data.translate(_PLAIN).split()
    n = len(plain)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(plain) if w in weights or (len(w) > BEGIN and w[:BEGIN] + b"*" in weights)]
    persons = [i for i, w in enumerate(plain) if w in second]
    close = 0.0
    if hits and persons:
        at = np.searchsorted(persons, hits)
        p = np.array(persons)
        left = np.where(at > 0, np.array(hits) - p[np.maximum(at - 1, 0)], 1 << 30)
        right = np.where(at < len(p), p[np.minimum(at, len(p) - 1)] - np.array(hits), 1 << 30)
        close = 1.0 / (1 + int(np.minimum(left, right).min()))
    window = 0
    if hits:
        h = np.array(hits)
        window = int((np.searchsorted(h, h + 30, "left") - np.arange(len(h))).max())
    hidden = sum(w in weights for w in data.translate(_LEET).split()) - sum(w in weights for w in plain)
    letters = len(data) - len(data.translate(None, _LETTERS))
    upper = len(data) - len(data.translate(None, _UPPER))
    punct = len(data) - len(data.translate(None, _PUNCT))
    return [math.log1p(len(hits)), 100 * len(hits) / n, 100 * sum(weights.get(plain[i]) or weights[plain[i][:BEGIN] + b"*"] for i in hits) / n,
            float(len({plain[i] for i in hits})), float(window), close, 100 * len(persons) / n,
            upper / max(1, letters), punct / n, data.count(b"!") / n, math.log1p(max(0, hidden)),
            100 * len(_MIXED.findall(data)) / n, math.log1p(n)]


def with_features(docs: DataFrame, lexicon: dict[bytes, float], keep: list[str], text_col: str) -> DataFrame:
    """``keep`` columns and ``features`` (array of double)."""
    C.ready(docs.sparkSession)
    weights = dict(lexicon)
    second = frozenset(w.encode() for w in SECOND_PERSON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([features(t.as_py(), weights, second) for t in b.column(b.num_columns - 1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], f], [*keep, "features"])

    d = docs.select(*keep, F.col(text_col).alias("text_to_score"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(run, schema + ", features array<double>")


def learned_lexicon(rows: DataFrame, most: int = MAX_LEARNED) -> dict[bytes, float]:
    """Words and word beginnings that far more toxic than other training
    documents hold: at least 0.5 % of the toxic ones (five at least), with a
    log-odds of 3 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(terms((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["label", "terms"])

    by = rows.select("label", "text").mapInArrow(run, "label int, terms array<binary>").select("label", F.explode("terms").alias("term"))
    by = by.groupBy("term").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    totals = rows.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    p, n = totals["p"] or 0, totals["n"] or 0
    if not p or not n:
        return {}
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    top = by.where(F.col("pos") >= max(5, 0.005 * p)).withColumn("odds", odds).where("odds >= 3").orderBy(
        F.desc(F.col("pos") * F.col("odds")), "term").limit(most).collect()
    return {bytes(r["term"]): float(r["odds"]) for r in top}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_labelled: int = MAX_LABELLED, trees: int = 20, depth: int = 3) -> DataFrame:
    """``id_col``, held_out, score, predicted.  ``labels``: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = d.join(F.broadcast(known), "id").dropDuplicates(["id"]).persist()
    try:
        lexicon = dict.fromkeys((w.encode() for w in LEXICON), 3.0) | learned_lexicon(train)
        rows = C.materialize(with_features(train, lexicon, ["id", "label"], "text"), "toxic-train")
    finally:
        train.unpersist()
    rows = rows.select("label", array_to_vector("features").alias("features"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("calibrate"))
    seen = {(r["calibrate"], r["label"]): r["count"] for r in rows.groupBy("calibrate", "label").count().collect()}
    positive = sum(n for (_, y), n in seen.items() if y == 1)
    total = sum(seen.values())
    if len(seen) < 4:
        score = F.lit(positive / total if total else 0.0)
        scored = d.select("id", score.alias("score"))
    else:
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7,
                              predictionCol="tree_class").fit(rows.where(~F.col("calibrate")))
        iso = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(
            model.transform(rows.where("calibrate")).select(vector_to_array("probability")[1].alias("margin"), F.col("label").cast("double")))
        full = with_features(d, lexicon, ["id"], "text").select("id", array_to_vector("features").alias("features"))
        full = model.transform(full).select("id", vector_to_array("probability")[1].alias("margin"))
        scored = iso.transform(full).select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
    return scored.select(F.col("id").alias(id_col), C.held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
