"""Quality rules: a short-circuit cascade, all in DataFrame functions.

``measure`` times every rule and counts its rejections on a sample of bounded
size; ``cascade`` evaluates the rules in descending rejection per cost inside
one ``CASE`` expression, so a document pays only for the rules up to the first
that rejects it.  The order changes the work, never the verdict: a document is
kept if no rule rejects it.

Defined results: a null text counts as empty; repeated rows are judged one by
one; an empty table gives an empty result.  Statistics come back under an
``id_col`` and their own names only, so other columns of the input cannot
clash with them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C

WINDOW = 8
#: rows of the sample that costs and selectivities are estimated on, at most
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean expression over the columns of the frame."""
    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejection: float

    @property
    def value(self) -> float:
        return self.rejection / self.cost


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col``, ``text``, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words, without any shuffle.

    Windows of eight words are compared by a 64-bit hash built by doubling
    (1, 2, 4, 8 words); only texts in which a window hash recurs pay for the
    sort that finds how many word positions such windows cover."""

    def paired(h: str, step: int) -> Column:
        return F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("id", "text", C.words(F.col("text")).alias("w"),
                 F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(C.WS_CHARS)) != "").alias("lines"))
    d = d.select("id", "text",
                 F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    base = ["id", "text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):
        d = d.select(*base, paired("h", step).alias("h"))
    # the doubling pads the tail with partial windows: only whole ones count
    d = d.select(*base, F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))).alias("h"))
    spots = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select(*base, F.when(F.size(F.array_distinct("h")) < F.size("h"), spots).alias("s"))
    same = F.zip_with("s", F.slice("s", F.lit(2), F.size("s")),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.select(*base, F.sort_array(F.array_distinct(F.flatten(F.array_compact(same)))).alias("p"))
    # a window adds its eight words, or fewer where the next one starts sooner
    cover = F.aggregate(
        F.zip_with("p", F.slice("p", F.lit(2), F.size("p")), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(F.col("id").alias(id_col), *base[1:], F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def default_rules() -> list[Rule]:
    """Rules over ``text_stats`` columns that prose passes and junk does not."""
    def count(cls: str) -> Column:
        # few characters of prose match, so splitting costs one plain scan
        return F.size(F.split("text", cls, -1)) - 1

    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words") * 3),
        Rule("repeated_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") > F.col("n_words") * 20) | (F.col("word_chars") < F.col("n_words") * 2)),
        Rule("capitals", count(r"\p{Lu}") * 2 > F.col("word_chars")),
        Rule("exclamation", count("[!?]") * 2 > F.col("n_words")),
        Rule("letters", count(r"[^\p{L}\s]") * 2 > F.col("word_chars")),
    ]


def bounded_sample(df: DataFrame, key: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A hash-chosen sample of about ``rows`` rows, never more: it only sets
    the order of evaluation."""
    every = max(1, df.count() // rows)
    return df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).limit(rows)


def measure(sample: DataFrame, rules: list[Rule], runs: int = 2) -> list[Measured]:
    """Cost (seconds above an empty pass) and rejected share of each rule."""
    sample = sample.persist()
    try:
        rows = max(1, sample.count())

        def timed(rejects: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hit = sample.agg(F.count_if(rejects).alias("n")).first()["n"]
            return time.perf_counter() - began, hit

        empty = min(timed(F.lit(False))[0] for _ in range(runs + 1))
        out = []
        for r in rules:
            tries = [timed(r.rejects) for _ in range(runs)]
            cost = max(1e-4, min(t for t, _ in tries) - empty)
            out.append(Measured(r, cost, tries[0][1] / rows))
        return out
    finally:
        sample.unpersist()


def ordered(measured: list[Measured]) -> list[Rule]:
    return [m.rule for m in sorted(measured, key=lambda m: (-m.value, m.cost, m.rule.name))]


def cascade(df: DataFrame, rules: list[Rule], verdict: str = "rejected_by") -> DataFrame:
    """Adds ``verdict``: the name of the first rule, in the order given, that
    rejects the row, or null."""
    if not rules:
        return df.withColumn(verdict, F.lit(None).cast("string"))
    case = F.when(rules[0].rejects, rules[0].name)
    for r in rules[1:]:
        case = case.when(r.rejects, r.name)
    return df.withColumn(verdict, case)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics of ``text_stats`` (without the text), base_failed, kept and
    rejected_by (``base``, a rule's name, or null)."""
    rules = default_rules() if rules is None else rules
    stats = text_stats(docs, id_col, text_col)
    sample = bounded_sample(docs.select(id_col, text_col), F.col(id_col), sample_rows)
    order = ordered(measure(text_stats(sample, id_col, text_col), rules))
    judged = cascade(stats.withColumn("base_failed", base_failed()), [Rule("base", F.col("base_failed")), *order])
    return judged.drop("text").withColumn("kept", F.col("rejected_by").isNull())
