"""Mixing sources to target weights along a curriculum.

Targets: every source has a weight; the mix is as large as the corpus; a
source is never repeated more than ``max_repeats`` times, and what it cannot
take is dealt to the others by weight (closed form over sources sorted by
capacity per weight).  A source whose target is r times its size is read
floor(r) whole times, and once more up to the remaining words in a fixed
pseudo-random order (md5 of the document id).

Curriculum: each source has a piecewise-linear weight schedule over training
time in [0, 1].  Its integral is the source's cumulative demand; the words of
its documents, copy after copy, lie along that demand, and inverting it at a
copy's middle word gives the copy's training position.  ``order_documents``
range-sorts by position.

Running totals are taken inside (source, first md5 byte) buckets on top of
bucket totals, so a source with a third of all rows is spread over 256 windows.

Defined results: null source is a source of its own, last in order; a null
text has size 0 and is taken 0 words (and no copies); rows that repeat an id
each count and are ordered by size after their id; an empty table gives an
empty result.  A target is 0 where the corpus or a source has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm import common as C

MAX_REPEATS = 3
#: relative weight at equidistant times 0, 1/4, .. 1; sources take them in turn
SCHEDULES = ((1.0, 1.0, 1.0, 1.0, 1.0), (0.4, 0.7, 1.0, 1.3, 1.6), (1.6, 1.3, 1.0, 0.7, 0.4))


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From rows (src_null, src, size): one row per source with source_size,
    rank (code-point order, null last) and target."""
    s = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    s = s.select("*", F.row_number().over(Window.orderBy("src_null", "src")).alias("rank"),
                 F.sum("source_size").over(everything).alias("total"))
    s = s.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    s = s.withColumn("ratio", cap / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the water level is that of the first source that it does not drown
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("water").isNull(), cap).otherwise(F.least(cap, F.col("water") * F.col("weight")))
    return s.select("src_null", "src", "source_size", "rank", target.alias("target"))


def _segments(schedule: tuple[float, ...]) -> list[tuple[float, float, float, float, float]]:
    """(start time, width, weight at start, weight at end, share before) of
    each linear piece, normalised so that the whole integral is 1."""
    w = 1.0 / (len(schedule) - 1)
    whole = sum((a + b) / 2 * w for a, b in zip(schedule, schedule[1:]))
    out, before = [], 0.0
    for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
        out.append((i * w, w, a / whole, b / whole, before))
        before += (a + b) / 2 * w / whole
    return out


def training_time(share: Column, schedule: tuple[float, ...]) -> Column:
    """Time at which a source with ``schedule`` has delivered ``share`` (0..1)
    of its words: the inverse of the schedule's integral."""
    out = None
    for t0, w, a, b, before in reversed(_segments(schedule)):
        x = F.greatest(share - before, F.lit(0.0))
        slope = (b - a) / w
        # slope/2 d^2 + a d = x, in the form that stays stable as slope goes to 0
        d = 2 * x / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * x, F.lit(0.0))))
        t = F.lit(t0) + F.least(d, F.lit(w))
        out = t if out is None else F.when(share < nxt, t).otherwise(out)
        nxt = before
    return out


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             keep: list[str] | None = None, max_repeats: int = MAX_REPEATS,
             schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """``keep`` columns (default: the id), size, source_size, target, taken,
    copies, positions (training time of each copy), and the source's rank with
    the words of it that come before: a key of the rows with words."""
    keep = [id_col] if keep is None else keep
    names = C.free_name(keep, "size"), C.free_name(keep, "taken")
    assert names == ("size", "taken"), "rename input columns that clash with the plan's"
    src = F.col(f"`{source_col}`")
    md5 = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    base = docs.select(*(F.col(f"`{c}`") for c in keep), src.isNull().alias("src_null"), F.coalesce(src, F.lit("")).alias("src"),
                       C.n_words(F.col(f"`{text_col}`")).alias("size"), md5.alias("order_key"))
    base = base.withColumn("bucket", F.substring("order_key", 1, 2))
    narrow = docs.select(src.isNull().alias("src_null"), F.coalesce(src, F.lit("")).alias("src"),
                         C.n_words(F.col(f"`{text_col}`")).alias("size"), F.substring(md5, 1, 2).alias("bucket"))
    buckets = C.materialize(narrow.groupBy("src_null", "src", "bucket").agg(F.sum("size").alias("size")), "mix")
    offsets = buckets.select("src_null", "src", "bucket", F.coalesce(F.sum("size").over(
        Window.partitionBy("src_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    plan = offsets.join(source_targets(buckets, max_repeats), ["src_null", "src"])
    running = F.coalesce(F.sum("size").over(Window.partitionBy("src_null", "src", "bucket").orderBy(
        "order_key", f"`{id_col}`" if id_col in keep else "order_key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = base.withColumn("running", running).join(plan, ["src_null", "src", "bucket"])
    d = d.withColumn("before", F.col("offset") + F.col("running"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    d = d.withColumn("whole", whole.cast("int"))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    once_more = (F.col("before") + F.col("size") / 2 <= left).cast("int")
    d = d.withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("whole") + once_more, F.lit(max_repeats))).otherwise(0))
    share = lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"))

    def at(e: Column) -> Column:
        out = training_time(share(e), schedules[0])
        for i, s in enumerate(schedules[1:], 1):
            out = F.when((F.col("rank") - 1) % len(schedules) == i, training_time(share(e), s)).otherwise(out)
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(
        F.array().cast("array<double>"))
    return d.select(*(F.col(f"`{c}`") for c in keep), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", positions.alias("positions"), "rank", "before")


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, parts: int | None) -> tuple[DataFrame, dict[str, str]]:
    """The mixed corpus in training order with position, size, rank and
    before; the input's columns are renamed as in the second result."""
    inner = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    plan = plan_mix(d, inner[id_col], inner[text_col], inner[source_col], keep=list(inner.values()))
    copies = plan.select(*inner.values(), F.explode("positions").alias("position"), "size", "rank", "before")
    parts = parts or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(parts, "position", inner[id_col]).sortWithinPartitions("position", inner[id_col]), inner


def mixed_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Writes the mixed corpus in training order.  Returns it (the input's
    columns as in_0, in_1, .., position, size, rank, before), and per row of
    ``docs`` the id, size, source_size, target, and, counted in the written
    copies, taken, first and last position (null: not taken)."""
    copies, _ = _copies(docs, id_col, text_col, source_col, None)
    copies = C.materialize(copies, "mixed")
    # a row without words has the next row's key, and no copies
    told = copies.groupBy("rank", "before").agg(F.sum("size").cast("long").alias("told"), F.min("position").alias("first_position"),
                                                F.max("position").alias("last_position"))
    plan = plan_mix(docs, id_col, text_col, source_col).join(told, ["rank", "before"], "left")
    mine = F.col("size") > 0
    return copies, plan.select(F.col(f"`{id_col}`"), "size", "source_size", "target",
                               F.when(mine, F.coalesce("told", F.lit(0))).otherwise(0).cast("long").alias("taken"),
                               *(F.when(mine, F.col(c)).alias(c) for c in ("first_position", "last_position")))


def order_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    parts: int | None = None) -> DataFrame:
    """The mixed corpus: each document as often as the plan takes it, range
    partitioned and sorted by training position; the input's columns."""
    out, inner = _copies(docs, id_col, text_col, source_col, parts)
    return out.select(*(F.col(n).alias(c) for c, n in inner.items()))
