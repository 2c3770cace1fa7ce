"""N-gram Jaccard self-join with several global token orders.

Two documents link when the Jaccard similarity of their sets of distinct
five-word shingles is at least 0.75.  Sets as wholes come first: documents
with the same set form a class, and only classes are joined.

Order 1 sorts shingles by how often their bucket (one of 2**COUNT_BITS, by hash) occurs
in all texts, then by hash, so frequent ones come last.  Linked classes share a shingle within their first
n - ceil(0.75 n) + 1 ("prefix"), and at their first common one the rest of
both sets must still allow the overlap needed.  Postings are sorted by shingle
and streamed; in each group every class is paired with the group's first
ones (all pairs of a small group, stars in a large one), so the
number of pairs grows with the postings, not with the square of a group.
Shingles of hot buckets are salted: stars inside each
salt, then a star over the salts' centers.

Candidates pass a bound on their shared prefix shingles and must share prefix
shingles under two further orders as well; only then are the sets exchanged and the
overlap counted.  Linked classes become components (large-star, small-star).
Further turns look at groups too large for all pairs that still hold several
components, at their postings whose rest of the set can reach the overlap with
another's not yet met: stars between them while that shrinks the work, then all pairs
across components, so no link between components is lost.  With the components
known, ``linked_documents`` counts the links inside them: every pair of a
component's classes is measured, block by block, and counted per class in the block's task.

The order only affects the work: any total order gives the same links.

Defined results: a null, empty or blank text has an empty set, links with
nothing and is its own component; with fewer than five words the whole
sequence is the one shingle; repeated rows of an id are one document where
texts agree and documents of their own where not, and each row is returned; rows without an id link like
others, and a component's id is the smallest there is (null where no row has one);
an empty table gives an empty result.
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm import common as C
from voxloom.llm.shingles import mix, shingle_sets

#: similarity threshold, per cent
PERCENT = 75
#: a group of up to CENTERS + 1 classes is paired in full; in a larger one, and
#: in a salted one, every class meets the first FEW
CENTERS = 8
FEW = 2
#: parts a hot shingle's postings are dealt to; hot: its bucket is in 1 % of the
#: documents more than buckets of chance are
SALTS = 16
HOT_PERCENT = 1
#: buckets in which a task counts shingles, as a power of two
COUNT_BITS = 20
#: star turns before what is left is paired in full
MAX_TURNS = 4
#: classes of the main component that a star turn pairs every other with, per group
TURN_CENTERS = 16
#: shingles of a component's block, about; cells of a 0/1 matrix held at once
BLOCK_SHINGLES = 1_000_000
PRODUCT_CELLS = 8_000_000
#: edges of a component round in a task, at least, about; up to as many, a round is one task
EDGES_PER_TASK = 200_000
#: classes whose names are broadcast to look up their texts (some 30 MB); more are joined
BROADCAST_CLASSES = 200_000

# -- order and prefixes ------------------------------------------------------


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def needed(na, nb):
    """Smallest overlap with 100 * overlap >= PERCENT * union."""
    return -((-PERCENT * (na + nb)) // (100 + PERCENT))


def class_of(s: np.ndarray) -> int:
    """64-bit fingerprint of a set (signed)."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def first_prefix(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix of a sorted set under order 1, and the counts of its shingles' buckets."""
    count = counts[bucket_of(s)]
    o = np.argsort(count, kind="stable")[:prefix_length(len(s))]
    return s[o], count[o]


def other_prefix(s: np.ndarray, order: int) -> np.ndarray:
    """Prefix under a further order: the smallest re-mixed hashes."""
    h = mix(s ^ np.uint64(0xA0761D6478BD642F * order & (1 << 64) - 1))
    p = prefix_length(len(s))
    return h if p >= len(h) else np.partition(h, p - 1)[:p]


def sketch(s: np.ndarray, order: int) -> np.ndarray:
    """32 bits of each token of a set's prefix under a further order."""
    return np.unique((other_prefix(s, order) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test."""
    need = needed(len(a), len(b))
    if min(len(a), len(b)) < need:
        return False
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


# -- postings and pairs ------------------------------------------------------

def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row doc_id, text_key (the text's hash), n_shingles, cls (null for an
    empty set), and the set's prefixes under the further orders (order2, order3).
    Each task adds a row of the buckets it met and the sets that have them (buckets, counts;
    null in the rows of documents); copies of a set in a task count once."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, open_, held = np.zeros(1 << COUNT_BITS, np.int64), [], 0
        seen: set[int] = set()
        for b in batches:
            n, c, two, three = [], [], [], []
            for _, s in shingle_sets(b.column(2).to_pylist()):
                cls = class_of(s) if len(s) else None
                n.append(len(s))
                c.append(cls)
                two.append(sketch(s, 2) if len(s) else None)
                three.append(sketch(s, 3) if len(s) else None)
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    open_.append(bucket_of(s))
                    held += len(s)
                    if held >= 1 << COUNT_BITS:
                        counts += np.bincount(np.concatenate(open_), minlength=1 << COUNT_BITS)
                        open_, held = [], 0
            none = pa.nulls(len(n), ints)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()),
                                              pa.array(two, ints), pa.array(three, ints), none, none], names)
        if open_:
            counts += np.bincount(np.concatenate(open_), minlength=1 << COUNT_BITS)
        met = np.flatnonzero(counts)
        if len(met):
            row = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, ints)] * 2
            yield pa.RecordBatch.from_arrays([*row, *(pa.array([x.astype(np.int32)], ints) for x in (met, counts[met]))], names)

    names = ["doc_id", "text_key", "n_shingles", "cls", "order2", "order3", "buckets", "counts"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, cls long, order2 array<int>, order3 array<int>, buckets array<int>, counts array<int>")


def bucket_counts(sketched: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Per bucket the sets of all documents that have a shingle of it, and the count from
    which its shingles are hot.  ``sketched``: of ``fingerprints``, written."""
    of_tasks = sketched.where("buckets is not null").select(F.inline(F.arrays_zip("buckets", "counts")).alias("bucket", "k"))
    got = of_tasks.groupBy("bucket").agg(F.sum("k").alias("k")).toArrow()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("k").to_numpy()
    return counts, max(3, rows * HOT_PERCENT // 100) + 2 * (int(counts.sum()) >> COUNT_BITS)


def postings(docs: DataFrame, frequent: tuple[np.ndarray, int], text_col: str) -> DataFrame:
    """(token, salt, cls, place): place packs set size and position.  A class
    is emitted once per task."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = sent.value
        seen: set[int] = set()
        for b in batches:
            parts: list[tuple] = []
            held = 0
            for _, s in shingle_sets(b.column(0).to_pylist()):
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    continue
                seen.add(c)
                t, count = first_prefix(s, counts)
                p = len(t)
                parts.append((t.astype(np.int64), np.where(count >= hot, 1 + c % SALTS, 0).astype(np.int32), np.full(p, c, np.int64),
                              (np.int64(len(s)) << 31) + np.arange(p)))
                held += p
                if held > 200_000:
                    yield _batch(parts)
                    parts, held = [], 0
            if parts:
                yield _batch(parts)

    def _batch(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["token", "salt", "cls", "place"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "token long, salt int, cls long, place long")


def unmet(place: np.ndarray) -> np.ndarray:
    """Which postings of a large group, all at hand and in the group's order, may link
    there with a class that their own was not paired with: both rests reach the overlap needed.
    The first FEW were paired with every other."""
    size = place >> 31
    most = (100 + PERCENT) * (size - (place & (1 << 31) - 1)) // PERCENT - size  # the largest set that the rest can link with
    o = FEW + np.argsort(size[FEW:], kind="stable")
    before = np.concatenate([[-1], np.maximum.accumulate(most[o])])  # largest ``most`` among smaller sets
    first = np.maximum.accumulate(np.where(most[o] > before[:-1], np.arange(len(o)), 0))
    second = np.maximum.accumulate(np.minimum(most[o], before[:-1]))
    at = np.searchsorted(size[o], most[o], side="right") - 1
    best = np.where(first[at] == np.arange(len(o)), second[at], before[1:][at])
    out = np.zeros(len(place), bool)
    out[o] = (at >= 0) & (best >= size[o])
    return out


STAR = "kind int, a long, b long, token long, place long, salt int"
PAIR, POSTING, CENTER = 0, 1, 2


def stars(sorted_rows: DataFrame, second: bool = False) -> DataFrame:
    """Streams postings sorted by (token, salt, priority) and yields candidate
    pairs, the postings of classes that share a shingle, and, for salted
    groups, their centers.  Only the centers of the open group are kept.

    A posting row carries in ``b`` 1 if its group is too large for all pairs
    (or salted) and the posting may have a partner there that it was not paired
    with (``unmet``), so the last round looks at it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        centers: list[tuple[int, int]] = []
        size, waiting, whole = 0, [], True
        out: list[list] = [[], [], [], [], [], []]
        pairs: set[tuple[int, int]] = set()

        def put(kind, a, b, token, place, salt):
            for col, v in zip(out, (kind, a, b, token, place, salt)):
                col.append(v)

        def close():
            nonlocal waiting
            big = size > CENTERS + 1 or (key and key[1] > 0)
            if not second and (size > 1 or big):
                again = np.full(len(waiting), big)
                if big and whole and not key[1]:
                    again = unmet(np.array([pl for _, pl in waiting], np.int64))
                for (c, pl), look in zip(waiting, again.tolist()):
                    put(POSTING, c, int(look), key[0], pl, key[1])
            if not second and key and key[1] > 0:
                for c, pl in centers[:FEW]:
                    put(CENTER, c, 0, key[0], pl, key[1])
            waiting = []

        def flush():
            nonlocal out, pairs
            for a, b in pairs:
                put(PAIR, a, b, 0, 0, 0)
            pairs = set()
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            rb = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["kind", "a", "b", "token", "place", "salt"])
            out = [[], [], [], [], [], []]
            return rb

        low = (1 << 31) - 1
        for b in batches:
            token, salt, cls, place = (b.column(i).to_numpy() for i in range(4))
            n = len(token)
            if not n:
                continue
            # rows alone in their group, away from the batch's edges, need no look
            new = np.ones(n + 1, bool)
            new[1:n] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            alone = new[:n] & new[1:] & (salt == 0)
            alone[0] = alone[-1] = False
            for i in np.flatnonzero(~alone).tolist():
                k = (int(token[i]), int(salt[i]))
                if k != key:
                    close()
                    key, centers, size, whole = k, [], 0, True
                c, pl = int(cls[i]), int(place[i])
                if any(c == d for d, _ in centers) or (waiting and waiting[-1][0] == c):
                    continue
                size += 1
                nc, pc = pl >> 31, pl & low
                for d, pd_ in centers[:FEW if second or key[1] > 0 or size > CENTERS + 1 else CENTERS]:
                    nd, at = pd_ >> 31, pd_ & low
                    if 1 + min(nc - pc, nd - at) - 1 >= needed(nc, nd):
                        pairs.add((c, d) if c < d else (d, c))
                if len(centers) < CENTERS:
                    centers.append((c, pl))
                if not second:
                    waiting.append((c, pl))
                    if len(waiting) > 50_000:  # a large group's postings go out as they come
                        for w, q in waiting:
                            put(POSTING, w, 1, key[0], q, key[1])
                        waiting, whole = [], False
                if len(out[0]) + len(pairs) > 100_000:
                    yield flush()
        close()
        if out[0] or pairs:
            yield flush()

    return sorted_rows.select("token", "salt", "cls", "place").mapInArrow(run, STAR)


def by_group(rows: DataFrame) -> DataFrame:
    """Postings dealt by (token, salt) and sorted so that a class's priority,
    a hash, is the same in every group."""
    d = rows.select("token", "salt", "cls", "place").repartition("token", "salt")
    return d.sortWithinPartitions("token", "salt", F.xxhash64("cls"), "cls")


def of_pairs(pairs: DataFrame, *rows: DataFrame) -> list[DataFrame]:
    """``rows`` (cls, ...) of the classes in ``pairs`` (a, b; written): where those are few, they are
    picked where the rows lie, so that a turn on a few classes does not shuffle the rows of all."""
    ends = C.materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), "ends")
    few = ends.count() <= BROADCAST_CLASSES
    return [r.join(F.broadcast(ends), "cls", "left_semi") if few else r for r in rows]


def size_of(place: Column) -> Column:
    return F.shiftright(place, 31)


def _need(na: Column, nb: Column) -> Column:
    return F.ceil((na + nb) * F.lit(PERCENT) / F.lit(100.0 + PERCENT) - F.lit(1e-9))


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * F.lit(PERCENT) / F.lit(100.0) - F.lit(1e-9)) + 1


def promising(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the filters of all orders.  Order 1: the shared
    prefix shingles, plus what may follow them, reach the overlap needed.  A common shingle outside the shared ones lies beyond the
    prefix that ends first in the order; which of the two that is isn't known
    here, so the longer rest counts.  Orders 2 and 3: the prefixes share a token.  ``held``: per class its size, those of
    its prefix shingles that any other class has, and its prefixes under the further orders."""
    a = held.select(F.col("cls").alias("a"), F.col("n").alias("na"), *(F.col(c).alias(f"{c}_a") for c in ("tokens", "order2", "order3")))
    b = held.select(F.col("cls").alias("b"), F.col("n").alias("nb"), *(F.col(c).alias(f"{c}_b") for c in ("tokens", "order2", "order3")))
    both = pairs.join(a, "a").join(b, "b")
    rest = F.greatest(F.col("na") - _prefix(F.col("na")), F.col("nb") - _prefix(F.col("nb")))
    enough = F.size(F.array_intersect("tokens_a", "tokens_b")) + rest >= _need(F.col("na"), F.col("nb"))
    further = F.arrays_overlap("order2_a", "order2_b") & F.arrays_overlap("order3_a", "order3_b")
    return both.where(enough & further).select("a", "b", "na", "nb")


def class_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the classes asked for, from one document of
    each.  ``classes``: cls, rep (doc_id and text_key)."""
    wanted = classes.select("cls", _id_key(F.col("rep.doc_id")).alias("k"), F.col("rep.text_key").alias("text_key"))
    some = docs.select(_id_key(F.col(id_col).cast("long")).alias("k"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    # rows that repeat an id with its text are all found; the join has dealt them by that key already
    some = some.join(wanted, ["k", "text_key"]).dropDuplicates(["k", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, blobs = [], []
            for c, (_, s) in zip(b.column(1).to_pylist(), shingle_sets(b.column(0).to_pylist())):
                if len(s) and class_of(s) == c:
                    ids.append(c)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["cls", "shingles"])

    return some.select("t", "cls").mapInArrow(run, "cls long, shingles binary")


def _id_key(doc_id: Column) -> Column:
    """An id as a join key: a row without an id has one too."""
    return F.struct(doc_id.alias("id"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that link, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                    for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


# -- groups whose classes lie in several components ---------------------------

def mixed_groups(big: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of large groups that still hold several components, with the
    class's component (label) and the one most of the group belongs to (main)."""
    # written, since it is read twice; dealt by token once, which both counts and the join then share
    rows = C.materialize(big.join(labels, "cls"), "labelled").repartition("token")
    per = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = per.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    return rows.join(main.where("labels > 1").select("token", "main"), "token")


def _crossed(few: DataFrame, other: DataFrame) -> DataFrame:
    x = few.select("token", F.col("cls").alias("a"), F.col("place").alias("pa"), F.col("label").alias("la"))
    y = other.select("token", F.col("cls").alias("b"), F.col("place").alias("pb"), F.col("label").alias("lb"),
                     (F.col("label") == F.col("main")).alias("in_main"))
    na, nb, low = size_of(F.col("pa")), size_of(F.col("pb")), F.lit((1 << 31) - 1)
    room = F.least(na - F.col("pa").bitwiseAND(low), nb - F.col("pb").bitwiseAND(low))
    met = (F.col("la") != F.col("lb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (room >= _need(na, nb))
    return x.join(y, "token").where(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cross_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of a group that lie in different components."""
    return _crossed(rows.where("label != main"), rows)


def cross_stars(rows: DataFrame, turn: int) -> DataFrame:
    """Each class outside its group's main component with TURN_CENTERS classes
    of it, others in each turn."""
    w = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "cls"), "cls")
    centers = rows.where("label = main").withColumn("n", F.row_number().over(w)).where(F.col("n") <= TURN_CENTERS).drop("n")
    return _crossed(rows.where("label != main"), centers)


# -- components --------------------------------------------------------------

def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """(node, root): every node of an edge and the smallest node it reaches,
    by alternating large-star and small-star rounds until nothing changes.
    ``at_most``: rows of ``edges``, if known.

    Up to EDGES_PER_TASK edges are a round's work of one task, without exchanges or
    broadcasts; more are dealt out.  Each exchange of a few edges costs the driver a job
    and as many tasks as there are shuffle partitions, round after round."""

    def few(rows: int) -> bool:
        return rows <= EDGES_PER_TASK

    def gathered(e: DataFrame, rows: int) -> DataFrame:
        return e.coalesce(1) if few(rows) else e

    def beside(low: DataFrame, rows: int) -> DataFrame:
        return low.hint("merge") if few(rows) else low

    def large(e: DataFrame, rows: int) -> DataFrame:
        both = gathered(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(beside(low, rows), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return gathered(moved, rows)

    def small(e: DataFrame, rows: int) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(beside(low, rows), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return gathered(moved.union(low.select("u", F.col("m").alias("v"))), rows)

    def tidy(e: DataFrame, rows: int) -> DataFrame:
        return e.where("u != v").distinct().coalesce(1 + rows // EDGES_PER_TASK)

    def state(e: DataFrame, rows: int):
        return tuple(gathered(e, rows).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = EDGES_PER_TASK + 1 if at_most is None else at_most
    # exchanged, not coalesced: the work behind ``edges`` stays many tasks'
    e = edges.where("u != v")
    e = C.materialize((e.repartition(1) if few(rows) else e).distinct(), "edges")
    before = state(e, rows)
    while before[0]:
        e = C.materialize(tidy(small(large(e, before[0]), before[0]), before[0]), "edges")
        after = state(e, before[0])
        if after == before:
            break
        before = after
    roots = gathered(e.select("v"), before[0]).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))


def merged(comp: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """``comp`` (node, root) after ``n_links`` further ``links`` (a, b): components of the roots."""
    roots = comp.select("node", "root")
    ends = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    joined = C.materialize(components(ends.select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")), n_links), "roots")
    to = joined.toDF("root", "new")
    old = comp.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return C.materialize(old.union(joined.join(comp, "node", "left_anti").select("node", "root")), "components")


# -- all links inside the components -----------------------------------------

def dealt(labels: DataFrame) -> DataFrame:
    """(cls, docs, root, blocks, block) of the classes in components of two
    or more.  ``labels``: cls, root, n, docs.  A component of k classes is
    dealt to about sqrt(k) / 8 blocks by hash, more where its sets are long."""
    per = labels.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).where("k > 1")
    blocks = F.greatest(F.ceil(F.sqrt("k") / 8), F.ceil(F.col("total") / BLOCK_SHINGLES))
    per = per.select("root", F.least(blocks, F.col("k")).cast("int").alias("blocks"))
    return labels.join(per, "root").select(
        "cls", "docs", "root", "blocks", F.pmod(F.xxhash64(F.lit(17), "cls"), F.col("blocks")).cast("int").alias("block"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with those of
    ``right`` (None: with each other), as products of 0/1 matrices over the
    shingles that both sides have."""
    x = np.concatenate(left)
    row_x = np.repeat(np.arange(len(left)), [len(s) for s in left])
    if right is None:
        shared, count = np.unique(x, return_counts=True)
        shared, y, row_y, m = shared[count > 1], x, row_x, len(left)
    else:
        y = np.concatenate(right)
        row_y, m = np.repeat(np.arange(len(right)), [len(s) for s in right]), len(right)
        shared = np.intersect1d(x, y)
    out = np.zeros((len(left), m))
    width = max(1, PRODUCT_CELLS // (len(left) + m))

    def placed(v: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
        hit = shared[at] == v
        o = np.argsort(at[hit], kind="stable")
        return at[hit][o], row[hit][o]

    if not len(shared):
        return out
    at_x, row_x = placed(x, row_x)
    at_y, row_y = (at_x, row_x) if right is None else placed(y, row_y)
    for lo in range(0, len(shared), width):
        w = min(width, len(shared) - lo)

        def cells(at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
            a, b = np.searchsorted(at, (lo, lo + w))
            c = np.zeros((n, w), np.float32)
            c[row[a:b], at[a:b] - lo] = 1
            return c

        cx = cells(at_x, row_x, len(left))
        out += cx @ (cx if right is None else cells(at_y, row_y, m)).T
    return out


def link_counts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, others): per class of a component, the documents of the classes that
    link with it.  Each pair of blocks is a group of its own, so a large
    component is many tasks' work; each pair of classes in it is measured
    exactly, and counted where it is measured: a block pair returns a row per class, not per link."""
    # each class meets its set once; only then is it sent to its block's pairs
    held = members.join(sets.select("cls", "shingles"), "cls")
    q = held.select("cls", "docs", "root", "block", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"))
    rows = q.select(
        "root", F.least("block", "q").alias("i"), F.greatest("block", "q").alias("j"),
        (F.col("block") > F.col("q")).alias("right"), "cls", "docs", "shingles")

    def counted(left: list[tuple], right: list[tuple], same: bool) -> pa.RecordBatch:
        other = left if same else right
        na, nb = (np.array([len(s) for *_, s in x], np.int64) for x in (left, other))
        da, db = (np.array([d for _, d, _ in x], np.int64) for x in (left, other))
        found = overlaps([s for *_, s in left], None if same else [s for *_, s in right]) >= needed(na[:, None], nb[None, :])
        cls = [c for c, *_ in left]
        if same:
            np.fill_diagonal(found, False)
            n = found @ db
        else:
            cls += [c for c, *_ in right]
            n = np.concatenate([found @ db, found.T @ da])
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64())], ["cls", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        sides: tuple[list, list] = ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            same = bool(key) and key[1] == key[2]
            if sides[0] and (same or sides[1]):
                yield counted(*sides, same)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for *k, right, c, d, s in zip(*cols, batch.column(6)):
                if tuple(k) != key:
                    yield from close()
                    key, sides = tuple(k), ([], [])
                sides[right].append((c, d, np.frombuffer(s.as_py(), np.uint64)))
        yield from close()

    d = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return d.mapInArrow(run, "cls long, others long").groupBy("cls").agg(F.sum("others").alias("others"))


# -- the join ----------------------------------------------------------------

def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' fingerprints; (cls, n, docs, component_id, root) of every class (n: set size,
    docs: its documents, root: the component's smallest class, since ids may repeat); and the
    sets of the classes of all candidate pairs."""
    C.ready(docs.sparkSession)
    sketched = C.materialize(fingerprints(docs, id_col, text_col), "marks")
    of_documents = sketched.where("buckets is null")
    marks = of_documents.select("doc_id", "text_key", "n_shingles", "cls")
    # a class is read from one of its documents, with an id where any has one
    rep = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    size = (F.countDistinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("docs")
    reps = C.materialize(marks.where("cls is not null").groupBy("cls").agg(rep.alias("rep"), F.max("n_shingles").alias("n"), size), "classes")
    found = C.materialize(stars(by_group(postings(docs, bucket_counts(sketched, marks.count()), text_col))), "stars")
    centers = found.where(f"kind = {CENTER}").select("token", F.lit(0).alias("salt"), F.col("a").alias("cls"), "place")
    across = stars(by_group(centers), second=True).where(f"kind = {PAIR}").select("a", "b")
    posted = found.where(f"kind = {POSTING}").select(F.col("a").alias("cls"), "token", "place", (F.col("b") == 1).alias("big"))
    held = posted.groupBy("cls").agg(F.max(size_of(F.col("place"))).alias("n"), F.collect_set("token").alias("tokens"))
    further = of_documents.select("cls", F.struct("doc_id", "text_key").alias("rep"), "order2", "order3").join(reps.select("cls", F.col("rep").alias("first")), "cls")
    further = further.where(F.col("rep").eqNullSafe(F.col("first"))).dropDuplicates(["cls"]).select("cls", "order2", "order3")
    held = C.materialize(held.join(further, "cls"), "held")
    pairs = C.materialize(promising(found.where(f"kind = {PAIR}").select("a", "b").union(across).distinct(), held), "pairs").select("a", "b")

    def label(comp: DataFrame) -> DataFrame:
        return reps.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", "rep", "n", "docs", F.coalesce("root", "cls").alias("label"))

    def sets_of(p: DataFrame, known: DataFrame | None) -> DataFrame:
        wanted = p.select(F.col("a").alias("cls")).union(p.select(F.col("b").alias("cls"))).distinct()
        if known is not None:
            wanted = wanted.join(known, "cls", "left_anti")
        # written and counted first: a bounded number of classes is sent to the texts, not the texts to the classes
        wanted = C.materialize(reps.select("cls", "rep").join(wanted, "cls"), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted
        return C.materialize(class_sets(docs, wanted, id_col, text_col), "sets")

    sets = sets_of(pairs, None)
    links = C.materialize(verified(pairs, sets), "links")
    comp = C.materialize(components(links.toDF("u", "v"), links.count()), "components")
    big = posted.where("big").select("token", "cls", "place")
    work = None
    for turn in range(MAX_TURNS + 1):
        rows = C.materialize(mixed_groups(big, label(comp).select("cls", "label")), "big")
        # components only grow: a group in one component needs no further look
        big = rows.select("token", "cls", "place")
        before = work
        per = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("main")).alias("m"))
        n, work = (x or 0 for x in per.agg(F.sum("n"), F.sum(F.col("n") * F.col("m"))).first())
        # more stars as long as they shrink the work; then whatever is left, in full
        last = turn == MAX_TURNS or work <= 10 * n or (before is not None and work > 0.8 * before)
        more = cross_pairs(rows) if last else cross_stars(rows, turn)
        more = C.materialize(more.join(pairs, ["a", "b"], "left_anti"), "met")
        held_here, known_here = of_pairs(more, held, sets)
        more = C.materialize(promising(more, held_here), "pairs").select("a", "b")
        if not more.isEmpty():
            new = sets_of(more, sets)
            sets = sets.union(new)
            links = C.materialize(verified(more, known_here.union(new)), "links")
            if n_links := links.count():
                comp = merged(comp, links, n_links)
            pairs = pairs.union(more)
        if last:
            break
    labels = label(comp)
    least = labels.groupBy("label").agg(F.min("rep.doc_id").alias("component_id"))
    return marks, labels.join(least, "label").select("cls", "n", "docs", "component_id", F.col("label").alias("root")), sets


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, itself included; null if no document reached has an id).
    Links are not counted; ``linked_documents`` does that."""
    marks, labels, _ = _joined(docs, id_col, text_col)
    out = marks.join(labels.select("cls", "component_id"), "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, cls (null
    for an empty set) and n_links: the documents of the same
    class, itself left out, and of the classes linked with it.  Rows of one id and
    class are one document; every row without an id is one."""
    marks, labels, sets = _joined(docs, id_col, text_col)
    labels = C.materialize(labels, "labels")
    others = link_counts(dealt(labels), sets)
    per = C.materialize(labels.join(others, "cls", "left").select(
        "cls", "component_id", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "degrees")
    out = marks.join(per, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "cls",
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id, and of
    several texts of that id the one with the smallest hash.  Rows that repeat
    an id with the same text count as one, with different texts as documents of
    their own; rows without an id all stay."""
    marks, labels, _ = _joined(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col)
    first = marks.join(labels.select("cls", "root"), "cls").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    alone = marks.where("cls is null").select("doc_id", "text_key").distinct()
    keep = first.select("k.doc_id", "k.text_key").union(alone).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    key = C.free_name(docs.columns, "text_key")
    rows = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`")))
    same = (F.col(f"`{id_col}`") == F.col("kept_id")) & (F.col(key) == F.col("kept_key"))
    stay = rows.join(keep, same, "left_semi").dropDuplicates([id_col, key]).drop(key)
    return stay.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
