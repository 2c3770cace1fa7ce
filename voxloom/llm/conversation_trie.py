"""Prefix trie of conversations and its subtree totals by parallel tree contraction.

Building: a turn's content and position are hashed; a prefix of a conversation is named by the
sum of its turns' hashes (four sums of 32 bits, so 128 bits), a running sum that
is taken in spans of ``SPAN`` turns and spans of spans, so that no window holds more
than ``SPAN`` rows of a conversation.  Equal prefixes are one node, named by its
smallest member and its depth.

Contraction: rounds of rake and compress, each a few joins over written tables.

* rake: every leaf's total is final; it is added to its parent, and the leaf goes;
* compress: in every maximal chain of nodes with one child, pointers double
  (next, next of next, ...) and carry the sum of what they skip, until each
  chain node knows its chain's end; then the chain goes, and its end hangs
  from the node above the chain.

A rake removes at least half of a tree without chains, and doubling needs
log2(longest chain) joins, so a deep conversation takes few rounds.  The
rounds are then undone, last first: a chain node's total is its skipped sum and
the total of its chain's end.

Hot nodes: children add to their parent through a partial aggregate, so a node
with very many children is no large group anywhere.

Defined results: turns are ordered by (turn, role, text), a null turn first; a null role or
text is empty; repeated rows are turns of their own; rows without a conv_id
take no part; an empty table gives no nodes.  Two different prefixes share a
name with a probability of about 2^-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm import common as C
from voxloom.operators.sampling import rank_in_group

#: rows of a conversation in one window
SPAN = 256
#: ids hashed as one row
CHUNK_IDS = 4096

_LOW = (1 << 32) - 1


# -- turns and prefixes --------------------------------------------------------

def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, content1, content2, bytes) of ``rows`` (conv_id, turn, role, text)."""
    named = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    marked = named.select("conv_id", "turn", "role", "text", F.octet_length("text").cast("long").alias("bytes"),
                          *(F.xxhash64(F.lit(i), "role", "text").alias(f"content{i}") for i in (1, 2)))
    ranked = rank_in_group(marked, "conv_id", ["turn", "role", "text"], "pos")
    return ranked.select("conv_id", "pos", "content1", "content2", "bytes")


def _sums(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Replaces ``cols`` by their running sums (mod 2^32) along ``pos`` in each
    conv_id.  Whole spans are summed and run through the same, one level up."""
    span = F.col("pos") / SPAN
    rows = rows.withColumn("span", F.floor(span))
    w = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({c: F.sum(c).over(w).bitwiseAND(F.lit(_LOW)) for c in cols})
    if (rows.agg(F.max("pos")).first()[0] or 0) < SPAN:
        return inside.drop("span")
    whole = rows.groupBy("conv_id", F.col("span").alias("pos")).agg(*(F.sum(c).bitwiseAND(F.lit(_LOW)).alias(c) for c in cols))
    before = _sums(whole, cols).select("conv_id", (F.col("pos") + 1).alias("span"), *(F.col(c).alias(f"{c}_before") for c in cols))
    both = inside.join(before, ["conv_id", "span"], "left")
    return both.withColumns({c: (F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).bitwiseAND(F.lit(_LOW)) for c in cols}).select(*inside.columns).drop("span")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name1, name2, above1, above2, bytes): for each turn the name
    of the prefix it ends and of the one before."""
    whole = [F.xxhash64("pos", "content1", "content2"), F.xxhash64("content2", "pos", "content1")]
    parts = {}
    for i, h in enumerate(whole):
        parts[f"e{2 * i}"], parts[f"e{2 * i + 1}"] = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW))
    names = list(parts)
    base = turns.select("conv_id", "pos", "bytes", *(x.alias(n) for n, x in parts.items()))
    run = _sums(base.withColumns({f"s{n}": F.col(n) for n in names}), [f"s{n}" for n in names])

    def joined(high: Column, low: Column) -> Column:
        return F.shiftleft(high, 32).bitwiseOR(low)

    def above(n: str) -> Column:
        return (F.col(f"s{n}") - F.col(n)).bitwiseAND(F.lit(_LOW))

    return run.select("conv_id", (F.col("pos") + 1).alias("depth"), joined(F.col("se0"), F.col("se1")).alias("name1"),
                      joined(F.col("se2"), F.col("se3")).alias("name2"), joined(above("e0"), above("e1")).alias("above1"),
                      joined(above("e2"), above("e3")).alias("above2"), "bytes")


# -- the trie ------------------------------------------------------------------

def build(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id and parent, each of conv_id and depth; n_convs, bytes, kids), and per
    conversation of ``convs`` (conv_id) the node where it ends.

    ``turns``: conv_id, pos (0, 1, ... in each), content1, content2, bytes."""
    paths = C.materialize(prefixes(turns), "prefixes")
    name = ["depth", "name1", "name2"]
    found = paths.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
                                     F.max("above1").alias("above1"), F.max("above2").alias("above2"))
    found = C.materialize(found, "named")
    all_convs, first = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    root = F.struct(F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"))
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("name1").alias("above1"), F.col("name2").alias("above2"),
                      F.struct(F.col("conv_id").alias("conv_id"), F.col("depth").alias("depth")).alias("parent"))
    own = F.struct("conv_id", "depth").alias("id")
    deeper = found.where("depth > 1").join(up, ["depth", "above1", "above2"]).select(own, "parent", "n_convs", "bytes")
    second = found.where("depth = 1").select(own, root.alias("parent"), "n_convs", "bytes")
    top = convs.limit(1).select(root.alias("id"), F.lit(None).cast("struct<conv_id:long,depth:long>").alias("parent"),
                                F.lit(all_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"))
    nodes = C.materialize(deeper.union(second).union(top), "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = C.materialize(nodes.join(kids, "id", "left").fillna(0, ["kids"]), "nodes")
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "name1", "name2")).alias("last")).select("conv_id", "last.*")
    there = found.select(*name, F.struct("conv_id", "depth").alias("id"))
    ended = last.join(there, name).select("id", F.col("conv_id").alias("member"))
    bare = convs.join(last, "conv_id", "left_anti").select(root.alias("id"), F.col("conv_id").alias("member"))
    return nodes, ended.union(bare)


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, *values): each value summed over the node's subtree, by contraction.
    ``nodes``: id, parent (null at roots), kids (number of children), values (long)."""
    ups = [f"up_{v}" for v in values]  # what the edge to the parent carries besides the node's total
    state = nodes.select("id", "parent", "kids", *values, *(F.lit(0).cast("long").alias(u) for u in ups))
    done: list[DataFrame] = []
    chains: list[DataFrame] = []
    while True:
        # rake
        leaves = state.where("kids = 0")
        done.append(leaves.select("id", *values))
        given = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.lit(1)).alias("raked"), *(F.sum(F.col(v) + F.col(u)).alias(f"from_{v}") for v, u in zip(values, ups)))
        kept = state.where("kids > 0").join(given, "id", "left")
        kept = kept.select("id", "parent", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"),
                           *((F.col(v) + F.coalesce(f"from_{v}", F.lit(0))).alias(v) for v in values), *ups)
        state = C.materialize(kept, "raked")
        if state.isEmpty():
            break
        # compress
        only = state.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", *ups)).alias("child")).where("n = 1")
        chain = C.materialize(state.where("kids = 1").join(only, "id").select(
            "id", F.col("child.id").alias("end"), *((F.col(v) + F.col(f"child.{u}")).alias(v) for v, u in zip(values, ups))), "chain")
        if chain.isEmpty():
            continue
        hops, moved = chain, True
        while moved:
            far = hops.select(F.col("id").alias("end"), F.col("end").alias("far"), *(F.col(v).alias(f"far_{v}") for v in values))
            step = hops.join(far, "end", "left").select(
                "id", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved"),
                *((F.col(v) + F.coalesce(f"far_{v}", F.lit(0))).alias(v) for v in values))
            step = C.materialize(step, "hops")
            hops, moved = step.drop("moved"), not step.where("moved").isEmpty()
        chains.append(hops)
        heads = chain.select("id").join(chain.select(F.col("end").alias("id")), "id", "left_anti")
        above = heads.join(hops, "id").join(state.select("id", "parent", *ups), "id").select(
            F.col("end").alias("id"), F.col("parent").alias("over"), *((F.col(u) + F.col(v)).alias(f"over_{v}") for v, u in zip(values, ups)),
            F.lit(True).alias("hung"))
        rest = state.where("kids != 1").join(above, "id", "left")
        state = C.materialize(rest.select("id", F.when(F.col("hung"), F.col("over")).otherwise(F.col("parent")).alias("parent"), "kids", *values,
                                          *(F.when(F.col("hung"), F.col(f"over_{v}")).otherwise(F.col(u)).alias(u) for v, u in zip(values, ups))), "compressed")
    total = done[0]
    for part in done[1:]:
        total = total.union(part)
    # expand, last round first
    for hops in reversed(chains):
        end = total.select(F.col("id").alias("end"), *(F.col(v).alias(f"end_{v}") for v in values))
        total = total.union(C.materialize(hops.join(end, "end").select(
            "id", *((F.col(v) + F.col(f"end_{v}")).alias(v) for v in values)), "expanded"))
    return total


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens: bytes not repeated in the subtree) and per conversation the node
    (conv_id, depth) where it (member) ends."""
    nodes, ends = build(turns, convs)
    own = nodes.select("id", "parent", "kids", (F.col("kids") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    out = nodes.join(totals, "id").select("id.conv_id", "id.depth", F.col("parent.conv_id").alias("parent_conv_id"), "n_convs",
                                          F.col("kids").alias("n_children"), "n_leaves", "saved_tokens")
    return out, ends.select("id.conv_id", "id.depth", "member")


def member_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the members that end at a node,
    ascending, as comma-joined decimal numbers.

    Members are range-sorted and joined in runs of ``CHUNK_IDS``; a node's
    runs are then hashed as a stream, so a node where very many conversations
    end is neither one group of rows nor held in memory."""
    C.ready(ends.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))

        for b in batches:
            for c, d, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (c, d) != node or len(ids) >= CHUNK_IDS:
                    close()
                    node, ids = (c, d), []
                ids.append(m)
            yield rows(out)
            out = []
        close()
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                          ["conv_id", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, hashlib.sha256()
        out: list[tuple] = []
        for b in batches:
            for c, d, x in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (c, d) != node:
                    if node:
                        out.append((*node, h.hexdigest()))
                    node, h = (c, d), hashlib.sha256(x.encode())
                else:
                    h.update(b"," + x.encode())
            yield digests(out)
            out = []
        if node:
            out.append((*node, h.hexdigest()))
        yield digests(out)

    def digests(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))],
                                          ["conv_id", "depth", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "depth", "member"]
    pieces = ends.select(*key).repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(
        joined, "conv_id long, depth long, first long, ids string")
    dealt = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return dealt.mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


# -- conversations that share openings -----------------------------------------

def shared_openings(conversations: DataFrame, family: int = 5, opening: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilds every conversation c: the first h turns of conversation
    c - c % family, then its own after its first h, h = crc32(decimal c) % opening.
    Returns the turns as ``prefix_trie`` takes them and all conv_ids."""
    own = C.materialize(numbered_turns(conversations.select("conv_id", "turn", "role", "text")), "turns")
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % opening
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    plan = C.materialize(plan, "plan")
    cols = ["content1", "content2", "bytes"]
    openings = own.where(F.col("pos") < opening - 1).withColumnRenamed("conv_id", "base")
    head = plan.join(openings, "base").where("pos < h").select("conv_id", "pos", *cols)
    # only the conversations whose own turns move need to be looked up
    moved = plan.where("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("back"))
    tail = own.where(F.col("pos") >= h).join(moved, "conv_id", "left")
    tail = tail.select("conv_id", (F.col("pos") - F.coalesce("back", F.lit(0))).alias("pos"), *cols)
    return head.union(tail), plan.select("conv_id")
