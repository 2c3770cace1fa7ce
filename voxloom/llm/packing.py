"""Best-fit packing by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of
piece lengths (at most ``capacity`` rows, whatever the corpus) reaches the
driver.  There a configuration LP - cover every length's pieces by as few
copies of configurations (multisets of lengths that fit one sequence) as
possible - is solved by multiplicative weights: each round prices
configurations by unbounded-knapsack dynamic programming under the current
weights, takes fractions of them, and lowers the weights of the lengths they
cover; the prices also bound the program's value from below.  The fractional
solution is rounded to whole configurations, and best fit decreasing (on groups
of equal bins, so its cost does not depend on the number of pieces) packs the
last of it.

Every piece then finds its slot by its rank among the pieces of its length:
the rank inside its partition (counted while tokenizing) plus the counts of
earlier partitions.  No window holds a length as a whole.

Defined results: a null text is empty, so it is the single end id; an empty
table gives an empty result; repeated rows are packed one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm import common as C
from voxloom.llm.word_bpe import WordBpe

CAPACITY = 2048
END_ID = 0
#: pricing rounds of a program, at most, and the gap between value and bound that ends them
ROUNDS = 200
GAP = 0.002
#: how fast prices fall with the covered share; how far from the best a configuration may be
STEP = 0.1
SLACK = 0.02
#: pricing rounds, at most, on what rounding down leaves; the rest is left to best fit
REST_ROUNDS = 300
TILT = 0.5

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


# -- the configuration program (driver, over the histogram) ------------------

def knapsack(price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest total price of lengths (with repeats) that fit 0, 1, .. ``room``
    and the length taken first (0: one token stays free); one vector step per size."""
    best = np.zeros(room + 1)
    took = np.zeros(room + 1, np.int64)
    v = price[1:room + 1]
    for c in range(1, room + 1):
        gain = v[:c] + best[c - 1::-1]
        j = int(gain.argmax())
        if v[j] > 0 and gain[j] > best[c - 1]:
            best[c], took[c] = gain[j], j + 1
        else:
            best[c] = best[c - 1]
    return best, took


def configuration(took: np.ndarray, room: int) -> list[int]:
    """The lengths of a best filling of ``room``."""
    out = []
    while room > 0:
        n = int(took[room])
        if n:
            out.append(n)
        room -= n or 1
    return out


class Program(NamedTuple):
    """A feasible fractional cover, its value and a lower bound of any cover's."""
    amounts: dict[tuple[int, ...], float]
    value: float
    bound: float


def covering_program(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, gap: float = GAP) -> Program:
    """The configuration LP by multiplicative weights.

    ``covered`` is the share of each length's demand that the rounds so far
    cover.  A length's price starts as its size and shrinks by
    ``exp(-step * covered)``.  A round prices by one knapsack table, which holds
    the best configuration around every length; those within ``SLACK`` of the
    best are taken, each up to its share of what its lengths demand.  Any prices
    give a lower bound (what the demand costs over the best configuration's
    price).  The sum of the rounds over the least share is a cover; lengths that
    lag far behind are filled up with configurations of their own where that is
    cheaper.  Ends when value and bound differ by ``gap`` or after ``rounds``.
    """
    live = np.flatnonzero(demand)
    if not len(live):
        return Program({}, 0.0, 0.0)
    d = demand[live].astype(float)
    covered = np.zeros(len(live))
    place = np.zeros(len(demand), np.int64)
    place[live] = np.arange(len(live))
    own = capacity // live
    taken: dict[tuple[int, ...], float] = {}
    bound, done = 0.0, 0.0
    best_cover: tuple[float, float] = (np.inf, 1.0)
    for _ in range(rounds):
        price = np.zeros(len(demand))
        price[live] = live * np.exp(-step * (covered - covered.min()))
        best, took = knapsack(price, capacity)
        bound = max(bound, float(price[live] @ d / best[capacity]))
        around = price[live] + best[capacity - live]
        confs = {tuple(sorted([int(n), *configuration(took, capacity - int(n))], reverse=True))
                 for n in live[around >= (1 - SLACK) * best[capacity]]}
        uses = [np.unique(place[list(c)], return_counts=True) for c in sorted(confs)]
        sharing = np.zeros(len(live))
        for i, _n in uses:
            sharing[i] += 1
        for c, (i, n) in zip(sorted(confs), uses):
            amount = float(np.min(d[i] / (n * sharing[i])))
            taken[c] = taken.get(c, 0.0) + amount
            covered[i] += amount * n / d[i]
            done += amount
        # the level at which rounds so far plus own configurations cost least
        levels = np.unique(np.quantile(covered, np.linspace(0, 1, 33)))
        for level in levels[levels > 0]:
            cost = (done + float(np.sum(np.maximum(0.0, level - covered) * d / own))) / level
            if cost < best_cover[0]:
                best_cover = cost, float(level)
                kept, lacking = dict(taken), np.maximum(0.0, level - covered) * d / own / level
        if best_cover[0] <= bound * (1 + gap):
            break
    value, level = best_cover
    amounts = {c: x / level for c, x in kept.items()}
    for n, k, x in zip(live.tolist(), own.tolist(), lacking.tolist()):
        if x > 0:
            amounts[(n,) * k] = amounts.get((n,) * k, 0.0) + x
    return Program(amounts, value, bound)


def rounded(program: Program, demand: np.ndarray, capacity: int) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Whole copies of the program's configurations, fullest first, as far as
    the lengths last, and the demand they leave.  What no cover's average sequence
    could be as empty as, by the bound, is left to the pricing below."""
    left = demand.copy()
    out = []
    fill = min(capacity, int(float(np.arange(len(demand)) @ demand) / program.bound)) if program.bound else 0
    for c, x in sorted(program.amounts.items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
        if sum(c) < fill:
            break
        i, n = np.unique(c, return_counts=True)
        k = min(int(x + 1e-9), int(np.min(left[i] // n)))
        if k > 0:
            left[i] -= k * n
            out.append((list(c), k))
    return out, left


def priced_rounds(left: np.ndarray, capacity: int, rounds: int, step: float = 2.0) -> list[tuple[list[int], int]]:
    """Whole copies of full configurations from what rounding down leaves: the
    knapsack prices only lengths that are left, and half of what lasts is taken."""
    demand = np.maximum(left, 1)
    size = np.arange(len(left))
    start = size * (1 + TILT * size / capacity)
    log_w = np.zeros(len(left))
    out: list[tuple[list[int], int]] = []
    for _ in range(rounds):
        live = left >= 1
        if not live.any():
            break
        conf = configuration(knapsack(np.where(live, start * np.exp(log_w - log_w[live].max()), 0.0), capacity)[1], capacity)
        uses = np.bincount(conf, minlength=len(left))
        on = uses > 0
        lasts = int(np.min(left[on] // uses[on]))
        if not lasts or sum(conf) < capacity:
            log_w[on] -= step  # too few of a length, or the bin stays open: price these lower
            continue
        n = max(1, lasts // 2)
        out.append((conf, n))
        left[on] -= n * uses[on]
        log_w[on] -= step * n * uses[on] / demand[on]
    return out


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best fit decreasing on groups of equal bins."""
    groups: dict[int, list[list]] = {}  # room -> [[pattern, count], ..]
    for s in range(len(demand) - 1, 0, -1):
        n = int(demand[s])
        while n > 0:
            room = next((r for r in range(s, capacity) if groups.get(r)), None)
            if room is None:
                per = capacity // s
                full, rest = divmod(n, per)
                for k, count in ((per, full), (rest, 1)):
                    if k and count:
                        groups.setdefault(capacity - k * s, []).append([[s] * k, count])
                n = 0
                continue
            pattern, count = groups[room].pop()
            per = room // s
            use = min(count, n // per)
            if use:
                groups.setdefault(room - per * s, []).append([pattern + [s] * per, use])
                n -= use * per
                if count > use:
                    groups[room].append([pattern, count - use])
            else:  # fewer left than one bin takes
                groups.setdefault(room - n * s, []).append([pattern + [s] * n, 1])
                if count > 1:
                    groups[room].append([pattern, count - 1])
                n = 0
    return [(p, c) for g in groups.values() for p, c in g]


def solve(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(configuration, number of sequences) covering the histogram exactly: the
    program rounded down, priced rounds on what that leaves, best fit for the last of it."""
    demand = np.zeros(capacity + 1, np.int64)
    for k, n in hist.items():
        demand[k] = n
    full = [([capacity], int(demand[capacity]))] if demand[capacity] else []
    demand[capacity] = 0
    done, left = rounded(covering_program(demand, capacity), demand, capacity)
    done += priced_rounds(left, capacity, REST_ROUNDS)
    return full + done + best_fit(left, capacity)


def slot_table(configs: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes.  Rows sorted by (length, first
    rank): first sequence, pieces of the length per sequence, offset of the
    first of them."""
    rows, taken, seq = [], {}, 0
    for conf, count in configs:
        offset = 0
        for s in sorted(set(conf), reverse=True):
            per = conf.count(s)
            rows.append((s, taken.get(s, 0), seq, per, offset))
            taken[s] = taken.get(s, 0) + per * count
            offset += per * s
        seq += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "seq": a[:, 2], "per": a[:, 3], "offset": a[:, 4]}


# -- pieces ------------------------------------------------------------------

def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, keep_ids: bool,
                     id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 4) -> DataFrame:
    """One row per piece, with its rank among the task's pieces of its length."""
    C.ready(docs.sparkSession)
    kept_type = {2: "<u2", 4: "<u4"}[id_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            blobs: list[bytes] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    raw = ids[at:at + capacity].tobytes()
                    n = len(raw) // 4
                    for c, v in zip(cols, (doc, k, at, n, zlib.crc32(raw), part, seen[n])):
                        c.append(v)
                    seen[n] += 1
                    if keep_ids:
                        part_ids = ids[at:at + capacity]
                        if id_bytes == 2 and part_ids.max() > 0xFFFF:
                            raise ValueError("an id does not fit 2 bytes")
                        blobs.append(part_ids.astype(kept_type).tobytes())
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            if keep_ids:
                arrays.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECE + (", ids binary" if keep_ids else ""))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 4) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``keep_ids`` the ids (little-endian
    unsigned, 4 bytes each, or 2 where the vocabulary has at most 65,536 ids; a
    larger id is an error then)."""
    pieces = C.materialize(tokenized_pieces(docs, tokenizer_path, capacity, keep_ids, id_col, text_col, id_bytes), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = C.materialize(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")), "lengths")
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(solve(hist, capacity))
    shift = 1 << 44
    key = slots["length"] * shift + slots["rank"]
    sent = pieces.sparkSession.sparkContext.broadcast((key, slots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, t = sent.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, length * shift + rank, "right") - 1
            nth = rank - t["rank"][i]
            seq = t["seq"][i] + nth // t["per"][i]
            offset = t["offset"][i] + nth % t["per"][i] * length
            keep = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ranked = pieces.join(counts.select("part", "length", "earlier"), ["part", "length"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*cols, (F.col("earlier") + F.col("local_rank")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame, id_bytes: int = 4) -> DataFrame:
    """One row per sequence of ``pack_documents(keep_ids=True, id_bytes=..)``:
    sequence_id, its ids (at most ``capacity``, 4 bytes each), and in ``pieces``
    what lies where.  With ``id_bytes=2`` the exchange moves half as much."""
    kept_type = {2: "<u2", 4: "<u4"}[id_bytes]
    cols = ["sequence_id", "offset", "doc_id", "piece", "start", "length", "ids"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by sequence and offset: a sequence's ids are neighbours in
        the batch's buffer, so joining them is a matter of offsets."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            if not t.num_rows:
                continue
            seq = t["sequence_id"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(seq[1:] != seq[:-1]) + 1])
            held = t.slice(int(cuts[-1]))  # may go on in the next batch
            if len(cuts) > 1:
                yield whole(t.slice(0, int(cuts[-1])), cuts)
        if held is not None and held.num_rows:
            yield whole(held, np.array([0, held.num_rows]))

    def whole(t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        t = pa.concat_tables([t]).combine_chunks()
        ids = pa.concat_arrays(t["ids"].chunks)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
        wide = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kept_type).astype("<u4")
        ends = (ends - ends[0]) // id_bytes * 4
        joined = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts].tobytes()), pa.py_buffer(wide)])
        parts = pa.StructArray.from_arrays([pa.concat_arrays(t[c].chunks) for c in cols[1:-1]], cols[1:-1])
        return pa.RecordBatch.from_arrays([pa.array(t["sequence_id"].to_numpy()[cuts[:-1]]), joined,
                                           pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts)], ["sequence_id", "ids", "pieces"])

    rows = packed.select(*cols).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    piece = "offset: bigint, doc_id: bigint, piece: int, start: bigint, length: bigint"
    return rows.mapInArrow(join, f"sequence_id long, ids binary, pieces array<struct<{piece}>>")


def pieces_of(seqs: DataFrame) -> DataFrame:
    """The pieces in written sequences, with the checksum of the ids found there."""
    s = seqs.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return s.select("p.doc_id", "p.piece", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "sequence_id", "p.offset")
