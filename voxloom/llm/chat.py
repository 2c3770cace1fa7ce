"""Chat formatting as prefix trees.

Conversations that share their first turns share their tokens: sorted by path
(the sequence of their turns), conversations lie in depth-first order of the
prefix tree, so one pass over a range of that order emits every turn once per
sequence.  A sequence row holds the tokens of several conversations, position
ids that restart at each branch, for each node the intervals of tokens it may
attend to (its ancestors and itself), and the intervals under the loss.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Control strings of this and
other common templates inside texts are broken by a backslash after their
first character; backslashes double, so unescaping is exact.

Equal conversations are one class.  Classes are range partitioned by path: a
first turn that a third of all conversations share spreads over many tasks,
each of which repeats the shared turns once per sequence.

Defined results: null roles and texts are empty; rows are ordered by turn (null
first), then role, then text, and repeated rows are turns of their own; an
empty table gives an empty result.  A conversation longer than ``MAX_TOKENS``
has a sequence of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C

MAX_TOKENS = 8192
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"

# fixed values: what chat templates use as control strings starts like this
_CONTROL = re.compile(r"(<)(\||/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level tokenizer, once per Python worker; strings of special
    tokens in a text are ordinary text."""
    if path not in _LOADED:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


SEQUENCE = ("token_ids array<int>, position_ids array<int>, node_start array<int>, node_end array<int>, node_parent array<int>, "
            "attention array<array<int>>, loss array<array<int>>, leaf_node array<int>, leaf_class array<string>")


class _Sequence:
    """One output row under construction."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.attention: list[list[int]] = []
        self.loss: list[list[int]] = []
        self.leaves: list[tuple[int, str]] = []
        self.path: list[tuple[str, str]] = []   # turns of the last conversation
        self.nodes: list[int] = []              # and their nodes

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < len(turns) and n < len(self.path) and turns[n] == self.path[n]:
            n += 1
        return n

    def add(self, turns: list[tuple[str, str]], keep: int, encoded: list[tuple[list[int], int, int]], cls: str) -> None:
        """``encoded``: tokens of the turns from ``keep`` on, with the interval
        of their text."""
        self.path, self.nodes = list(turns), self.nodes[:keep]
        for (role, _), (ids, a, b) in zip(turns[keep:], encoded):
            parent = self.nodes[-1] if self.nodes else -1
            first = len(self.ids)
            at = self.positions[self.end[parent] - 1] + 1 if parent >= 0 else 0
            self.ids += ids
            self.positions += range(at, at + len(ids))
            seen = list(self.attention[parent]) if parent >= 0 else []
            if seen and seen[-1] == first:      # the parent ends where this node starts
                seen[-1] = first + len(ids)
            else:
                seen += [first, first + len(ids)]
            self.attention.append(seen)
            self.loss.append([first + a, first + b] if role == LOSS_ROLE else [])
            self.start.append(first)
            self.end.append(first + len(ids))
            self.parent.append(parent)
            self.nodes.append(len(self.start) - 1)
        self.leaves.append((self.nodes[-1] if self.nodes else -1, cls))

    def row(self) -> tuple:
        return (self.ids, self.positions, self.start, self.end, self.parent, self.attention, self.loss,
                [n for n, _ in self.leaves], [c for _, c in self.leaves])


def _encode(tok, turn: tuple[str, str]) -> tuple[list[int], int, int]:
    role, text = turn
    parts = tok.encode_batch([f"{OPEN}{escape_role(role)}\n", escape(text), CLOSE], add_special_tokens=False)
    head, body, tail = (p.ids for p in parts)
    return head + body + tail, len(head), len(head) + len(body)


def conversation_table(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order), path, cls."""
    r = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    c = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    marks = F.transform("turns", lambda x: F.sha2(F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"), F.length(x["role"]).cast("string")).cast("binary"), 256))
    c = c.select("conv_id", "turns", marks.alias("marks"))
    return c.select("conv_id", "turns", F.array_join(F.transform("marks", lambda m: F.left(m, F.lit(16))), "").alias("path"),
                    F.sha2(F.array_join("marks", "").cast("binary"), 256).alias("cls"))


def format_conversations(convs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``convs``: rows of ``conversation_table``.  One row per sequence."""
    C.ready(convs.sparkSession)
    unique = convs.select("cls", "path", "turns").dropDuplicates(["cls"])
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = unique.repartitionByRange(parts, "path", "cls").sortWithinPartitions("path", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        seq, rows, held = _Sequence(), [], 0
        schema = pa.schema([(n, pa.list_(pa.int32())) for n in ("token_ids", "position_ids", "node_start", "node_end", "node_parent")]
                           + [(n, pa.list_(pa.list_(pa.int32()))) for n in ("attention", "loss")]
                           + [("leaf_node", pa.list_(pa.int32())), ("leaf_class", pa.list_(pa.string()))])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for cls, turns in zip(b.column(0).to_pylist(), b.column(1)):
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                keep = seq.shared(turns)
                new = [_encode(tok, t) for t in turns[keep:]]
                if seq.leaves and len(seq.ids) + sum(len(n[0]) for n in new) > max_tokens:
                    rows.append(seq.row())
                    held += len(seq.ids)
                    seq, new, keep = _Sequence(), [_encode(tok, t) for t in turns[:keep]] + new, 0
                seq.add(turns, keep, new, cls)
                if held > 1_000_000:
                    yield batch()
                    rows, held = [], 0
        if seq.leaves:
            rows.append(seq.row())
        if rows:
            yield batch()

    return ranged.select("cls", "turns").mapInArrow(run, SEQUENCE)


READ = "cls string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(sequences: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per class: what its conversation says, decoded from the sequences: turns
    from the tokens of its nodes, loss text from the loss intervals."""
    C.ready(sequences.sparkSession)
    turn = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE), re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)

        def text_of(ids: list[int]) -> str:
            return tok.decode(ids, skip_special_tokens=False) if ids else ""

        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                ids, memo = r["token_ids"], {}
                for node, cls in zip(r["leaf_node"], r["leaf_class"]):
                    chain = []
                    while node >= 0:
                        chain.append(node)
                        node = r["node_parent"][node]
                    said, loss = hashlib.sha256(), hashlib.sha256()
                    n_loss = n_all = 0
                    for i in reversed(chain):
                        if i not in memo:
                            whole = text_of(ids[r["node_start"][i]:r["node_end"][i]])
                            m = turn.fullmatch(whole)
                            under = r["loss"][i]
                            memo[i] = (f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode(), len(whole),
                                       unescape(text_of(ids[under[0]:under[1]])) if under else "")
                        told, chars, learned = memo[i]
                        said.update(told)
                        loss.update(learned.encode())
                        n_all += chars
                        n_loss += len(learned)
                    out.append((cls, len(chain), said.hexdigest(), n_loss, loss.hexdigest(), n_all))
            if out:
                cols = list(zip(*out))
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 ["cls", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return sequences.mapInArrow(run, READ)
