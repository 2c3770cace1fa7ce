"""Token counts by dynamic programming shared along a trie.

Pre-tokens are words (runs without ASCII white space) with a word-start mark.
The unigram model takes its pieces from a public vocabulary; a piece's
log-probability falls with its rank (Zipf), a character that no piece holds
costs as many tokens as it has UTF-8 bytes.  A word's count is that of its
most probable segmentation (fewer tokens, where equal).

Forward scores depend on the prefix alone.  A task inserts the distinct words
of a batch that it has not met into a trie and walks it depth first: in sorted
order the open path is a stack, so each shared prefix is scored once, and the
count at a word's end is stored.  Known words are looked up; the store is
bounded and starts anew when full, which changes the work, not the counts.

Defined results: a null, empty or blank text has 0 words and 0 tokens;
repeated rows are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C

MARK = "▁"
#: word counts kept per Python worker
STORE_LIMIT = 500_000

_LOADED: dict[str, "Unigram"] = {}


class Unigram:
    def __init__(self, pieces: list[str]) -> None:
        total = sum(1 / (i + 10) for i in range(len(pieces)))
        self.score = {p: -math.log((i + 10) * total) for i, p in reversed(list(enumerate(pieces))) if p}
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10
        self.store: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> "Unigram":
        """Pieces of a sentencepiece vocabulary, control and byte pieces left
        out; once per Python worker."""
        if path not in _LOADED:
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = cls([sp.id_to_piece(i) for i in range(sp.get_piece_size())
                                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])
        return _LOADED[path]

    def extend(self, s: str, best: list[float], count: list[int], start: int) -> None:
        """Forward scores of the prefixes of ``s`` longer than ``start``;
        ``best`` and ``count`` hold those up to it."""
        score, longest = self.score, self.longest
        for j in range(start + 1, len(s) + 1):
            top, n = best[j - 1] + self.unknown, count[j - 1] + len(s[j - 1].encode("utf-8", "surrogatepass"))
            for i in range(max(0, j - longest), j):
                p = score.get(s[i:j])
                if p is not None:
                    v = best[i] + p
                    if v > top or (v == top and count[i] + 1 < n):
                        top, n = v, count[i] + 1
            best.append(top)
            count.append(n)

    def insert(self, words: list[str]) -> None:
        """Depth-first walk of the trie of the words; stores their counts."""
        last, best, count = "", [0.0], [0]
        for w in sorted(words):
            s = MARK + w
            k, most = 0, min(len(s), len(last))
            while k < most and s[k] == last[k]:
                k += 1
            del best[k + 1:], count[k + 1:]
            self.extend(s, best, count, k)
            self.store[w] = count[-1]
            last = s


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_tokens."""
    C.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram.load(vocabulary_path)
        for b in batches:
            n_words, n_tokens = [], []
            for at in range(0, b.num_rows, 256):
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in b.column(1).slice(at, 256)]
                store = model.store
                new = {w for t in texts for w in t if w not in store}
                if len(store) + len(new) > STORE_LIMIT:
                    store.clear()
                    new = {w for t in texts for w in t}
                if new:
                    by_text = {w.decode("utf-8", "surrogatepass"): w for w in new}
                    model.insert(list(by_text))
                    for s, w in by_text.items():
                        store[w] = store.pop(s)
                for t in texts:
                    n_words.append(len(t))
                    n_tokens.append(sum(map(store.__getitem__, t)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             ["id", "n_words", "n_tokens"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return d.mapInArrow(run, "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
