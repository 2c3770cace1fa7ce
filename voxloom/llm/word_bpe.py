"""Fast use of the public word-level BPE vocabulary.

Most texts hold only characters of ASCII and the Latin-1 letters.  For those
the tokenizer's own normalisation and splitting come down to lower case and
one regular expression, so distinct pre-tokens go to the tokenizer's BPE model
once; the ids of words and pre-tokens are kept in bounded tables.  Any other text, and any that
holds an added token, goes through the whole tokenizer.  Both give the same
ids."""

from __future__ import annotations

import re
from array import array

import numpy as np

#: words and pre-tokens kept per Python worker; a table starts anew beyond that
WORD_LIMIT, PIECE_LIMIT = 400_000, 800_000

_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_ADDED = ("<|startoftext|>", "<|endoftext|>")
_LOADED: dict[str, "WordBpe"] = {}


class _Table(dict):
    """A bounded memo: a missing key is computed and kept."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.make(key)
        return out


class WordBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xC0, 0x100)]]
        mapped = {ord(c): level.pre_tokenize_str(c)[0][0] for c in chars}
        model = self.whole.model.tokenize
        piece = _Table(lambda t: array("H", [x.id for x in model(t.translate(mapped))]).tobytes(), PIECE_LIMIT)
        split = _SPLIT.findall

        def word(w: str) -> bytes:
            return piece[w] if w.isalpha() else b"".join([piece[t] for t in split(w)])

        self.table = _Table(word, WORD_LIMIT)

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        """One instance per Python worker and path."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def encode(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or any(a in text for a in _ADDED):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        ids = b"".join(map(self.table.__getitem__, text.lower().split()))
        return np.frombuffer(ids, np.uint16).astype(np.uint32)
