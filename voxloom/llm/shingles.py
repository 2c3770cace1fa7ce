"""Word-shingle fingerprints with numpy, whole batches at a time.

Words are maximal runs of bytes other than ASCII white space, with A-Z lowered.
A word's hash is a 64-bit polynomial over its bytes, mixed; a shingle's hash
combines the hashes of its five words in order.  Two different shingles share
a hash with probability about 2^-64."""

from __future__ import annotations

import numpy as np

K = 5
#: bytes hashed at once (the arrays stay in a core's cache)
CHUNK = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
INVERSE = pow(BASE, -1, 1 << 64)
_tables = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1), mod 2^64."""
    if len(_tables[base]) < n:
        steps = np.full(max(n, 2 * CHUNK), base, np.uint64)
        steps[0] = 1
        _tables[base] = np.cumprod(steps)
    return _tables[base][:n]


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of each word of ``data``: the polynomial of a word is a
    difference of prefix sums, moved back by its start."""
    b = np.frombuffer(data, np.uint8)
    on = np.zeros(len(b) + 2, bool)
    np.logical_not(_SPACE[b], out=on[1:-1])
    edge = np.flatnonzero(on[1:] != on[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.zeros(len(b) + 1, np.uint64)
    np.multiply((_LOWER if lower else _SAME)[b] + np.uint64(1), powers(BASE, len(b)), out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    vals = (sums[ends] - sums[starts]) * powers(INVERSE, int(starts[-1]) + 1)[starts]
    return mix(vals + (ends - starts).astype(np.uint64) * _PLACE[1]), starts


def long_word_hashes(data: bytes, lower: bool = True) -> np.ndarray:
    """``word_hashes`` of a long text, cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(word_hashes(data[at:end], lower)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def combine(w: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, sorted, of a document's word hashes."""
    if len(w) == 0:
        return w
    if len(w) < K:
        whole = np.full(1, len(w), np.uint64)
        for i in range(len(w)):
            whole = mix(whole * _PLACE[0] + w[i:i + 1])
        return whole
    return _distinct(_windows(w))


def _windows(w: np.ndarray) -> np.ndarray:
    """Hash of every K consecutive words."""
    m = max(0, len(w) - K + 1)
    acc = w[:m] * _PLACE[0]
    for k in range(1, K):
        acc += w[k:k + m] * _PLACE[k]
    return mix(acc)


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def shingle_sets(texts: list[str | None]):
    """Yield (number of words, sorted distinct shingle hashes) per text."""
    block: list[bytes] = []
    size = 0

    def flush():
        offsets = np.cumsum([0] + [len(t) + 1 for t in block])
        h, starts = word_hashes(b" ".join(block))
        cut = np.searchsorted(starts, offsets).tolist()
        shingles = _windows(h)
        for lo, hi in zip(cut[:-1], cut[1:]):
            yield hi - lo, _distinct(shingles[lo:hi - K + 1]) if hi - lo >= K else combine(h[lo:hi])

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > CHUNK:
            if block:
                yield from flush()
                block, size = [], 0
            w = long_word_hashes(data)
            yield len(w), combine(w)
            continue
        block.append(data)
        size += len(data)
        if size > CHUNK:
            yield from flush()
            block, size = [], 0
    if block:
        yield from flush()
