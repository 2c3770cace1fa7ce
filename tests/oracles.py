"""Plain-Python reference implementations used by the tests."""

from __future__ import annotations

import math

START_OF_AUDIO, END_OF_AUDIO = 128257, 128258


def dedupe_frames(codes: list[int]) -> list[int]:
    """Drop frame i when its slot 0 equals slot 0 of frame i+1 (partial last frame kept)."""
    c0 = codes[::7]
    drop = set()
    for i in range(len(c0) - 1):
        if c0[i] == c0[i + 1]:
            drop.update(range(i * 7, i * 7 + 7))
    return [x for j, x in enumerate(codes) if j not in drop]


def next_fit(lengths: list[int], limit: int) -> list[int]:
    """Bin of every row; empty bins never counted, oversized rows alone."""
    bins, cur, fill = [], -1, None
    for n in lengths:
        if fill is None or fill + n > limit:
            cur += 1
            fill = n
        else:
            fill += n
        bins.append(cur)
    return bins


def reference_pack(rows: list[list[int]], limit: int) -> list[list[int]]:
    """The reference loop (emits an empty first bin on an oversized first row,
    never emits the last bin)."""
    out, cur, last = [], 0, []
    for ids in rows:
        if cur + len(ids) <= limit:
            last = last + ids
            cur += len(ids)
        else:
            out.append(last)
            last, cur = list(ids), len(ids)
    return out


def audio_span(tokens: list[int]) -> list[int]:
    if START_OF_AUDIO in tokens:
        tokens = tokens[tokens.index(START_OF_AUDIO) + 1:]
    if tokens and tokens[-1] == END_OF_AUDIO:
        tokens = tokens[:-1]
    return tokens


def resample_linear(v: list[float], sr: int, target: int = 24000) -> list[float]:
    if sr == target:
        return list(v)
    s = target / sr
    n = math.floor(len(v) * s)
    out = []
    for i in range(n):
        x = max((i + 0.5) / s - 0.5, 0.0)
        x0 = math.floor(x)
        x1 = min(x0 + 1, len(v) - 1)
        w = x - x0
        out.append(v[x0] * (1 - w) + v[x1] * w)
    return out


def contiguous_shard(idx: int, n: int, shards: int) -> int:
    q, m = divmod(n, shards)
    for k in range(shards):
        start = k * q + min(k, m)
        end = start + q + (1 if k < m else 0)
        if start <= idx < end:
            return k
    raise ValueError(idx)
