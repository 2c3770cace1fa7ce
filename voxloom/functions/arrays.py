"""Array expressions for token and codec-frame sequences.

Every function returns a Catalyst expression, so whole pipelines stay inside
whole-stage code generation.  Any computed array that a lambda body refers to
is first *let-bound* (``let``): Catalyst would otherwise substitute the
definition back into the lambda and recompute it per element, which turns
linear operators quadratic.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom import vocab as V

__all__ = [
    "let", "lit_array", "utf8_bytes", "byte_tokens", "flatten_frames", "unflatten_frames",
    "dedupe_frames", "frame_shape_ok", "codes_in_range", "assemble_plain", "assemble_speaker",
    "generation_prompt", "truncate", "segment_ids", "attention_mask", "mask_labels", "normalise_placeholder",
    "audio_span", "flatten_nested", "split_flat", "count_value", "checksum", "weighted_checksum", "frames_from_bytes",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (``transform(array(v), ..)[0]``)."""
    return F.transform(F.array(_c(value)), body).getItem(0)


def lit_array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def utf8_bytes(text) -> Column:
    """UTF-8 bytes of a string as ``array<int>`` (0..255), linear in the length.

    The bytes are decoded as ISO-8859-1, which maps every byte to one char of
    the same value, then split into chars; ``ascii`` returns each value.
    """
    latin1 = F.decode(F.encode(_c(text), "UTF-8"), "ISO-8859-1")
    return let(latin1, lambda s: F.when(s == "", F.array().cast("array<int>"))
               .otherwise(F.transform(F.split(s, ""), lambda ch: F.ascii(ch))))


def byte_tokens(text, bos: bool = True) -> Column:
    """Built-in text encoder: ``[start_of_text] + UTF-8 bytes`` (Q15 default)."""
    b = utf8_bytes(text)
    return F.concat(lit_array([V.START_OF_TEXT]), b) if bos else b


def frames_from_bytes(byte_arr, offset: int = V.AUDIO_OFFSET, slot0_div: int = 32) -> Column:
    """Stand-in flat code list: bytes cut in 7-slot frames, slot 0 ``div`` ``slot0_div``
    (so neighbouring frames repeat), each slot offset into its own codebook."""
    shift = slot0_div.bit_length() - 1
    if slot0_div <= 0 or (1 << shift) != slot0_div:
        raise ValueError("slot0_div must be a power of two")
    return F.transform(
        _c(byte_arr),
        lambda x, i: F.when(i % 7 == 0, F.shiftright(x, shift)).otherwise(x)
        + F.lit(offset) + (i % 7) * V.CODEBOOK_SIZE,
    )


def flatten_frames(c0, c1, c2, offset: int = V.AUDIO_OFFSET) -> Column:
    """Q1: three codec streams (n, 2n, 4n codes) -> flat 7-per-frame code list."""
    s = F.struct(_c(c0).alias("c0"), _c(c1).alias("c1"), _c(c2).alias("c2"))
    cb = V.CODEBOOK_SIZE

    def body(v):
        return F.flatten(F.transform(v["c0"], lambda x, i: F.array(
            x + offset,
            F.get(v["c1"], 2 * i) + (offset + cb),
            F.get(v["c2"], 4 * i) + (offset + 2 * cb),
            F.get(v["c2"], 4 * i + 1) + (offset + 3 * cb),
            F.get(v["c1"], 2 * i + 1) + (offset + 4 * cb),
            F.get(v["c2"], 4 * i + 2) + (offset + 5 * cb),
            F.get(v["c2"], 4 * i + 3) + (offset + 6 * cb),
        )))

    return let(s, body)


def unflatten_frames(codes, offset: int = V.AUDIO_OFFSET) -> Column:
    """Q2: flat code list -> ``struct(c0, c1, c2)`` with offsets removed.

    Whole frames are picked frame by frame (n/7 lambda calls); a list with a
    partial last frame is split by slot with filters, so its extra codes are
    still returned for the range check (P10) to see.
    """
    cb = V.CODEBOOK_SIZE

    def whole(v):
        nf = F.floor(F.size(v) / 7).cast("int")
        seq = F.sequence(F.lit(0), nf - 1)

        def pick(f, slot):
            return F.get(v, 7 * f + slot) - (offset + slot * cb)

        def per_frame(body):
            return F.when(nf == 0, F.array().cast("array<int>")).otherwise(body)

        return F.struct(
            per_frame(F.transform(seq, lambda f: pick(f, 0))).alias("c0"),
            per_frame(F.flatten(F.transform(seq, lambda f: F.array(pick(f, 1), pick(f, 4))))).alias("c1"),
            per_frame(F.flatten(F.transform(seq, lambda f: F.array(pick(f, 2), pick(f, 3), pick(f, 5), pick(f, 6)))))
            .alias("c2"))

    def by_slot(raw):
        return F.struct(
            F.filter(raw, lambda x, i: i % 7 == 0).alias("c0"),
            F.filter(raw, lambda x, i: (i % 7 == 1) | (i % 7 == 4)).alias("c1"),
            F.filter(raw, lambda x, i: (i % 7 == 2) | (i % 7 == 3) | (i % 7 == 5) | (i % 7 == 6)).alias("c2"),
        )

    def body(v):
        raw = F.transform(v, lambda x, i: x - F.lit(offset) - (i % 7) * cb)
        return F.when(F.size(v) % 7 == 0, whole(v)).otherwise(let(raw, by_slot))

    return let(_c(codes).cast("array<int>"), body)


def dedupe_frames(codes) -> Column:
    """Q3: drop frame i when its slot 0 equals slot 0 of frame i+1.

    The last frame of a run is kept; a trailing partial frame is kept; a frame
    is compared on slot 0 only.  The keep/drop decision is made once per frame
    and kept frames are copied as 7-code slices.
    """
    def body(v):
        n_frames = F.ceil(F.size(v) / 7).cast("int")
        frames = F.transform(
            F.sequence(F.lit(0), n_frames - 1),
            lambda f: F.when(F.coalesce(F.get(v, f * 7) == F.get(v, f * 7 + 7), F.lit(False)),
                             F.array().cast("array<int>")).otherwise(F.slice(v, f * 7 + 1, 7)))
        return F.when(F.size(v) == 0, v).otherwise(F.flatten(frames))

    return let(_c(codes).cast("array<int>"), body)


def frame_shape_ok(codes) -> Column:
    """The code count is a whole number of frames."""
    return F.size(_c(codes)) % V.SLOTS_PER_FRAME == 0


def codes_in_range(*streams) -> Column:
    """P10: every stream code is in ``[0, 4096)``."""
    cond = None
    for s in streams:
        s = _c(s)
        # no lambda per code; array_contains is NULL where a code is
        outside = (F.array_min(s) < 0) | (F.array_max(s) >= V.CODEBOOK_SIZE)
        c = F.when(outside, F.lit(False)).otherwise(~F.array_contains(s, -1))
        cond = c if cond is None else cond & c
    return cond


def assemble_plain(text_ids, audio) -> Column:
    """Q4: ``[SOH] + text + [EOT, EOH, SOG, SOA] + audio + [EOA, EOG]``."""
    return F.concat(lit_array(V.PLAIN_HEAD), _c(text_ids), lit_array(V.PLAIN_MIDDLE), _c(audio),
                    lit_array(V.TAIL))


def assemble_speaker(text_ids, audio, placeholder: int | Column = V.PLACEHOLDER) -> Column:
    """Q5: speaker prompt with one placeholder between start/end of speaker."""
    ph = placeholder if isinstance(placeholder, Column) else F.lit(int(placeholder))
    return F.concat(lit_array(V.PLAIN_HEAD), _c(text_ids), lit_array(V.SPEAKER_MIDDLE_1),
                    F.array(ph), lit_array(V.SPEAKER_MIDDLE_2), _c(audio), lit_array(V.TAIL))


def generation_prompt(text_ids, speaker: bool = False) -> Column:
    """Q6: prompt without audio and tail.  With ``speaker`` the result is
    ``struct(head, tail)``, split around the embedding position."""
    if not speaker:
        return F.concat(lit_array(V.PLAIN_HEAD), _c(text_ids), lit_array(V.PLAIN_MIDDLE))
    return F.struct(
        F.concat(lit_array(V.PLAIN_HEAD), _c(text_ids), lit_array(V.SPEAKER_MIDDLE_1)).alias("head"),
        lit_array(V.SPEAKER_MIDDLE_2).alias("tail"),
    )


def truncate(ids, max_len: int, keep_tail: int = 0) -> Column:
    """Q7: keep the first ``max_len`` tokens.  With ``keep_tail=k`` a cut row
    keeps its last ``k`` tokens (e.g. the end-of-audio / end-of-gpt markers,
    D4) in place of the last ``k`` kept tokens."""
    if not keep_tail:
        return F.slice(_c(ids), 1, int(max_len))
    head, tail = int(max_len) - int(keep_tail), int(keep_tail)
    return let(ids, lambda v: F.when(F.size(v) <= max_len, v).otherwise(
        F.concat(F.slice(v, 1, head), F.slice(v, -tail, tail))))


def segment_ids(row_lengths) -> Column:
    """Per-token number of the packed row it came from, from the packer's
    ``row_lengths`` (for attention masks that keep packed rows apart)."""
    return F.flatten(F.transform(_c(row_lengths), lambda n, i: F.array_repeat(i, n)))


def attention_mask(ids) -> Column:
    """Q8: ones, same length as the tokens."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def mask_labels(ids, placeholders=(V.PLACEHOLDER, V.IGNORE_LABEL)) -> Column:
    """Q10: placeholder positions -> -100 in the labels."""
    ph = [int(p) for p in placeholders]
    return F.transform(_c(ids), lambda x: F.when(x.isin(ph), F.lit(V.IGNORE_LABEL)).otherwise(x))


def normalise_placeholder(ids) -> Column:
    """The alternative placeholder -100 becomes 128263."""
    return F.transform(_c(ids), lambda x: F.when(x == V.IGNORE_LABEL, F.lit(V.PLACEHOLDER)).otherwise(x))


def audio_span(tokens) -> Column:
    """Q11: tokens after the first start-of-audio (all tokens if absent), with
    one trailing end-of-audio removed."""
    def body(v):
        p = F.array_position(v, V.START_OF_AUDIO).cast("int")
        rest = F.when(p == 0, v).otherwise(F.slice(v, p + 1, F.greatest(F.size(v) - p, F.lit(0))))

        def drop_tail(r):
            return F.when(F.get(r, F.size(r) - 1) == V.END_OF_AUDIO, F.slice(r, 1, F.size(r) - 1)).otherwise(r)

        return let(rest, drop_tail)

    return let(tokens, body)


def flatten_nested(emb) -> Column:
    """Q13: ``[1, 1, d]`` nested embedding -> ``[d]``."""
    return F.flatten(F.flatten(_c(emb)))


def split_flat(flat, dim: int) -> Column:
    """Q14: ``d * k`` floats -> k vectors of ``d`` (k = 0 gives an empty array)."""
    def body(v):
        k = F.floor(F.size(v) / dim).cast("int")
        return F.when(k <= 0, F.array().cast(v_type_hint)).otherwise(
            F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(v, i * dim + 1, dim)))
    v_type_hint = "array<array<float>>"
    return let(flat, body)


def count_value(ids, value: int) -> Column:
    """Occurrences of ``value`` (P11 / P12 building block)."""
    if isinstance(ids, str):  # a column, not an expression to compute twice: no lambda per value
        return F.when(F.col(ids).isNotNull(), F.size(ids) - F.size(F.array_remove(ids, value))).otherwise(F.size(ids))
    return F.size(F.filter(_c(ids), lambda x: x == value))


CHECKSUM_BASE = 31
CHECKSUM_MOD = 1_000_000_007


def checksum(arr) -> Column:
    """Order-sensitive rolling checksum of an int array in one pass:
    ``acc = (acc * 31 + x) % 1000000007`` from 0 (truncated remainder)."""
    return F.aggregate(_c(arr), F.lit(0).cast("bigint"),
                       lambda acc, x: (acc * CHECKSUM_BASE + x) % CHECKSUM_MOD)


def weighted_checksum(arr) -> Column:
    """``sum(x * (i + 1))``: a checksum that long-form (exploded) rows can also
    compute with a plain ``sum``."""
    return F.aggregate(F.transform(_c(arr), lambda x, i: x.cast("bigint") * (i + 1)),
                       F.lit(0).cast("bigint"), lambda a, y: a + y)
