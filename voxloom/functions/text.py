"""String expressions: Python-compatible strip, word transcripts, video ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom import vocab as V

__all__ = ["py_strip", "transcript_from_words", "video_id", "output_path", "list_literal", "shard_path"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Every character Python's str.isspace() accepts, derived by rule (29 code points).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(text) -> Column:
    """Remove leading and trailing whitespace the way ``str.strip()`` does
    (``trim`` with the full whitespace set; only the ends are scanned)."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def transcript_from_words(words) -> Column:
    """Keep ``type == 'word'`` entries and join their text with one space."""
    return F.array_join(F.transform(F.filter(_c(words), lambda w: w["type"] == "word"), lambda w: w["text"]), " ")


def video_id(url) -> Column:
    """First capture of the video-id pattern; NULL when the URL has none."""
    vid = F.regexp_extract(_c(url), V.VIDEO_ID_PATTERN, 1)
    return F.when(vid == "", F.lit(None).cast("string")).otherwise(vid)


def output_path(out_dir: str, vid, ext: str = "mp3") -> Column:
    """``<out_dir>/<id>.<ext>``; NULL when there is no id."""
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), _c(vid), F.lit("." + ext))


# A list of string literals.  All repeats are possessive: linear in the
# text, and no stack however long a list or a string is.
_ESCAPE = (r"\\(?!x(?![0-9A-Fa-f]{2})|u(?![0-9A-Fa-f]{4})|U(?!(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{4})|N)(?s:.)")
_STRING = "(?:" + "|".join(rf"{q}[^{q}\\\n\r]*+(?:{_ESCAPE}[^{q}\\\n\r]*+)*+{q}" for q in "'\"") + ")"
_COMMENT = r"#[^\n]*+"
_GAP = rf"(?:\s|{_COMMENT})*+"
_LIST = rf"^{_GAP}\[{_GAP}(?:{_STRING}{_GAP}(?:,{_GAP}{_STRING}{_GAP})*+(?:,{_GAP})?+)?+\]{_GAP}$"
_TOKEN = r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{1,3}|(?s:.))|[^\\]++"
#: fixed values: what one-letter escapes stand for
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v",
            "\\": "\\", "'": "'", '"': '"', "\n": ""}


def _unescaped(token: Column) -> Column:
    """One escape of a string literal, or a run without any, as text."""
    letter = F.substring(token, 2, 1)
    code = F.substring(token, 3, 8)

    def utf16(digits: Column) -> Column:
        return F.decode(F.unhex(F.lpad(digits, 4, "0")), "UTF-16BE")

    known = F.element_at(F.create_map(*(F.lit(x) for pair in _LETTERS.items() for x in pair)), letter)
    return (F.when(~token.startswith("\\"), token)
            .when(letter.isin("x", "u"), utf16(code))
            .when(letter == "U", F.decode(F.unhex(code), "UTF-32"))
            .when(letter.rlike("[0-7]"), utf16(F.conv(F.substring(token, 2, 3), 8, 16)))
            .otherwise(F.coalesce(known, token)))


def list_literal(text) -> Column:
    """A list literal of strings in single or double quotes, with escapes,
    comments, line breaks and a trailing comma, as ``array<string>``; NULL for
    anything else (other values, adjacent or prefixed strings, named
    characters, a list that does not close)."""
    t = _c(text)
    found = F.filter(F.regexp_extract_all(t, F.lit(f"{_STRING}|{_COMMENT}"), F.lit(0)), lambda x: ~x.startswith("#"))

    def value(x: Column) -> Column:
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        tokens = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
        return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(tokens, _unescaped), "")).otherwise(body)

    return F.when(t.rlike(_LIST), F.transform(found, value))


def shard_path(index, fmt: str = V.SHARD_PATH_FORMAT) -> Column:
    """S3: shard index -> file name; indexes below 1 map to shard 0.

    The zero padding is to six digits, which equals the reference's names for
    its whole index range (0..1139); indexes of 10,000 and more would get a
    seventh digit there, not here."""
    return F.format_string(fmt, F.greatest(_c(index), F.lit(0)))
