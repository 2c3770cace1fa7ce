"""Personal data by weak supervision, all in DataFrame functions.

Candidate spans come from regular expressions.  Five labelers vote on each
(1 personal, 0 not, -1 abstain): the strict pattern with its check, structure,
gazetteers, the words to the left, and the characters around.  One pass counts
the vote patterns over the whole corpus; expectation-maximisation on that
bounded table estimates the reliability of each labeler per kind, and a
logistic span classifier of votes and span and context features is fitted to the posteriors.  A second pass scores
every candidate inside its own row.  No shuffle carries text.

Defined results: a null text is empty and has no spans; base spans (strict
pattern and check) are always reported; added spans never overlap a base span;
repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm import common as C

KINDS = ("email", "ip", "card", "phone", "secret")
N_LABELERS = 5

# Java patterns.  Possessive repeats and look-behinds accept the same leftmost
# matches as the plain forms but try each run of characters only once, so long
# runs stay linear and need no deep stack.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: added candidates: written-out addresses, grouped numbers, opaque keys
EMAIL_SPOKEN = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,}+"
PHONE_GROUPED = r"(?<![0-9A-Za-z+.-])\+?(?:[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
#: a web token's dotted parts are one key; "=" ends a key (padding) or stands before it
_KEY = "A-Za-z0-9_+/-"
SECRET = rf"(?<![{_KEY}])(?:eyJ[{_KEY}]{{9,}}+=*+(?:\.\.?+[{_KEY}]++=*+)++|[{_KEY}]{{24,}}+=*+)"

#: fixed values: gazetteers and cue words
TLDS = "com org net edu gov mil int info biz io co de fr es uk it nl eu us ca".split()
PRIVATE_NETS = "0 127 255".split()
ISSUERS = "3 4 5 6".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ sk_ pk_ xoxb- xoxp- eyJ".split()
CUES = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": r"card|visa|master|amex|credit|payment|iban",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|cell|fax|whatsapp",
    "secret": r"token|secret|passw|api.?key|\bkey\b|bearer|auth",
}
ANTI_CUES = r"version|\bver\b|\bv\.|isbn|issn|\bdoi\b|section|chapter|page|sha1|sha256|md5|commit|checksum"

#: what the classifier sees of a span and its surroundings, besides the votes
FEATURES = ("f_digits", "f_long", "f_cases", "f_label", "f_closed")
CAND = ("array<struct<kind:int,start:int,end:int,base:boolean,v1:int,v2:int,v3:int,v4:int,v5:int,"
        + ",".join(f"{f}:boolean" for f in FEATURES) + ">>")
_HIT = "struct<start:int,end:int,v:string,before:string,after:string>"


#: characters of a text's blocks in ``redact``
TEXT_BLOCK = 512
#: items that one run of ``scan`` appends to one array
SCAN_BLOCK = 256


def scan(items: Column, zero: Column, state_type: str, advance, emit, emit_type: str) -> Column:
    """``emit(state, item)`` for every item, with ``state`` run over the items
    before it.  Appending to an array copies it, so items are taken in blocks:
    linear in the items, but for one array of blocks."""
    def step(acc: Column, x: Column) -> Column:
        return F.struct(advance(acc["s"], x).cast(state_type).alias("s"),
                        F.array_append(acc["out"], emit(acc["s"], x).cast(emit_type)).cast(f"array<{emit_type}>").alias("out"))

    def over(block: Column, state: Column) -> Column:
        return F.aggregate(block, F.struct(state.cast(state_type).alias("s"), F.array().cast(f"array<{emit_type}>").alias("out")), step)

    def blocks(v: Column) -> Column:
        count = F.floor((F.size(v) - 1) / SCAN_BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(v, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)))

    def outer(acc: Column, block: Column) -> Column:
        done = F.transform(F.array(over(block, acc["s"])), lambda r: F.struct(
            r["s"].alias("s"), F.array_append(acc["out"], r["out"]).cast(f"array<array<{emit_type}>>").alias("out")))
        return F.get(done, F.lit(0))

    start = F.struct(zero.cast(state_type).alias("s"), F.array().cast(f"array<array<{emit_type}>>").alias("out"))
    whole = F.get(F.transform(F.array(items), lambda v: F.flatten(F.aggregate(blocks(v), start, outer)["out"])), F.lit(0))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(f"array<{emit_type}>"))


def found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` with code-point positions and nearby text: the
    gaps between matches and the matches, walked in step."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits,
                   lambda g, v: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(32)).alias("before"), v.alias("v"))),
        F.slice(gaps, F.lit(2), F.size(hits)),
        lambda x, g: F.struct(x["gap"].alias("gap"), x["before"].alias("before"), x["v"].alias("v"), F.left(g, F.lit(1)).alias("after")))
    return scan(steps, F.lit(0), "int", lambda pos, x: pos + x["gap"] + F.length(x["v"]),
                lambda pos, x: F.struct((pos + x["gap"]).alias("start"), (pos + x["gap"] + F.length(x["v"])).alias("end"),
                                        x["v"].alias("v"), x["before"].alias("before"), x["after"].alias("after")), _HIT)


def n_digits(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]+", ""))


def luhn(v: Column) -> Column:
    rev = F.regexp_extract_all(F.reverse(v), F.lit("[0-9]"), F.lit(0))

    def part(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(rev, part), F.lit(0), lambda s, x: s + x) % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: F.when(n_digits(v).between(13, 19), luhn(v)).otherwise(False),
    "phone": lambda v: n_digits(v).between(9, 15),
    "secret": lambda v: F.lit(False),
}


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.otherwise(0) if no is None else out.when(no, 0).otherwise(-1)).cast("int")


def _structure(kind: str, v: Column) -> Column:
    return {
        "email": lambda: _vote(F.length(v) <= 254, F.length(v) > 254),
        "ip": lambda: _vote(CHECKS["ip"](v)),
        "card": lambda: _vote(v.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$")),
        "phone": lambda: _vote(v.rlike(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$") & n_digits(v).between(9, 15)),
        "secret": lambda: _vote(v.rlike("[0-9]") & v.rlike("[A-Za-z]") & v.rlike(  # possessive: linear in a key of any length
            r"^[a-f0-9]++$|^[^A-Z]*+[A-Z][^a-z]*+[a-z][^0-9]*+[0-9]|^[^0-9]*+[0-9][^A-Z]*+[A-Z]")),
    }[kind]()


def _gazetteer(kind: str, v: Column) -> Column:
    return {
        "email": lambda: _vote(F.lower(F.substring_index(F.regexp_replace(v, r"[\[(](?i:dot)[\])]\x20?", "."), ".", -1)).isin(TLDS)),
        "ip": lambda: _vote(~F.substring_index(v, ".", 1).isin(PRIVATE_NETS), F.substring_index(v, ".", 1).isin(PRIVATE_NETS)),
        "card": lambda: _vote(F.substring(v, 1, 1).isin(ISSUERS), ~F.substring(v, 1, 1).isin(ISSUERS)),
        "phone": lambda: _vote(v.startswith("+"), F.lit(False)),
        "secret": lambda: _vote(v.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), F.lit(False)),
    }[kind]()


def _candidate(kind: str, x: Column, strict: bool) -> Column:
    v, before = x["v"], F.lower(x["before"])
    base = CHECKS[kind](v) if strict else F.lit(False)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), base.alias("base"),
        _vote(base).alias("v1"), _structure(kind, v).alias("v2"), _gazetteer(kind, v).alias("v3"),
        _vote(before.rlike(f"(?:{CUES[kind]})[^\\n]{{0,16}}$"), before.rlike(f"(?:{ANTI_CUES})[^\\n]{{0,12}}$")).alias("v4"),
        _vote((F.length(before) == 0) | before.rlike(r"[\s\"'(\[<:=,;.|]$")
              if kind != "card" else ~before.rlike(r"[\p{L}_.#]$")).alias("v5"),
        *(c.alias(f) for f, c in zip(FEATURES, (
            n_digits(v) * 2 >= F.length(v), F.length(v) >= 20, v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]"),
            x["before"].rlike(r"[:=]\s*[\"'(]?$"), x["after"].rlike(r"^$|[\s,;:!?)\]>\"']")))))


def _voted(kind: str, strict: bool):
    return lambda x: _candidate(kind, x, strict)


_SEARCHES = (  # kind, pattern, strict, a cheap test that a text may match; all but email need a digit
    ("email", EMAIL, True, lambda t: F.contains(t, F.lit("@"))),
    ("email", EMAIL_SPOKEN, False, lambda t: t.rlike(r"[\[(](?:at|AT)[\])]")),
    ("ip", IP, True, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", CARD, True, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    ("phone", PHONE, True, lambda t: F.contains(t, F.lit("+"))),
    ("phone", PHONE_GROUPED, False, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    ("secret", SECRET, False, lambda t: t.rlike(rf"(?<![{_KEY}])(?:[{_KEY}]{{24}}|eyJ[{_KEY}]{{9}})")),
)


def candidates(text: Column, digits: Column) -> Column:
    """``digits`` tells whether the text has a digit.  All candidate spans of a text with the labelers' votes, in the order of
    ``_SEARCHES``, then start.  A card match of too few digits is no candidate
    (numbers of every length would match)."""
    none = F.array().cast(CAND)
    parts = []
    for kind, pattern, strict, maybe in _SEARCHES:
        hits = found(text, pattern)
        if kind == "card":
            hits = F.filter(hits, lambda x: n_digits(x["v"]).between(13, 19))
        test = maybe(text) if kind == "email" else digits & maybe(text)
        parts.append(F.when(test, F.transform(hits, _voted(kind, strict)).cast(CAND)).otherwise(none))
    return F.concat(*parts)


def with_candidates(docs: DataFrame, keep: list[str], text_col: str, out: str) -> DataFrame:
    """``keep`` and the candidates of ``text_col`` as ``out``."""
    digits = C.free_name([*docs.columns, out], "has_digits")
    cols = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.withColumn(digits, text.rlike("[0-9]"))
    return d.select(*cols, candidates(text, F.col(digits)).alias(out))


@dataclass(frozen=True)
class SpanModel:
    """``accuracy[kind][labeler]`` = (share of 1 votes on personal spans, on
    others); ``weights[kind]`` = bias, one weight for each labeler's 1 and
    0 vote, then one for each of ``FEATURES``."""
    prior: dict[int, float]
    accuracy: dict[int, list[tuple[float, float]]]
    weights: dict[int, list[float]]


def vote_counts(cands: DataFrame, col: str = "cand") -> list[tuple]:
    """(kind, v1..v5, features, count): at most len(KINDS) * 3 ** 5 * 2 ** 5 rows
    whatever the corpus, so they may be collected."""
    c = cands.select(F.explode(col).alias("c"))
    keys = ["kind", *(f"v{i + 1}" for i in range(N_LABELERS)), *FEATURES]
    return sorted(tuple(int(x) for x in r) for r in c.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).count().collect())


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(patterns: list[tuple], rounds: int = 40) -> SpanModel:
    """EM over the vote patterns of each kind (labelers independent given the
    truth, each at least as good as chance), then a logistic classifier of votes
    and features on the posteriors, weighted by how often each pattern occurs.
    The features take no part in the votes, so the classifier can tell spans
    apart on which the labelers agree.  Patterns are (kind, v1..v5, features.., count)."""
    prior: dict[int, float] = {}
    acc: dict[int, list[tuple[float, float]]] = {}
    weights: dict[int, list[float]] = {}
    for kind in range(len(KINDS)):
        mine = [p for p in patterns if p[0] == kind]
        by_votes: dict[tuple, int] = {}
        for p in mine:
            by_votes[p[1:1 + N_LABELERS]] = by_votes.get(p[1:1 + N_LABELERS], 0) + p[-1]
        rows = sorted(by_votes.items())
        total = sum(n for _, n in rows)
        pi, ab = 0.5, [(0.8, 0.2)] * N_LABELERS
        post: list[float] = []
        for _ in range(rounds if rows else 0):
            post = []
            for votes, _n in rows:
                lo = math.log(pi / (1 - pi))
                for v, (a, b) in zip(votes, ab):
                    if v >= 0:
                        lo += math.log(a / b) if v else math.log((1 - a) / (1 - b))
                post.append(_sigmoid(lo))
            mass = sum(q * n for q, (_, n) in zip(post, rows))
            pi = min(0.95, max(0.05, (mass + 1) / (total + 2)))
            new = []
            for j in range(N_LABELERS):
                t1 = sum(q * n for q, (v, n) in zip(post, rows) if v[j] == 1)
                t = sum(q * n for q, (v, n) in zip(post, rows) if v[j] >= 0)
                f1 = sum((1 - q) * n for q, (v, n) in zip(post, rows) if v[j] == 1)
                f = sum((1 - q) * n for q, (v, n) in zip(post, rows) if v[j] >= 0)
                # eight pseudo votes; clamped so that a labeler never turns round
                a, b = (t1 + 6.4) / (t + 8), (f1 + 1.6) / (f + 8)
                new.append((min(0.98, max(0.5, a)), min(0.5, max(0.02, b))))
            ab = new
        prior[kind], acc[kind] = pi, ab
        weights[kind] = _logistic(mine, dict(zip((v for v, _ in rows), post)))
    return SpanModel(prior, acc, weights)


def _logistic(patterns: list[tuple], post: dict[tuple, float], steps: int = 400) -> list[float]:
    if not patterns:
        return [0.0] * (1 + 2 * N_LABELERS)
    votes = np.array([p[1:1 + N_LABELERS] for p in patterns])
    x = np.column_stack([np.ones(len(votes)), *(votes[:, j] == s for j in range(N_LABELERS) for s in (1, 0)),
                         np.array([p[1 + N_LABELERS:-1] for p in patterns])]).astype(float)
    n = np.array([p[-1] for p in patterns], float)
    q = np.array([post[p[1:1 + N_LABELERS]] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) - q
        w -= 2.0 * (x.T @ (e * n) / n.sum() + 1e-3 * w)
    return w.tolist()


def span_score(model: SpanModel, c: Column) -> Column:
    """Probability that candidate ``c`` is personal data."""
    out = F.lit(0.0)
    for kind, w in model.weights.items():
        z = F.lit(w[0])
        for j in range(N_LABELERS):
            v = c[f"v{j + 1}"]
            z = z + F.when(v == 1, w[1 + 2 * j]).when(v == 0, w[2 + 2 * j]).otherwise(0.0)
        for f, weight in zip(FEATURES, w[1 + 2 * N_LABELERS:]):
            z = z + F.when(c[f], weight).otherwise(0.0)
        out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def find_pii(docs: DataFrame, id_cols: list[str] | None = None, text_col: str = "text",
             model: SpanModel | None = None) -> DataFrame:
    """``id_cols`` plus ``base`` and ``spans``: arrays of (kind, start, end,
    score), kinds as in ``KINDS``, ordered by kind, then start."""
    id_cols = ["doc_id"] if id_cols is None else id_cols
    cand = with_candidates(docs, id_cols, text_col, "cand")
    if model is None:
        model = fit(vote_counts(cand))

    def span(c: Column, score: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score.alias("score"))

    base = F.transform(F.filter("cand", lambda c: c["base"]), lambda c: span(c, F.lit(1.0)))
    extra = F.transform(F.filter("cand", lambda c: ~c["base"] & (span_score(model, c) >= 0.5)),
                        lambda c: span(c, span_score(model, c)))
    d = cand.select(*id_cols, F.sort_array(base).alias("base"), extra.alias("extra"))
    d = d.select(*id_cols, "base", F.when(F.size("extra") > 0, free_spans(F.col("base"), F.col("extra"))).otherwise(F.col("extra")).alias("extra"))
    return d.select(*id_cols, "base", F.sort_array(F.concat("base", "extra")).alias("spans"))


_SPAN = "struct<kind:int,start:int,end:int,score:double>"
_RANKED = "struct<start:int,end:int,level:int,kind:int,score:double>"


def free_spans(base: Column, extra: Column) -> Column:
    """The ``extra`` spans that overlap no base span and no extra span earlier
    by (kind, start): one pass over all spans by position and one back.

    A span's level is 0 (base) or its kind + 1.  Going forward, it is shadowed
    if a span of its own or a lower level reaches into it; going back, if one of
    a lower level starts inside it.  Each pass keeps one number per level."""
    levels = len(KINDS) + 1

    def ranked(spans: Column, is_base: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), (F.lit(0) if is_base else x["kind"] + 1).alias("level"),
            x["kind"].alias("kind"), x["score"].alias("score")).cast(_RANKED))

    state = "struct<" + ",".join(f"r{i}:int" for i in range(levels)) + ">"

    def start_state(v: int) -> Column:
        return F.struct(*(F.lit(v).alias(f"r{i}") for i in range(levels)))

    def put(s: Column, x: Column, better, col: str) -> Column:
        return F.struct(*(F.when(x["level"] == i, better(s[f"r{i}"], x[col])).otherwise(s[f"r{i}"]).alias(f"r{i}") for i in range(levels)))

    def over(s: Column, x: Column, own: bool) -> list[Column]:
        return [((x["level"] >= i) if own else (x["level"] > i), s[f"r{i}"]) for i in range(levels)]

    def forward(s: Column, x: Column) -> Column:
        reach = F.greatest(*(F.when(on, r).otherwise(-1) for on, r in over(s, x, True)))
        return F.when((x["level"] == 0) | (reach <= x["start"]), x)

    def back(s: Column, x: Column) -> Column:
        first = F.least(*(F.when(on, r).otherwise(2 ** 31 - 1) for on, r in over(s, x, False)))
        return F.struct(x.alias("x"), ((x["level"] > 0) & (first >= x["end"])).alias("free"))

    ordered = F.sort_array(F.concat(ranked(base, True), ranked(extra, False)))
    # a shadowed span still shadows: the passes read all spans and mark them
    marked = scan(ordered, start_state(-1), state, lambda s, x: put(s, x, F.greatest, "end"),
                  lambda s, x: F.struct(x.alias("x"), forward(s, x).isNotNull().alias("free")), f"struct<x:{_RANKED},free:boolean>")
    marked = scan(F.reverse(marked), start_state(2 ** 31 - 1), state, lambda s, m: put(s, m["x"], F.least, "start"),
                  lambda s, m: F.struct(m["x"].alias("x"), (m["free"] & back(s, m["x"])["free"]).alias("free")),
                  f"struct<x:{_RANKED},free:boolean>")
    return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: F.struct(
        m["x"]["kind"].alias("kind"), m["x"]["start"].alias("start"), m["x"]["end"].alias("end"),
        m["x"]["score"].alias("score")).cast(_SPAN))


def span_string(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """The input with every span replaced by ``[KIND]``; null texts stay null.
    All other columns and their order are kept."""
    spans = C.free_name(docs.columns, "pii_spans")
    cand = C.free_name([*docs.columns, spans], "pii_cand")
    if model is None:
        model = fit(vote_counts(with_candidates(docs, [], text_col, cand), cand))
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    d = with_candidates(docs, docs.columns, text_col, cand)
    # by position; a span that starts inside an earlier one only extends it
    hits = F.sort_array(F.transform(F.filter(cand, lambda c: c["base"] | (span_score(model, c) >= 0.5)),
                                    lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    # the text in blocks: a piece is cut from the blocks it lies in, not from the text's start
    blocks = C.free_name([*docs.columns, spans, cand], "pii_blocks")
    text = F.col(f"`{text_col}`")
    d = d.select(*quoted, hits.alias(spans), F.when(F.size(hits) > 0, F.regexp_extract_all(
        text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))).alias(blocks))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(start: Column, end: Column) -> Column:
        first, last = F.floor(start / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(part, start - first * TEXT_BLOCK + 1, end - start)).otherwise("")

    # (where the text before goes on from, and the span, if it starts behind all earlier ones)
    told = scan(F.col(spans), F.lit(0), "int", lambda pos, s: F.greatest(pos, s["end"]),
                lambda pos, s: F.struct(pos.alias("pos"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
                "struct<pos:int,start:int,end:int,kind:int>")
    pieces = F.transform(F.filter(told, lambda s: s["start"] >= s["pos"]),
                         lambda s: F.concat(cut(s["pos"], s["start"]), F.get(names, s["kind"])))
    done = F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))
    new = F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(done)
    return d.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
