"""Registered queries: one Spark plan per operator family and, where SQL can
express it, the equivalent DuckDB SQL used as an independent oracle.

Every query reads the driver tables (or stand-ins Spark derives from them)
whole.  Integer outputs are BIGINT on both sides, doubles are rounded, and all
computed columns are aliased to the same names.
"""

from __future__ import annotations

import itertools
import uuid
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom import vocab as V
from voxloom.functions import arrays as A
from voxloom.functions import text as TX
from voxloom.operators import align, frames as FR, ingest, packing, prompts as PR, sampling, segments as SEG, waveform as WV
from voxloom.operators.inference import RetryPolicy, call_with_retry, encode_text, project_embeddings
from voxloom.plans import fixtures as FX, paths as PATHS
from voxloom import streaming
from voxloom.session import checkpoint_dir, written
from voxloom.sources import readers, sealed, sinks

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _signed_zero_safe(sql: str) -> str:
    """Rewrite every ``round(...)`` as ``(round(...) + 0.0)`` so a rounded -0.0
    reads as 0.0, as on the Spark side."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "(round(" + _signed_zero_safe(sql[j + 6:k]) + ") + 0.0)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _signed_zero_safe(sql.strip())
        return fn
    return deco


def _long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def _round(c, n: int):
    """Rounded double with -0.0 folded to 0.0."""
    return F.round(c, n) + F.lit(0.0)


# --------------------------------------------------------------------------
# DuckDB building blocks (oracle side)
# --------------------------------------------------------------------------
BYTES_SQL = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INTEGER)"
CODES_SQL = ("list_transform(b, lambda x, i: (CASE WHEN (i - 1) % 7 = 0 THEN x // 32 ELSE x END)"
             " + 128266 + 4096 * ((i - 1) % 7))")
DEDUPE_SQL = ("list_filter(codes, lambda x, i: NOT coalesce(codes[((i - 1) // 7) * 7 + 1]"
              " = codes[((i - 1) // 7) * 7 + 8], false))")


def ck(expr: str) -> str:
    """Oracle side of ``functions.arrays.checksum``."""
    return f"list_reduce({expr}, lambda acc, x: (acc * 31 + x) % 1000000007, 0::BIGINT)"


def ck_weighted(expr: str) -> str:
    """Oracle side of ``functions.arrays.weighted_checksum``."""
    return f"coalesce(list_sum(list_transform({expr}, lambda x, i: x::BIGINT * i)), 0)::BIGINT"


DOC_CTE = f"""
db AS (SELECT doc_id, text, lang, source, {BYTES_SQL} AS b FROM documents),
dc AS (SELECT doc_id, text, lang, [128000] || b AS text_ids, {CODES_SQL} AS codes FROM db),
dd AS (SELECT doc_id, lang, text_ids, codes, {DEDUPE_SQL} AS dedup FROM dc)
"""

SPEAKER_SQL = "[128259] || text_ids || [128009, 128260, 128264] || [{ph}] || [128265, 128261, 128257] || dedup || [128258, 128262]"
PLAIN_SQL = "[128259] || text_ids || [128009, 128260, 128261, 128257] || codes || [128258, 128262]"


# --------------------------------------------------------------------------
# Flagship: documents -> byte tokens -> codes -> dedupe -> speaker prompt -> stats
# --------------------------------------------------------------------------
def speaker_prompt_stats_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    ids = rows.select("lang", A.assemble_speaker("text_ids", A.dedupe_frames("codes_list")).alias("ids"))
    per_row = ids.select("lang", F.size("ids").alias("n_ids"), A.count_value("ids", V.PLACEHOLDER).alias("n_ph"))
    return per_row.groupBy("lang").agg(
        F.count("*").cast("long").alias("n_rows"),
        F.sum("n_ids").cast("long").alias("total_tokens"),
        F.max("n_ids").cast("long").alias("max_tokens"),
        _round(F.avg("n_ids"), 6).alias("avg_tokens"),
        F.sum(F.when(F.col("n_ph") != 1, 1).otherwise(0)).cast("long").alias("bad_placeholder_rows"))


register("speaker_prompt_stats", f"""
WITH {DOC_CTE},
p AS (SELECT lang, {SPEAKER_SQL.format(ph=128263)} AS ids FROM dd)
SELECT lang, count(*)::BIGINT AS n_rows, sum(len(ids))::BIGINT AS total_tokens, max(len(ids))::BIGINT AS max_tokens,
       round(avg(len(ids)), 6) AS avg_tokens,
       sum(CASE WHEN len(list_filter(ids, lambda x: x = 128263)) <> 1 THEN 1 ELSE 0 END)::BIGINT AS bad_placeholder_rows
FROM p GROUP BY lang
""")(speaker_prompt_stats_df)


# --------------------------------------------------------------------------
# Q15 text -> tokens
# --------------------------------------------------------------------------
@register("byte_tokens", f"""
WITH {DOC_CTE}
SELECT doc_id, len(text_ids)::BIGINT AS n_tokens, {ck('text_ids')} AS ids_ck FROM dc
""")
def byte_tokens(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents", spread=True)
    return d.select("doc_id", A.byte_tokens("text").alias("ids")).select(
        "doc_id", _long(F.size("ids")).alias("n_tokens"), A.checksum("ids").alias("ids_ck"))


@register("byte_encoder_stage", f"""
WITH {DOC_CTE}
SELECT doc_id, len(text_ids)::BIGINT AS n_tokens, {ck('text_ids')} AS ids_ck FROM dc
""")
def byte_encoder_stage(spark, sf_dir):
    """M1 path: the same encoder run as a Python batch stage (one encoder per task)."""
    d = FX.table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    enc = encode_text(d, "text", "ids")
    return enc.select("doc_id", _long(F.size("ids")).alias("n_tokens"), A.checksum("ids").alias("ids_ck"))


# --------------------------------------------------------------------------
# Codec frames
# --------------------------------------------------------------------------
STREAMS_CTE = f"""
db AS (SELECT doc_id, {BYTES_SQL} AS b FROM documents),
fs AS (SELECT doc_id, b, (len(b) // 7) * 7 AS nfull FROM db),
st AS (SELECT doc_id,
  list_filter(b, lambda x, i: i <= nfull AND (i - 1) % 7 = 0) AS c0,
  list_filter(b, lambda x, i: i <= nfull AND (i - 1) % 7 IN (1, 4)) AS c1,
  list_filter(b, lambda x, i: i <= nfull AND (i - 1) % 7 IN (2, 3, 5, 6)) AS c2 FROM fs)
"""


FLAT_SQL = """flatten(list_transform(c0, lambda x, i: [
  x + 128266, c1[2 * i - 1] + 128266 + 4096, c2[4 * i - 3] + 128266 + 8192, c2[4 * i - 2] + 128266 + 12288,
  c1[2 * i] + 128266 + 16384, c2[4 * i - 1] + 128266 + 20480, c2[4 * i] + 128266 + 24576]))"""


@register("frame_flatten", f"""
WITH {STREAMS_CTE},
fl AS (SELECT doc_id, len(c0) AS nf, {FLAT_SQL} AS flat FROM st)
SELECT doc_id, nf::BIGINT AS n_frames, len(flat)::BIGINT AS n_codes, {ck('flat')} AS flat_ck FROM fl
""")
def frame_flatten(spark, sf_dir):
    s = FX.codec_streams(spark, sf_dir)
    flat = A.flatten_frames("c0", "c1", "c2")
    return s.select("doc_id", F.size("c0").alias("nf"), flat.alias("flat")).select(
        "doc_id", _long("nf").alias("n_frames"), _long(F.size("flat")).alias("n_codes"), A.checksum("flat").alias("flat_ck"))


@register("frame_roundtrip", f"""
WITH {STREAMS_CTE},
fr AS (SELECT doc_id, c0, c1, c2, list_transform({FLAT_SQL}, lambda x, i: x - 128266 - 4096 * ((i - 1) % 7)) AS raw FROM st)
SELECT doc_id, len(c0)::BIGINT AS n_frames, (len(raw) % 7 = 0) AS shape_ok,
  (list_bool_and(list_transform(raw, lambda x: x >= 0 AND x < 4096)) IS NOT false) AS range_ok,
  (list_filter(raw, lambda x, i: (i - 1) % 7 = 0) = c0 AND list_filter(raw, lambda x, i: (i - 1) % 7 IN (1, 4)) = c1
   AND list_filter(raw, lambda x, i: (i - 1) % 7 IN (2, 3, 5, 6)) = c2) AS roundtrip_ok,
  {ck('c0')} AS c0_ck, {ck('c1')} AS c1_ck, {ck('c2')} AS c2_ck FROM fr
""")
def frame_roundtrip(spark, sf_dir):
    s = FX.codec_streams(spark, sf_dir)
    flat = s.select("doc_id", "c0", "c1", "c2", A.flatten_frames("c0", "c1", "c2").alias("flat"))
    back = flat.select("doc_id", "c0", "c1", "c2", "flat", A.unflatten_frames("flat").alias("u"))
    return back.select(
        "doc_id", _long(F.size("u.c0")).alias("n_frames"), A.frame_shape_ok("flat").alias("shape_ok"),
        A.codes_in_range("u.c0", "u.c1", "u.c2").alias("range_ok"),
        ((F.col("u.c0") == F.col("c0")) & (F.col("u.c1") == F.col("c1")) & (F.col("u.c2") == F.col("c2"))).alias("roundtrip_ok"),
        A.checksum("u.c0").alias("c0_ck"), A.checksum("u.c1").alias("c1_ck"), A.checksum("u.c2").alias("c2_ck"))


@register("frame_dedupe", f"""
WITH {DOC_CTE}
SELECT doc_id, len(codes)::BIGINT AS n_before, len(dedup)::BIGINT AS n_after, {ck('dedup')} AS dedup_ck FROM dd
""")
def frame_dedupe(spark, sf_dir):
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    return b.select("doc_id", "codes_list", A.dedupe_frames("codes_list").alias("d")).select(
        "doc_id", _long(F.size("codes_list")).alias("n_before"), _long(F.size("d")).alias("n_after"),
        A.checksum("d").alias("dedup_ck"))


@register("frame_dedupe_long", f"""
WITH {DOC_CTE}
SELECT doc_id, len(codes)::BIGINT AS n_before, len(dedup)::BIGINT AS n_after, {ck_weighted('dedup')} AS dedup_ck FROM dd
""")
def frame_dedupe_long(spark, sf_dir):
    """The same dedupe in long form, from code arrays."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False).select("doc_id", "codes_list")
    return _kept_stats(b, FR.dedupe_frames_long(b, "doc_id", "codes_list"))


@register("frame_dedupe_rows", ORACLE["frame_dedupe_long"])
def frame_dedupe_rows(spark, sf_dir):
    """W1 on a table of frame rows: frame i meets frame i+1 in its chunk of frames."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False).select("doc_id", "codes_list")
    return _kept_stats(b, FR.dedupe_frame_rows(FR.frames_long(b, "doc_id", "codes_list"), "doc_id"))


def _kept_stats(b: DataFrame, kept: DataFrame) -> DataFrame:
    sizes = b.select("doc_id", _long(F.size("codes_list")).alias("n_before"))
    agg = kept.groupBy("doc_id").agg(
        _long(F.count("*")).alias("n_after"),
        F.sum(F.col("code").cast("long") * (F.col("pos") + 1)).alias("dedup_ck"))
    return sizes.join(agg, "doc_id", "left").select(
        "doc_id", "n_before", F.coalesce("n_after", F.lit(0).cast("long")).alias("n_after"),
        F.coalesce("dedup_ck", F.lit(0).cast("long")).alias("dedup_ck"))


# --------------------------------------------------------------------------
# Prompts, masks, labels, truncation
# --------------------------------------------------------------------------
@register("prompt_plain", f"""
WITH {DOC_CTE},
p AS (SELECT doc_id, {PLAIN_SQL} AS full_ids FROM dd),
t AS (SELECT doc_id, len(full_ids) AS n_full, full_ids[1:2048] AS ids FROM p)
SELECT doc_id, n_full::BIGINT AS n_full, len(ids)::BIGINT AS n_ids, {ck('ids')} AS ids_ck,
       len(ids)::BIGINT AS mask_sum, {ck('ids')} AS labels_ck FROM t
""")
def prompt_plain(spark, sf_dir):
    """Plain training rows: Q4 -> Q7 (2048) -> Q8 mask -> Q9 labels."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    full = PR.plain_rows(b, ["doc_id"], max_len=None).select("doc_id", F.size("input_ids").alias("n_full"), "input_ids")
    rows = full.select("doc_id", "n_full", A.truncate("input_ids", V.MAX_LEN_PLAIN).alias("input_ids"))
    rows = rows.select("doc_id", "n_full", "input_ids", A.attention_mask("input_ids").alias("attention_mask"),
                       F.col("input_ids").alias("labels"))
    return rows.select("doc_id", _long("n_full").alias("n_full"), _long(F.size("input_ids")).alias("n_ids"),
                       A.checksum("input_ids").alias("ids_ck"),
                       _long(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("mask_sum"),
                       A.checksum("labels").alias("labels_ck"))


@register("prompt_speaker", f"""
WITH {DOC_CTE},
p AS (SELECT doc_id, {SPEAKER_SQL.format(ph=128263)} AS ids FROM dd)
SELECT doc_id, len(ids)::BIGINT AS n_ids, {ck('ids')} AS ids_ck,
       len(list_filter(ids, lambda x: x = 128263))::BIGINT AS n_placeholders,
       (list_position(ids, 128263) - 1)::BIGINT AS placeholder_pos,
       {ck("list_transform(ids, lambda x: CASE WHEN x IN (128263, -100) THEN -100 ELSE x END)")} AS labels_ck FROM p
""")
def prompt_speaker(spark, sf_dir):
    """Speaker rows: Q3 -> Q5 -> P11 check -> Q10 masked labels."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    rows = PR.speaker_rows(b, ["doc_id"]).withColumnRenamed("input_ids", "ids")
    return rows.select("doc_id", _long(F.size("ids")).alias("n_ids"), A.checksum("ids").alias("ids_ck"),
                       _long(A.count_value("ids", V.PLACEHOLDER)).alias("n_placeholders"),
                       (F.array_position("ids", V.PLACEHOLDER) - 1).cast("long").alias("placeholder_pos"),
                       A.checksum(A.mask_labels("ids")).alias("labels_ck"))


@register("truncate_stats", f"""
WITH {DOC_CTE},
p AS (SELECT lang, len({PLAIN_SQL}) AS n FROM dd)
SELECT lang, count(*)::BIGINT AS n_rows, sum(CASE WHEN n > 2048 THEN 1 ELSE 0 END)::BIGINT AS n_truncated,
       sum(greatest(n - 2048, 0))::BIGINT AS tokens_removed, max(n)::BIGINT AS max_len FROM p GROUP BY lang
""")
def truncate_stats(spark, sf_dir):
    """A4: rows truncated and tokens removed at the 2048 limit, per language."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    n = b.select("lang", F.size(A.assemble_plain("text_ids", "codes_list")).alias("n"))
    return PR.truncation_stats(n, "n", V.MAX_LEN_PLAIN, ["lang"])


@register("collate_rows", f"""
WITH {DOC_CTE},
p AS (SELECT doc_id, ({PLAIN_SQL})[1:2048] AS ids FROM dd),
c AS (SELECT doc_id, ids[1:4096] AS ids FROM p)
SELECT doc_id, len(ids)::BIGINT AS n_ids, {ck('ids')} AS ids_ck, len(ids)::BIGINT AS mask_len, {ck('ids')} AS labels_ck FROM c
""")
def collate_rows(spark, sf_dir):
    """Q12: the collator's projection (truncate ids and mask to 4096, labels = ids)
    over the plain training rows; ragged rows stay ragged (D12)."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    c = PR.collate(PR.plain_rows(b, ["doc_id"], max_len=V.MAX_LEN_PLAIN), V.MAX_LEN_COLLATE)
    return c.select("doc_id", _long(F.size("input_ids")).alias("n_ids"), A.checksum("input_ids").alias("ids_ck"),
                    _long(F.size("attention_mask")).alias("mask_len"), A.checksum("labels").alias("labels_ck"))


@register("collate_long_rows", f"""
WITH {DOC_CTE},
p AS (SELECT doc_id, {PLAIN_SQL} AS full_ids FROM dd),
t AS (SELECT doc_id, len(full_ids) AS n_full, full_ids[1:4096] AS ids FROM p)
SELECT doc_id, n_full::BIGINT AS n_full, len(ids)::BIGINT AS n_ids, {ck('ids')} AS ids_ck,
       len(ids)::BIGINT AS n_mask, {ck('ids')} AS labels_ck FROM t
""")
def collate_long_rows(spark, sf_dir):
    """Q12 on rows that were not cut before: the collator's own limit bites."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    rows = PR.plain_rows(b, ["doc_id"], max_len=None).withColumn("n_full", F.size("input_ids"))
    c = PR.collate(rows, V.MAX_LEN_COLLATE)
    return c.select("doc_id", _long("n_full").alias("n_full"), _long(F.size("input_ids")).alias("n_ids"),
                    A.checksum("input_ids").alias("ids_ck"), _long(F.size("attention_mask")).alias("n_mask"),
                    A.checksum("labels").alias("labels_ck"))


@register("generation_prompt", f"""
WITH {DOC_CTE},
g AS (SELECT doc_id, [128259] || text_ids || [128009, 128260, 128261, 128257] AS plain,
             [128259] || text_ids || [128009, 128260, 128264] AS head, [128265, 128261, 128257] AS tail FROM dc)
SELECT doc_id, len(plain)::BIGINT AS plain_len, {ck('plain')} AS plain_ck, len(head)::BIGINT AS head_len,
       {ck('head')} AS head_ck, {ck('tail')} AS tail_ck FROM g
""")
def generation_prompt(spark, sf_dir):
    """Q6: generation prompts, plain and split around the speaker embedding."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    g = b.select("doc_id", A.generation_prompt("text_ids").alias("plain"),
                 A.generation_prompt("text_ids", speaker=True).alias("sp"))
    return g.select("doc_id", _long(F.size("plain")).alias("plain_len"), A.checksum("plain").alias("plain_ck"),
                    _long(F.size("sp.head")).alias("head_len"), A.checksum("sp.head").alias("head_ck"),
                    A.checksum("sp.tail").alias("tail_ck"))


def generated_tokens(spark, sf_dir) -> DataFrame:
    """Stand-in model output per document: the prompt plus the full frames of its
    codes, with the marker cases varied by language (en: marker + end,
    de: no start marker, fr: no end marker, es: empty span)."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    frames = F.slice("codes_list", 1, F.greatest(F.floor(F.size("codes_list") / 7).cast("int") * 7, F.lit(0)))
    prompt = A.generation_prompt("text_ids")
    eoa = A.lit_array([V.END_OF_AUDIO])
    lang = F.col("lang")
    gen = (F.when(lang == "de", F.concat(frames, eoa))
           .when(lang == "fr", F.concat(prompt, frames))
           .when(lang == "es", F.concat(prompt, eoa))
           .otherwise(F.concat(prompt, frames, eoa)))
    return b.select("doc_id", gen.alias("output_tokens"))


GEN_SQL = """
g AS (SELECT doc_id, CASE
   WHEN lang = 'de' THEN fr || [128258]
   WHEN lang = 'fr' THEN pr || fr
   WHEN lang = 'es' THEN pr || [128258]
   ELSE pr || fr || [128258] END AS v
 FROM (SELECT doc_id, lang, [128259] || text_ids || [128009, 128260, 128261, 128257] AS pr,
              codes[1:(len(codes) // 7) * 7] AS fr FROM dc))
"""


@register("audio_span", f"""
WITH {DOC_CTE}, {GEN_SQL},
r AS (SELECT doc_id, CASE WHEN coalesce(list_position(v, 128257), 0) = 0 THEN v
                          ELSE v[list_position(v, 128257) + 1:] END AS rest FROM g),
s AS (SELECT doc_id, CASE WHEN rest[-1] = 128258 THEN rest[1:len(rest) - 1] ELSE rest END AS span FROM r)
SELECT doc_id, len(span)::BIGINT AS span_len, (len(span) % 7 = 0) AS shape_ok, (len(span) = 0) AS is_empty,
  (list_bool_and(list_transform(span, lambda x, i: x - 128266 - 4096 * ((i - 1) % 7) >= 0
                                              AND x - 128266 - 4096 * ((i - 1) % 7) < 4096)) IS NOT false) AS range_ok,
  {ck('span')} AS span_ck FROM s
""")
def audio_span(spark, sf_dir):
    """Q11 -> P9 -> Q2 -> P10 over generated token rows."""
    g = generated_tokens(spark, sf_dir)
    s = g.select("doc_id", A.audio_span("output_tokens").alias("span"))
    s = s.select("doc_id", "span", A.unflatten_frames("span").alias("u"))
    return s.select("doc_id", _long(F.size("span")).alias("span_len"), A.frame_shape_ok("span").alias("shape_ok"),
                    (F.size("span") == 0).alias("is_empty"), A.codes_in_range("u.c0", "u.c1", "u.c2").alias("range_ok"),
                    A.checksum("span").alias("span_ck"))


BROKEN_TAILS = {1: [V.AUDIO_OFFSET], 2: [V.AUDIO_OFFSET + V.CODEBOOK_SIZE * max(1, slot) for slot in range(7)]}


@register("decode_generated", f"""
WITH {DOC_CTE}, {GEN_SQL},
x AS (SELECT doc_id, v || CASE doc_id % 5 WHEN 1 THEN {BROKEN_TAILS[1]} WHEN 2 THEN {BROKEN_TAILS[2]} ELSE [] END AS v FROM g),
r AS (SELECT doc_id, CASE WHEN coalesce(list_position(v, 128257), 0) = 0 THEN v
                          ELSE v[list_position(v, 128257) + 1:] END AS rest FROM x),
s AS (SELECT doc_id, CASE WHEN rest[-1] = 128258 THEN rest[1:len(rest) - 1] ELSE rest END AS span FROM r),
d AS (SELECT doc_id, span, list_transform(span, lambda x, i: x - 128266 - 4096 * ((i - 1) % 7)) AS raw FROM s),
c AS (SELECT doc_id, span, raw, list_filter(raw, lambda x, i: (i - 1) % 7 = 0) AS c0, list_filter(raw, lambda x, i: (i - 1) % 7 IN (1, 4)) AS c1,
             list_filter(raw, lambda x, i: (i - 1) % 7 IN (2, 3, 5, 6)) AS c2 FROM d)
SELECT doc_id::BIGINT AS doc_id, (len(span) % 7 = 0) AS shape_ok, (len(span) = 0) AS is_empty,
  (list_bool_and(list_transform(raw, lambda x: x >= 0 AND x < 4096)) IS NOT false) AS codes_ok,
  len(c0)::BIGINT AS n_c0, {ck('c0')} AS c0_ck, {ck('c1')} AS c1_ck, {ck('c2')} AS c2_ck FROM c
""")
def decode_generated(spark, sf_dir):
    """Q11 -> P9 -> Q2 -> P10 as one path, on outputs of which some end in a part of a frame and
    some in a frame with a code outside its codebook."""
    tail = F.when(F.col("doc_id") % 5 == 1, A.lit_array(BROKEN_TAILS[1])).when(F.col("doc_id") % 5 == 2, A.lit_array(BROKEN_TAILS[2]))
    g = generated_tokens(spark, sf_dir).withColumn("output_tokens", F.concat("output_tokens", F.coalesce(tail, F.array().cast("array<int>"))))
    d = PATHS.decode_generated(g)
    return d.select(_long("doc_id").alias("doc_id"), "shape_ok", "is_empty", "codes_ok", _long(F.size("c0")).alias("n_c0"),
                    *(A.checksum(c).alias(f"{c}_ck") for c in ("c0", "c1", "c2")))


# --------------------------------------------------------------------------
# Ordering, sampling, sharding
# --------------------------------------------------------------------------
@register("shuffle_seeded", """
SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1)::BIGINT AS idx FROM documents
""")
def shuffle_seeded(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.seeded_shuffle(d, "doc_id").select("doc_id", _long("idx").alias("idx"))


@register("head_fraction", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1)::BIGINT AS idx
FROM r WHERE rn < n // 5
""")
def head_fraction(spark, sf_dir):
    """O2 then O1: the first fifth in table order, then the seeded shuffle."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    head = sampling.head_fraction(d, "doc_id", 5, idx_col="rn", n_rows=n).select("doc_id")
    return sampling.seeded_shuffle(head, "doc_id", n_rows=n // 5).select("doc_id", _long("idx").alias("idx"))


@register("order_any", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, source NULLS FIRST, doc_id) - 1 AS idx,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id::BIGINT AS doc_id, idx::BIGINT AS idx, (idx // 1000)::BIGINT AS batch, idx < n // 5 AS in_head,
       CASE WHEN idx < (n % 7) * (n // 7 + 1) THEN idx // (n // 7 + 1)
            ELSE n % 7 + (idx - (n % 7) * (n // 7 + 1)) // (n // 7) END::BIGINT AS shard
FROM d
""")
def order_any(spark, sf_dir):
    """O1-O4, K4 in an order whose first column is one value for all rows, then strings."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(1).alias("run"))
    n = d.count()
    i = sampling.row_batches(sampling.with_global_index(d, ["run", "lang", "source", "doc_id"], n_rows=n), "idx", V.BATCH_ROWS)
    return i.select(_long("doc_id").alias("doc_id"), _long("idx").alias("idx"), _long("batch").alias("batch"),
                    (F.col("idx") < n // 5).alias("in_head"), _long(sampling.shard_of("idx", n, 7)).alias("shard"))


@register("row_batches", """
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events)
SELECT (idx // 1000)::BIGINT AS batch, count(*)::BIGINT AS n_rows, min(event_id)::BIGINT AS first_id,
       max(event_id)::BIGINT AS last_id, round(sum(value), 4) AS value_sum FROM r GROUP BY 1
""")
def row_batches(spark, sf_dir):
    """O4 + A5: contiguous batches of 1000 rows in table order."""
    e = FX.table(spark, sf_dir, "events").select("event_id", "value")
    b = sampling.row_batches(sampling.with_global_index(e, ["event_id"]), "idx", V.BATCH_ROWS)
    return b.groupBy("batch").agg(_long(F.count("*")).alias("n_rows"), _long(F.min("event_id")).alias("first_id"),
                                  _long(F.max("event_id")).alias("last_id"), _round(F.sum("value"), 4).alias("value_sum"))


@register("mean_length_head", f"""
WITH {DOC_CTE},
p AS (SELECT doc_id, len({SPEAKER_SQL.format(ph=128263)}) AS n FROM dd),
h AS (SELECT n FROM p ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 10000)
SELECT count(*)::BIGINT AS sample_rows, round(avg(n), 6) AS avg_length FROM h
""")
def mean_length_head(spark, sf_dir):
    """A3: mean speaker-row length over the first 10,000 rows of the shuffled table."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    b = sampling.head_rows(b, "doc_id", sampling.seeded_key(["doc_id"]), V.HEAD_SAMPLE)
    rows = b.select("doc_id", A.assemble_speaker("text_ids", A.dedupe_frames("codes_list")).alias("input_ids"))
    rows = rows.withColumn("_o1", sampling.seeded_key(["doc_id"]))
    r = sampling.mean_length_head(rows, "input_ids", ["_o1", "doc_id"], V.HEAD_SAMPLE)
    return r.select(_long("sample_rows").alias("sample_rows"), _round("avg_length", 6).alias("avg_length"))


SHARD_CONTIG_SQL = """
WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS idx,
                  count(*) OVER () AS n FROM documents),
o AS (SELECT doc_id, idx, CASE WHEN idx < (n % {outer}) * (n // {outer} + 1) THEN idx // (n // {outer} + 1)
        ELSE (n % {outer}) + (idx - (n % {outer}) * (n // {outer} + 1)) // (n // {outer}) END AS outer_shard FROM s),
p AS (SELECT doc_id, idx, outer_shard, row_number() OVER (PARTITION BY outer_shard ORDER BY idx) - 1 AS pos,
             count(*) OVER (PARTITION BY outer_shard) AS m FROM o),
i AS (SELECT doc_id, idx, outer_shard, pos, CASE WHEN pos < (m % {inner}) * (m // {inner} + 1) THEN pos // (m // {inner} + 1)
        ELSE (m % {inner}) + (pos - (m % {inner}) * (m // {inner} + 1)) // (m // {inner}) END AS inner_shard FROM p)
"""


@register("shard_assign", SHARD_CONTIG_SQL.format(outer=10, inner=50) + """
SELECT doc_id, outer_shard::BIGINT AS outer_shard, inner_shard::BIGINT AS inner_shard,
       (row_number() OVER (PARTITION BY outer_shard, inner_shard ORDER BY idx) - 1)::BIGINT AS inner_idx FROM i
""")
def shard_assign(spark, sf_dir):
    """K4: two-level contiguous shards (10 x 50) of the shuffled table."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    s = sampling.two_level_shards(sampling.seeded_shuffle(d, "doc_id", n_rows=n), "idx", n, 10, 50, "contiguous")
    return s.select("doc_id", _long("outer_shard").alias("outer_shard"), _long("inner_shard").alias("inner_shard"),
                    _long("inner_idx").alias("inner_idx"))


@register("shard_assign_strided", """
WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS idx FROM documents),
o AS (SELECT doc_id, idx, idx % 10 AS outer_shard,
             row_number() OVER (PARTITION BY idx % 10 ORDER BY idx) - 1 AS pos FROM s)
SELECT doc_id, outer_shard::BIGINT AS outer_shard, (pos % 50)::BIGINT AS inner_shard,
       (row_number() OVER (PARTITION BY outer_shard, pos % 50 ORDER BY idx) - 1)::BIGINT AS inner_idx FROM o
""")
def shard_assign_strided(spark, sf_dir):
    """K4, strided mode: ``idx % shards`` at both levels."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    s = sampling.two_level_shards(sampling.seeded_shuffle(d, "doc_id", n_rows=n), "idx", n, 10, 50, "strided")
    return s.select("doc_id", _long("outer_shard").alias("outer_shard"), _long("inner_shard").alias("inner_shard"),
                    _long("inner_idx").alias("inner_idx"))


# --------------------------------------------------------------------------
# Packing (K1-K5) and alignment
# --------------------------------------------------------------------------
PACK_OUTER, PACK_INNER = 2, 4   # shards of the fixture (the library default is 10 x 50)
PACK_CHUNK = 128                 # rows of a chunk, so that small shards spread over tasks too
EMB_DIM = 64                     # width of the fixture's vectors


def pack_shards(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` shuffled and cut in 2 x 4 contiguous shards: further columns ``shard`` and ``ord``."""
    s = sampling.two_level_shards(sampling.seeded_shuffle(rows, "doc_id", n_rows=n), "idx", n, PACK_OUTER, PACK_INNER)
    return s.withColumn("shard", (F.col("outer_shard") * PACK_INNER + F.col("inner_shard")).cast("long")).withColumn("ord", F.col("inner_idx"))


def packing_input(spark, sf_dir) -> DataFrame:
    """Shuffled speaker rows in their shards: ``doc_id, shard, ord, n_tok, text,
    lang, speaker_embedding``; ``pack`` builds the ids where they are packed."""
    n = FX.table(spark, sf_dir, "documents").count()
    s = pack_shards(FX.texts(spark, sf_dir), n)
    return speaker_ids(s).withColumn("n_tok", F.size("input_ids")).select("doc_id", "shard", "ord", "n_tok", "text", "lang", "speaker_embedding")


def packing_lengths(spark, sf_dir) -> DataFrame:
    """``packing_input`` without its payload: ids are counted where the texts are read, and only
    ``doc_id, n_tok`` are joined, shuffled and cut in shards."""
    n = FX.table(spark, sf_dir, "documents").count()
    ids = speaker_ids(FX.texts(spark, sf_dir, with_embedding=False))
    narrow = written(ids.select("doc_id", F.size("input_ids").alias("n_tok")), "lengths")
    return pack_shards(FX.with_vectors(spark, sf_dir, narrow).drop("speaker_embedding"), n).select("doc_id", "shard", "ord", "n_tok")


def speaker_ids(rows: DataFrame) -> DataFrame:
    """Rows of texts with their ``input_ids`` (``de`` rows carry the -100 placeholder)."""
    return FX.with_speaker_ids(rows, alt_placeholder_lang="de")


def pack(rows: DataFrame) -> DataFrame:
    """The rows of ``packing_input`` packed."""
    return packing.pack_rows(written(rows, "speaker-rows"), "shard", "ord", "input_ids", "speaker_embedding",
                             chunk_rows=PACK_CHUNK, len_col="n_tok", build=speaker_ids)


def packed(spark, sf_dir) -> DataFrame:
    return pack(packing_input(spark, sf_dir))


def pack_input_sql(ph: str, emb: str = "e.embedding", where: str = "true") -> str:
    return DOC_CTE + f""",
ne AS (SELECT count(*) AS nv FROM embeddings),
sp AS (SELECT dd.doc_id, {SPEAKER_SQL.format(ph=ph)} AS ids, {emb} AS emb
       FROM dd, ne JOIN embeddings e ON e.vec_id = dd.doc_id % ne.nv WHERE {where}),
s AS (SELECT doc_id, ids, emb, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS idx,
             count(*) OVER () AS n FROM sp),
o AS (SELECT *, CASE WHEN idx < (n % {PACK_OUTER}) * (n // {PACK_OUTER} + 1) THEN idx // (n // {PACK_OUTER} + 1)
        ELSE (n % {PACK_OUTER}) + (idx - (n % {PACK_OUTER}) * (n // {PACK_OUTER} + 1)) // (n // {PACK_OUTER}) END AS outer_shard FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY outer_shard ORDER BY idx) - 1 AS pos,
             count(*) OVER (PARTITION BY outer_shard) AS m FROM o),
i AS (SELECT *, CASE WHEN pos < (m % {PACK_INNER}) * (m // {PACK_INNER} + 1) THEN pos // (m // {PACK_INNER} + 1)
        ELSE (m % {PACK_INNER}) + (pos - (m % {PACK_INNER}) * (m // {PACK_INNER} + 1)) // (m // {PACK_INNER}) END AS inner_shard FROM p),
r AS (SELECT doc_id, ids, emb, len(ids) AS n_tok, outer_shard * {PACK_INNER} + inner_shard AS shard,
             row_number() OVER (PARTITION BY outer_shard, inner_shard ORDER BY idx) - 1 AS ord FROM i),
bins AS (
  SELECT shard, ord, 0 AS bin, n_tok AS fill FROM r WHERE ord = 0
  UNION ALL
  SELECT r.shard, r.ord,
         CASE WHEN b.fill + r.n_tok <= 8192 THEN b.bin ELSE b.bin + 1 END,
         CASE WHEN b.fill + r.n_tok <= 8192 THEN b.fill + r.n_tok ELSE r.n_tok END
  FROM bins b JOIN r ON r.shard = b.shard AND r.ord = b.ord + 1),
rb AS (SELECT r.*, bins.bin FROM r JOIN bins USING (shard, ord)),
pk AS (SELECT shard, bin, count(*) AS n_rows, flatten(list(ids ORDER BY ord)) AS ids,
              flatten(list(emb ORDER BY ord)) AS emb FROM rb GROUP BY shard, bin)
"""


PACK_INPUT_SQL = pack_input_sql("CASE WHEN lang = 'de' THEN -100 ELSE 128263 END")


@register("pack_bins", "WITH RECURSIVE " + PACK_INPUT_SQL + """
SELECT doc_id, shard::BIGINT AS shard, ord::BIGINT AS ord, bin::BIGINT AS bin FROM rb
""")
def pack_bins(spark, sf_dir):
    """K1 on lengths only: bin of every row (next-fit, 8192 tokens)."""
    bins = packing.assign_bins(packing_lengths(spark, sf_dir), "shard", "ord", "n_tok", V.PACK_LIMIT, chunk_rows=PACK_CHUNK, keep=["doc_id"])
    return bins.select("doc_id", _long("shard").alias("shard"), _long("ord").alias("ord"),
                                                   _long("bin").alias("bin"))


@register("pack_bins_one_shard", f"""
WITH RECURSIVE {DOC_CTE},
r AS (SELECT doc_id, len({SPEAKER_SQL.format(ph=128263)}) AS n_tok, row_number() OVER (ORDER BY doc_id) AS rn FROM dd),
bins AS (
  SELECT rn, doc_id, 0 AS bin, n_tok AS fill FROM r WHERE rn = 1
  UNION ALL
  SELECT r.rn, r.doc_id, CASE WHEN b.fill + r.n_tok <= 8192 THEN b.bin ELSE b.bin + 1 END,
         CASE WHEN b.fill + r.n_tok <= 8192 THEN b.fill + r.n_tok ELSE r.n_tok END
  FROM bins b JOIN r ON r.rn = b.rn + 1)
SELECT doc_id, bin::BIGINT AS bin FROM bins
""")
def pack_bins_one_shard(spark, sf_dir):
    """The whole table as one shard, in table order, spread over its chunks."""
    rows = FX.bulk_rows(spark, sf_dir, with_embedding=False).select(
        "doc_id", F.lit(0).alias("shard"), F.size(A.assemble_speaker("text_ids", A.dedupe_frames("codes_list"))).alias("n_tok"))
    bins = packing.assign_bins(rows, "shard", "doc_id", "n_tok", V.PACK_LIMIT, chunk_rows=16)
    return bins.select("doc_id", _long("bin").alias("bin"))


@register("packed_rows", "WITH RECURSIVE " + PACK_INPUT_SQL + f"""
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, n_rows::BIGINT AS n_rows, len(ids)::BIGINT AS n_tokens,
       {ck('ids')} AS ids_ck, len(emb)::BIGINT AS n_emb, round(list_sum(list_transform(emb, lambda x: x::DOUBLE)), 3) AS emb_sum
FROM pk
""")
def packed_rows(spark, sf_dir):
    """K1 + K2 + K3: packed rows with concatenated ids and embeddings."""
    p = packed(spark, sf_dir)
    return p.select(_long("shard").alias("shard"), _long("bin").alias("bin"), _long("n_rows").alias("n_rows"),
                    _long("n_tokens").alias("n_tokens"), A.checksum("input_ids").alias("ids_ck"),
                    _long(F.size("speaker_embeddings")).alias("n_emb"),
                    _round(F.aggregate("speaker_embeddings", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 3)
                    .alias("emb_sum"))


SLOTS_SQL = """
pos AS (SELECT shard, bin, emb, generate_subscripts(ids, 1) - 1 AS p, unnest(ids) AS tok FROM pk),
sl AS (SELECT shard, bin, emb, p, row_number() OVER (PARTITION BY shard, bin ORDER BY p) - 1 AS k
       FROM pos WHERE tok IN (128263, -100))
"""


@register("placeholder_align", "WITH RECURSIVE " + PACK_INPUT_SQL + "," + SLOTS_SQL + f"""
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, k::BIGINT AS k, p::BIGINT AS pos,
       round(list_sum(list_transform(emb[k * {EMB_DIM} + 1:(k + 1) * {EMB_DIM}], lambda x: x::DOUBLE)), 4) AS vec_sum,
       len(emb[k * {EMB_DIM} + 1:(k + 1) * {EMB_DIM}])::BIGINT AS vec_len
FROM sl
""")
def placeholder_align(spark, sf_dir):
    """P13 -> P12 -> J4 (+ Q14 slicing): the k-th placeholder of each packed row
    with the k-th embedding vector."""
    a = align.align_placeholders(packed(spark, sf_dir), ["shard", "bin"], dim=EMB_DIM)
    return a.select(_long("shard").alias("shard"), _long("bin").alias("bin"), _long("k").alias("k"),
                    _long("pos").alias("pos"),
                    _round(F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double")), 4).alias("vec_sum"),
                    _long(F.size("vector")).alias("vec_len"))


@register("placeholder_ordinals", "WITH RECURSIVE " + PACK_INPUT_SQL + "," + SLOTS_SQL + """
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, k::BIGINT AS k, p::BIGINT AS pos FROM sl
""")
def placeholder_ordinals(spark, sf_dir):
    """Running placeholder ordinal ``cumsum(mask) - 1`` in long form."""
    o = align.placeholder_ordinals_long(packed(spark, sf_dir), ["shard", "bin"])
    return o.select(_long("shard").alias("shard"), _long("bin").alias("bin"), _long("k").alias("k"), _long("pos").alias("pos"))


@register("mask_labels", "WITH RECURSIVE " + PACK_INPUT_SQL + f"""
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin,
       {ck("list_transform(ids, lambda x: CASE WHEN x IN (128263, -100) THEN -100 ELSE x END)")} AS labels_ck,
       {ck("list_transform(ids, lambda x: CASE WHEN x = -100 THEN 128263 ELSE x END)")} AS ids_ck,
       len(list_filter(ids, lambda x: x IN (128263, -100)))::BIGINT AS n_masked,
       (len(list_filter(ids, lambda x: x IN (128263, -100))) * {EMB_DIM} = len(emb)) AS counts_match
FROM pk
""")
def mask_labels(spark, sf_dir):
    """P13 normalise, Q10 masked labels and the P12 count check per packed row."""
    p = packed(spark, sf_dir).select("shard", "bin", A.normalise_placeholder("input_ids").alias("ids"),
                                     "speaker_embeddings")
    return p.select(_long("shard").alias("shard"), _long("bin").alias("bin"),
                    A.checksum(A.mask_labels("ids")).alias("labels_ck"), A.checksum("ids").alias("ids_ck"),
                    _long(A.count_value("ids", V.PLACEHOLDER)).alias("n_masked"),
                    align.placeholders_match("ids", "speaker_embeddings", EMB_DIM).alias("counts_match"))


@register("placeholder_rejects", "WITH RECURSIVE " + pack_input_sql(
    "CASE WHEN lang = 'de' THEN -100 ELSE 128263 END",
    "CASE WHEN dd.doc_id % 7 = 0 THEN e.embedding[1:32] ELSE e.embedding END") + f"""
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, len(list_filter(ids, lambda x: x IN (128263, -100)))::BIGINT AS n_placeholders,
       len(emb)::BIGINT AS n_floats
FROM pk WHERE len(list_filter(ids, lambda x: x IN (128263, -100))) * {EMB_DIM} <> len(emb)
""")
def placeholder_rejects(spark, sf_dir):
    """P12 rejects: packed rows with vectors of a wrong width, reported with both counts."""
    rows = packing_input(spark, sf_dir)
    half = F.when(F.col("doc_id") % 7 == 0, F.slice("speaker_embedding", 1, 32)).otherwise(F.col("speaker_embedding"))
    p = pack(rows.withColumn("speaker_embedding", half))
    r = align.misaligned_rows(p, ["shard", "bin"], dim=EMB_DIM)
    return r.select(*[_long(c).alias(c) for c in ("shard", "bin", "n_placeholders", "n_floats")])


def bulk_input(spark, sf_dir) -> DataFrame:
    """Bulk rows of which some lack a vector, and some codes (see ``bulk_built``)."""
    return some_vectors(FX.texts(spark, sf_dir)).select("doc_id", "text", "speaker_embedding")


def some_vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("speaker_embedding", F.when(F.col("doc_id") % 13 != 5, F.col("speaker_embedding")))


def bulk_built(rows: DataFrame) -> DataFrame:
    """Speaker rows of bulk rows, in their order and with their columns."""
    b = FX.with_stand_ins(rows).drop("text_ids")
    b = b.withColumn("codes_list", F.when(F.col("doc_id") % 11 != 3, F.col("codes_list")))
    return PATHS.bulk_speaker_rows(b, "doc_id", keep=[c for c in rows.columns if c not in ("doc_id", "speaker_embedding")])


def bulk_packed(spark, sf_dir) -> DataFrame:
    """The bulk path as a user calls it, on rows of which some lack codes, some a
    vector, and some are longer than a sequence."""
    return PATHS.pack_corpus(bulk_input(spark, sf_dir), "doc_id", PACK_OUTER, PACK_INNER, dim=EMB_DIM, chunk_rows=PACK_CHUNK, build=bulk_built)


BULK_SQL = pack_input_sql("128263", where="dd.doc_id % 11 <> 3 AND dd.doc_id % 13 <> 5")


@register("pack_corpus_bulk", "WITH RECURSIVE " + BULK_SQL + f"""
SELECT (shard // {PACK_INNER})::BIGINT AS outer_shard, shard::BIGINT AS shard, bin::BIGINT AS bin, n_rows::BIGINT AS n_rows,
       {ck('ids')} AS ids_ck, len(emb)::BIGINT AS n_emb FROM pk
""")
def pack_corpus_bulk(spark, sf_dir):
    """The bulk path: P7 -> P11 -> O1 -> K4 -> K1 -> K2/K3."""
    p = bulk_packed(spark, sf_dir)
    return p.select(_long("outer_shard").alias("outer_shard"), _long("shard").alias("shard"), _long("bin").alias("bin"),
                    _long("n_rows").alias("n_rows"), A.checksum("input_ids").alias("ids_ck"),
                    _long(F.size("speaker_embeddings")).alias("n_emb"))


@register("pack_corpus_rejects", """
SELECT reason, count(*)::BIGINT AS n_rows, min(doc_id)::BIGINT AS first_id FROM (
  SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'no ids' ELSE 'no speaker embedding' END AS reason
  FROM documents WHERE doc_id % 11 = 3 OR doc_id % 13 = 5) GROUP BY reason
""")
def pack_corpus_rejects(spark, sf_dir):
    """The bulk rows that packing leaves out, counted by reason."""
    texts = FX.texts(spark, sf_dir, with_embedding=False).select("doc_id", "text", F.lit(None).cast("array<float>").alias("speaker_embedding"))
    ids = bulk_built(texts).select("doc_id", "input_ids")
    r = PATHS.unpackable_rows(ids, "doc_id", dim=EMB_DIM, vectors=lambda rows: some_vectors(FX.with_vectors(spark, sf_dir, rows)))
    return r.groupBy("reason").agg(_long(F.count("*")).alias("n_rows"), _long(F.min("doc_id")).alias("first_id"))


@register("model_inputs_bulk", "WITH RECURSIVE " + BULK_SQL + f"""
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, {ck('ids[1:8192]')} AS ids_ck,
       {ck("list_transform(ids[1:8192], lambda x: CASE WHEN x = 128263 THEN -100 ELSE x END)")} AS labels_ck,
       least(len(ids), 8192)::BIGINT AS n_mask, least(len(ids), 8192)::BIGINT AS n_segment_ids,
       (len(list_filter(ids, lambda x: x = 128263)) * {EMB_DIM} = len(emb)) AS placeholders_ok FROM pk
""")
def model_inputs_bulk(spark, sf_dir):
    """The bulk path's model inputs, cut at 8192: P12 -> P13 -> Q10 -> Q7."""
    rows, _ = PATHS.model_inputs(bulk_packed(spark, sf_dir), dim=EMB_DIM)
    return rows.select(_long("shard").alias("shard"), _long("bin").alias("bin"), A.checksum("input_ids").alias("ids_ck"),
                       A.checksum("labels").alias("labels_ck"), _long(F.size("attention_mask")).alias("n_mask"),
                       _long(F.size("segment_ids")).alias("n_segment_ids"), "placeholders_ok")


@register("model_slots_bulk", "WITH RECURSIVE " + BULK_SQL + "," + SLOTS_SQL + f"""
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, k::BIGINT AS k, p::BIGINT AS pos,
       round(list_sum(list_transform(emb[k * {EMB_DIM} + 1:(k + 1) * {EMB_DIM}], lambda x: x::DOUBLE)), 4) AS vec_sum
FROM sl WHERE p < 8192
""")
def model_slots_bulk(spark, sf_dir):
    """The bulk path's placeholder slots inside the cut rows."""
    _, slots = PATHS.model_inputs(bulk_packed(spark, sf_dir), dim=EMB_DIM)
    total = F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double"))
    return slots.select(*[_long(c).alias(c) for c in ("shard", "bin", "k", "pos")], _round(total, 4).alias("vec_sum"))


PROJ_OUT = 8


def projection_weights(d: int = EMB_DIM, out: int = PROJ_OUT) -> np.ndarray:
    """Fixed integer test weights ``w[i, j] = ((7 i + 3 j) mod 5) - 2``."""
    i = np.arange(d)[:, None]
    j = np.arange(out)[None, :]
    return (((7 * i + 3 * j) % 5) - 2).astype(np.float64)


WEIGHTS_SQL = f"""
w AS (SELECT i, j, ((7 * i + 3 * j) % 5) - 2 AS wv FROM range({EMB_DIM}) t1(i), range({PROJ_OUT}) t2(j))
"""


@register("embedding_projection", f"""
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
{WEIGHTS_SQL}
SELECT vec_id::BIGINT AS vec_id, j::BIGINT AS j, round(sum(x::DOUBLE * wv), 4) AS value FROM e JOIN w USING (i) GROUP BY vec_id, j
""")
def embedding_projection(spark, sf_dir):
    """M4: linear projection (no bias) of every vector, output long form."""
    e = FX.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = project_embeddings(e, "embedding", projection_weights())
    return p.select(_long("vec_id").alias("vec_id"), F.posexplode("projection").alias("j", "value")).select(
        "vec_id", _long("j").alias("j"), _round("value", 4).alias("value"))


@register("fill_placeholders", "WITH RECURSIVE " + PACK_INPUT_SQL + "," + SLOTS_SQL + "," + WEIGHTS_SQL + f""",
v AS (SELECT shard, bin, p, unnest(emb[k * {EMB_DIM} + 1:(k + 1) * {EMB_DIM}]) AS x,
             generate_subscripts(emb[k * {EMB_DIM} + 1:(k + 1) * {EMB_DIM}], 1) - 1 AS i FROM sl),
pr AS (SELECT shard, bin, p, j, sum(x::DOUBLE * wv) AS val FROM v JOIN w USING (i) GROUP BY shard, bin, p, j)
SELECT shard::BIGINT AS shard, bin::BIGINT AS bin, p::BIGINT AS pos, round(sum(val * (j + 1)), 3) AS proj_ck
FROM pr GROUP BY shard, bin, p
""")
def fill_placeholders(spark, sf_dir):
    """M5: projected speaker vectors placed at the placeholder positions."""
    filled = align.fill_placeholders(packed(spark, sf_dir), ["shard", "bin"], projection_weights(), dim=EMB_DIM)
    ckc = F.aggregate(F.transform("projection", lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda a, y: a + y)
    return filled.select(_long("shard").alias("shard"), _long("bin").alias("bin"), _long("pos").alias("pos"),
                         _round(ckc, 3).alias("proj_ck"))


# --------------------------------------------------------------------------
# Speaker segments
# --------------------------------------------------------------------------
SEG_SQL = """
sg0 AS (SELECT conv_id AS file, role AS speaker, turn AS seg_order, text,
               coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM conversations),
sg AS (SELECT file, speaker, seg_order, text, off::DOUBLE / 100.0::DOUBLE AS "start",
              (off + length(text) + 50)::DOUBLE / 100.0::DOUBLE AS "end" FROM sg0),
st AS (SELECT file, speaker, sum("end" - "start") AS duration, count(*) AS n_segments, min(seg_order) AS first_seen
       FROM sg GROUP BY file, speaker),
ms AS (SELECT file, speaker AS main_speaker, duration AS main_duration FROM (
         SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(duration, 6) DESC, first_seen) AS r FROM st) WHERE r = 1)
"""


@register("speaker_time", f"""
WITH {SEG_SQL}
SELECT file::BIGINT AS file, speaker, round(duration, 6) AS duration, n_segments::BIGINT AS n_segments,
       first_seen::BIGINT AS first_seen FROM st
""")
def speaker_time(spark, sf_dir):
    """A1: total speaking time per (file, speaker); overlaps count twice."""
    t = SEG.speaker_time(FX.segments(spark, sf_dir))
    return t.select(_long("file").alias("file"), "speaker", _round("duration", 6).alias("duration"),
                    _long("n_segments").alias("n_segments"), _long("first_seen").alias("first_seen"))


@register("main_speaker", f"""
WITH {SEG_SQL}
SELECT file::BIGINT AS file, main_speaker, round(main_duration, 6) AS main_duration FROM ms
""")
def main_speaker(spark, sf_dir):
    """A2: arg-max speaker per file, ties to the speaker seen first."""
    m = SEG.main_speaker(FX.segments(spark, sf_dir))
    return m.select(_long("file").alias("file"), "main_speaker", _round("main_duration", 6).alias("main_duration"))


@register("main_speaker_concat", f"""
WITH {SEG_SQL}
SELECT sg.file::BIGINT AS file, count(*)::BIGINT AS n_parts, string_agg(sg.text, '' ORDER BY sg."start") AS text,
       sum(length(sg.text))::BIGINT AS n_chars
FROM sg JOIN ms ON sg.file = ms.file AND sg.speaker = ms.main_speaker GROUP BY sg.file
""")
def main_speaker_concat(spark, sf_dir):
    """J3 -> O5 -> R3: the main speaker's parts in start order, joined."""
    seg = FX.segments(spark, sf_dir)
    mine = SEG.main_speaker_segments(seg)
    c = SEG.concat_segments(mine, "text", "file", sep="")
    return c.select(_long("file").alias("file"), _long("n_parts").alias("n_parts"), "text",
                    _long(F.length("text")).alias("n_chars"))


@register("word_join", """
SELECT conv_id::BIGINT AS conv_id,
       coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS transcript
FROM conversations GROUP BY conv_id
""")
def word_join(spark, sf_dir):
    """Keep ``type == 'word'`` and join the words with one space."""
    w = FX.words(spark, sf_dir)
    return w.select(_long("conv_id").alias("conv_id"), TX.transcript_from_words("words").alias("transcript"))


WAVE_CHUNK = 64          # samples of a chunk; the files of the fixture are short
WAVE_SQL = """
wv AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, event_type
       FROM events)
"""


@register("segment_slice", f"""
WITH {WAVE_SQL},
seg AS (SELECT file, t AS seg_t,
               trunc(((t::DOUBLE - 2.6::DOUBLE) / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT AS s,
               trunc(((t::DOUBLE + 5.7::DOUBLE) / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT AS e
        FROM wv WHERE event_type = 'purchase')
SELECT seg.file::BIGINT AS file, seg.seg_t::BIGINT AS seg_t, s::BIGINT AS start_idx, e::BIGINT AS end_idx,
       count(*)::BIGINT AS n_samples, round(sum(wv.value), 4) AS value_sum
FROM seg JOIN wv ON wv.file = seg.file AND wv.t >= seg.s AND wv.t < seg.e
GROUP BY seg.file, seg.seg_t, s, e
""")
def segment_slice(spark, sf_dir):
    """R4 + J2: cut ``[int(start*1000), int(end*1000))`` out of each user's
    waveform for segments around every purchase event (binned range join)."""
    smp = FX.wave_samples(spark, sf_dir)
    seg = (smp.filter(F.col("event_type") == "purchase")
           .select("file", F.col("t").alias("seg_t"),
                   ((F.col("t").cast("double") - 2.6) / 1000.0).alias("start"),
                   ((F.col("t").cast("double") + 5.7) / 1000.0).alias("end")))
    chunks = WV.chunk_samples(smp.select("file", "t", "value"), chunk=WAVE_CHUNK)
    j = SEG.slice_chunks(chunks, seg, "file", sr=FX.SLICE_SR, chunk=WAVE_CHUNK)
    total = F.aggregate("samples", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return j.groupBy("file", "seg_t", "_s", "_e").agg(
        _long(F.sum(F.size("samples"))).alias("n_samples"), _round(F.sum(total), 4).alias("value_sum")).select(
        _long("file").alias("file"), _long("seg_t").alias("seg_t"), _long("_s").alias("start_idx"),
        _long("_e").alias("end_idx"), "n_samples", "value_sum")


@register("segment_audio_chunks", f"""
WITH {WAVE_SQL},
seg AS (SELECT file, t AS seg_t,
               trunc(((t::DOUBLE - 2.6::DOUBLE) / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT AS s,
               trunc(((t::DOUBLE + 5.7::DOUBLE) / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT AS e
        FROM wv WHERE event_type = 'purchase'),
o AS (SELECT seg.file, wv.value, row_number() OVER (PARTITION BY seg.file ORDER BY seg.seg_t, wv.t) - 1 AS pos
      FROM seg JOIN wv ON wv.file = seg.file AND wv.t >= seg.s AND wv.t < seg.e)
SELECT file::BIGINT AS file, (pos // 32)::BIGINT AS chunk_no, count(*)::BIGINT AS n_samples,
       round(sum(value * (pos % 32 + 1)), 4) AS value_ck
FROM o GROUP BY file, pos // 32
""")
def segment_audio_chunks(spark, sf_dir):
    """J2 -> O5 -> R3 on chunks: the cut segments of each file joined in order,
    written in chunks of 32 samples."""
    smp = FX.wave_samples(spark, sf_dir)
    seg = (smp.filter(F.col("event_type") == "purchase")
           .select("file", F.col("t").alias("seg_t"),
                   ((F.col("t").cast("double") - 2.6) / 1000.0).alias("start"),
                   ((F.col("t").cast("double") + 5.7) / 1000.0).alias("end")))
    chunks = WV.chunk_samples(smp.select("file", "t", "value"), chunk=WAVE_CHUNK)
    cut = written(SEG.slice_chunks(chunks, seg, "file", sr=FX.SLICE_SR, chunk=WAVE_CHUNK), "cut")
    place = sampling.rank_in_group(cut.select("file", "seg_t", "first_t", "samples"), "file", ["seg_t", "first_t"], "out_start",
                                   weight=F.size("samples"))
    out = SEG.assemble_chunks(place, "samples", "out_start", "file", chunk=32)
    weighed = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return out.select(_long("file").alias("file"), _long("chunk_no").alias("chunk_no"),
                      _long(F.size("samples")).alias("n_samples"), _round(weighed, 4).alias("value_ck"))


@register("main_speaker_chunks", f"""
WITH {SEG_SQL},
j AS (SELECT sg.file, string_agg(sg.text, '' ORDER BY sg."start", sg.seg_order) AS text
      FROM sg JOIN ms ON sg.file = ms.file AND sg.speaker = ms.main_speaker GROUP BY sg.file),
k AS (SELECT file, text, unnest(range(0, ((length(text) + 99) // 100)::BIGINT)) AS chunk_no FROM j)
SELECT file::BIGINT AS file, chunk_no::BIGINT AS chunk_no, substr(text, chunk_no * 100 + 1, 100) AS text FROM k
""")
def main_speaker_chunks(spark, sf_dir):
    """J3 -> O5 -> R3 in chunks: what main_speaker_concat joins, 100 characters a row."""
    mine = SEG.main_speaker_segments(FX.segments(spark, sf_dir))
    c = SEG.concat_chunks(mine, "text", "file", chunk=100)
    return c.select(_long("file").alias("file"), _long("chunk_no").alias("chunk_no"), "text")


# --------------------------------------------------------------------------
# Waveforms
# --------------------------------------------------------------------------
@register("resample_linear", f"""
WITH {WAVE_SQL},
n AS (SELECT file, count(*) AS n FROM wv GROUP BY file),
o AS (SELECT file, n, unnest(range(0, floor(n::DOUBLE * (24000.0::DOUBLE / 16000.0::DOUBLE))::BIGINT)) AS t FROM n),
x AS (SELECT file, n, t, greatest((t::DOUBLE + 0.5::DOUBLE) / (24000.0::DOUBLE / 16000.0::DOUBLE) - 0.5::DOUBLE, 0.0::DOUBLE) AS x FROM o),
y AS (SELECT file, t, x, floor(x)::BIGINT AS x0, least(floor(x)::BIGINT + 1, n - 1) AS x1 FROM x)
SELECT y.file::BIGINT AS file, y.t::BIGINT AS t,
       round(a.value * (1 - (y.x - y.x0)) + b.value * (y.x - y.x0), 6) AS value
FROM y JOIN wv a ON a.file = y.file AND a.t = y.x0 JOIN wv b ON b.file = y.file AND b.t = y.x1
""")
def resample_linear(spark, sf_dir):
    """R2 long form: each user's event values as a 16 kHz waveform, resampled to 24 kHz."""
    smp = FX.wave_samples(spark, sf_dir).select("file", "t", "value")
    rates = smp.select("file").distinct().withColumn("sr", F.lit(FX.WAVE_SR))
    r = WV.resample_linear_long(smp, rates, V.TARGET_SR, chunk=WAVE_CHUNK)
    return r.select(_long("file").alias("file"), _long("t").alias("t"), _round("value", 6).alias("value"))


@register("mono_mix", f"""
WITH {WAVE_SQL},
ch AS (SELECT file, t, value AS v0, coalesce(lead(value) OVER (PARTITION BY file ORDER BY t), value) AS v1 FROM wv)
SELECT file::BIGINT AS file, t::BIGINT AS t, round((v0 + v1) / 2, 6) AS value FROM ch
""")
def mono_mix(spark, sf_dir):
    """R1 long form: two channels (the value and the next value) mixed to mono."""
    smp = FX.wave_samples(spark, sf_dir).select("file", "t", "value")
    # channel 1 = the next sample (equi-join on (file, t + 1), no window per file)
    nxt = smp.select("file", (F.col("t") - 1).alias("t"), F.col("value").alias("_next"))
    ch1 = (smp.join(nxt, ["file", "t"], "left").withColumn("value", F.coalesce("_next", "value"))
           .drop("_next").withColumn("channel", F.lit(1)))
    both = smp.withColumn("channel", F.lit(0)).unionByName(ch1)
    m = WV.mono_mix_long(both, "file", "t", "value")
    return m.select(_long("file").alias("file"), _long("t").alias("t"), _round("value", 6).alias("value"))


@register("mono_mix_chunks", f"""
WITH {WAVE_SQL},
ch AS (SELECT file, t, value AS v0, coalesce(lead(value) OVER (PARTITION BY file ORDER BY t), value) AS v1 FROM wv)
SELECT file::BIGINT AS file, t::BIGINT AS t, round((v0 + v1) / 2, 6) AS value FROM ch
""")
def mono_mix_chunks(spark, sf_dir):
    """R1 on chunks: the second channel is the first one a sample later, by the halo."""
    smp = FX.wave_samples(spark, sf_dir).select("file", "t", "value")
    chunks = written(WV.chunk_samples(smp, chunk=WAVE_CHUNK), "chunks")
    later = F.concat(F.slice("samples", F.lit(2), F.size("samples")),
                     F.array(F.coalesce("halo", F.element_at("samples", -1))))
    halo = WV.with_halo(chunks)
    both = (halo.select("file", F.lit(0).alias("channel"), "chunk", "samples")
            .unionByName(halo.select("file", F.lit(1).alias("channel"), "chunk", later.alias("samples"))))
    m = WV.mono_mix_chunks(both).withColumn("first_t", F.col("chunk") * WAVE_CHUNK)
    return WV.explode_chunks(m).select(_long("file").alias("file"), _long("t").alias("t"), _round("value", 6).alias("value"))


@register("segment_slice_array", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
       trunc(((vec_id % 40)::DOUBLE / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT * 2 AS s,
       trunc((((vec_id % 40)::DOUBLE + 15.7::DOUBLE) / 1000.0::DOUBLE) * 1000.0::DOUBLE)::BIGINT * 2 AS e FROM embeddings)
SELECT vec_id::BIGINT AS vec_id, len(v[s + 1:e])::BIGINT AS n_samples, round(coalesce(list_sum(v[s + 1:e]), 0), 5) AS value_sum FROM e
""")
def segment_slice_array(spark, sf_dir):
    """R4 + J2 on one sample array per file (vectors as files of 2 kHz samples)."""
    e = FX.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    at = (F.col("vec_id") % 40).cast("double")
    s = e.select("vec_id", SEG.slice_samples("v", at / 1000.0, (at + 15.7) / 1000.0, sr=2000).alias("v"))
    return s.select(_long("vec_id").alias("vec_id"), _long(F.size("v")).alias("n_samples"),
                    _round(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x), 5).alias("value_sum"))


@register("resample_array", """
WITH e AS (SELECT vec_id, embedding AS v, len(embedding) AS n FROM embeddings),
o AS (SELECT vec_id, v, n, unnest(range(0, floor(n::DOUBLE * 1.5::DOUBLE)::BIGINT)) AS t FROM e),
x AS (SELECT vec_id, v, n, t, greatest((t::DOUBLE + 0.5::DOUBLE) / 1.5::DOUBLE - 0.5::DOUBLE, 0.0::DOUBLE) AS x FROM o)
SELECT vec_id::BIGINT AS vec_id, t::BIGINT AS t, round(v[floor(x)::BIGINT + 1]::DOUBLE * (1 - (x - floor(x)))
       + v[least(floor(x)::BIGINT + 1, n - 1) + 1]::DOUBLE * (x - floor(x)), 5) AS value FROM x
""")
def resample_array(spark, sf_dir):
    """R2 on one sample array per file: no shuffle."""
    e = FX.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    r = e.select("vec_id", F.posexplode(WV.resample_linear("embedding", FX.WAVE_SR, V.TARGET_SR)).alias("t", "value"))
    return r.select(_long("vec_id").alias("vec_id"), _long("t").alias("t"), _round("value", 5).alias("value"))


@register("mono_mix_array", """
WITH e AS (SELECT vec_id, embedding AS v, unnest(range(0, 32)) AS t FROM embeddings)
SELECT vec_id::BIGINT AS vec_id, t::BIGINT AS t, round((v[t + 1]::DOUBLE + v[t + 33]::DOUBLE) / 2, 5) AS value FROM e
""")
def mono_mix_array(spark, sf_dir):
    """R1 on one array of channels per file (the halves of a vector): no shuffle."""
    e = FX.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("channels"))
    m = e.select("vec_id", F.posexplode(WV.mono_mix("channels")).alias("t", "value"))
    return m.select(_long("vec_id").alias("vec_id"), _long("t").alias("t"), _round("value", 5).alias("value"))


# --------------------------------------------------------------------------
# Ingest, URLs, pairing, run log, unions
# --------------------------------------------------------------------------
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIPPED_SQL = f"regexp_replace(text, {_sql_str('^' + V.PY_WHITESPACE_CLASS + '+|' + V.PY_WHITESPACE_CLASS + '+$')}, '', 'g')"


@register("video_id", f"""
WITH u AS (SELECT page_id, CASE page_id % 5
    WHEN 0 THEN 'https://youtu.be/v' || page_id::VARCHAR || '?t=1'
    WHEN 1 THEN 'https://www.youtube.com/watch?v=v' || page_id::VARCHAR || '&feature=share'
    WHEN 2 THEN 'https://youtube.com/shorts/v' || page_id::VARCHAR
    WHEN 3 THEN 'https://m.youtube.com/watch?app=desktop&v=v' || page_id::VARCHAR
    ELSE url END AS url FROM pages),
x AS (SELECT page_id, url, nullif(regexp_extract(url, {_sql_str(V.VIDEO_ID_PATTERN)}, 1), '') AS video_id FROM u)
SELECT page_id::BIGINT AS page_id, url, video_id, 'downloads/' || video_id || '.mp3' AS out_path,
       video_id IS NOT NULL AS ok FROM x
""")
def video_id(spark, sf_dir):
    """P1 + P2: video id of every URL (NULL = quarantine) and its output path."""
    u = FX.video_urls(spark, sf_dir)
    x = u.select("page_id", "url", TX.video_id("url").alias("video_id"))
    return x.select(_long("page_id").alias("page_id"), "url", "video_id",
                    TX.output_path("downloads", "video_id").alias("out_path"), F.col("video_id").isNotNull().alias("ok"))


@register("url_list_literals", """
WITH u AS (SELECT page_id // 10 AS list_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS pos,
                  url || CASE WHEN page_id % 3 = 0 THEN '&q=it''s "ok"' ELSE '' END AS url FROM pages)
SELECT list_id::BIGINT AS list_id, pos::BIGINT AS pos, url, 'ok' AS status FROM u WHERE list_id % 5 <> 4
UNION ALL SELECT DISTINCT list_id::BIGINT, NULL::BIGINT, NULL::VARCHAR, 'not a list literal' FROM u WHERE list_id % 5 = 4
""")
def url_list_literals(spark, sf_dir):
    """S6 -> P7: ten page URLs a list, written as literals of five kinds and parsed;
    every fifth list does not close and goes to quarantine."""
    extra = F.when(F.col("page_id") % 3 == 0, F.lit("&q=it's \"ok\"")).otherwise("")
    p = FX.table(spark, sf_dir, "pages").select("page_id", F.concat("url", extra).alias("url"))
    lists = p.groupBy(F.expr("page_id div 10").alias("list_id")).agg(F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("u"))
    urls = F.transform("u", lambda x: x["url"])

    def quoted(q: str, escape=lambda x: x):
        return F.transform(urls, lambda x: F.concat(F.lit(q), escape(F.replace(x, F.lit(q), F.lit("\\" + q))), F.lit(q)))

    hexed = lambda x: F.replace(F.replace(x, F.lit("/"), F.lit("\\x2f")), F.lit("e"), F.lit("\\u0065"))
    kind = F.col("list_id") % 5
    text = (F.when(kind == 0, F.concat(F.lit("["), F.array_join(quoted("'"), ", "), F.lit("]")))
            .when(kind == 1, F.concat(F.lit("["), F.array_join(quoted('"'), ","), F.lit(" , ]\n")))
            .when(kind == 2, F.concat(F.lit("["), F.array_join(quoted("'", hexed), ", "), F.lit("]")))
            .when(kind == 3, F.concat(F.lit("[  # it's a list\n"), F.array_join(quoted('"'), ",  # \"next\"\n"), F.lit("\n]")))
            .otherwise(F.concat(F.lit("["), F.array_join(quoted("'"), ", "))))
    parsed = lists.select("list_id", TX.list_literal(text).alias("urls"))
    good = parsed.filter(F.col("urls").isNotNull()).select("list_id", F.posexplode("urls").alias("pos", "url")).withColumn("status", F.lit("ok"))
    bad = parsed.filter(F.col("urls").isNull()).select("list_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("url"),
                                                       F.lit("not a list literal").alias("status"))
    return good.unionByName(bad).select(_long("list_id").alias("list_id"), _long("pos").alias("pos"), "url", "status")


@register("lift_field", """
SELECT doc_id::BIGINT AS doc_id, text, 16000::BIGINT AS sampling_rate FROM documents WHERE source <> 'src3'
""")
def lift_field(spark, sf_dir):
    """S1 + P6 + P4 + P3: rows shaped ``{json: {text}, mp3: {array, sampling_rate}}``
    (``mp3`` missing for one source); keep rows with audio, lift ``json.text``,
    keep only the produced columns."""
    d = FX.table(spark, sf_dir, "documents")
    mp3 = F.when(F.col("source") == "src3", F.lit(None)).otherwise(
        F.struct(F.array(F.col("n_chars").cast("float")).alias("array"), F.lit(16000).alias("sampling_rate")))
    shaped = d.select("doc_id", F.struct(F.col("text").alias("text")).alias("json"), mp3.alias("mp3"))
    return shaped.filter(F.col("mp3.array").isNotNull()).select(
        _long("doc_id").alias("doc_id"), F.col("json.text").alias("text"), _long("mp3.sampling_rate").alias("sampling_rate"))


@register("nonempty_text", f"""
WITH s AS (SELECT doc_id, regexp_replace(text, {_sql_str('^' + V.PY_WHITESPACE_CLASS + '+|' + V.PY_WHITESPACE_CLASS + '+$')}, '', 'g') AS text
           FROM documents)
SELECT doc_id::BIGINT AS doc_id, text, length(text)::BIGINT AS n_chars FROM s WHERE length(text) > 0
""")
def nonempty_text(spark, sf_dir):
    """S5 text handling + P5: strip like ``str.strip()``, drop empty transcripts."""
    d = FX.table(spark, sf_dir, "documents")
    s = d.select("doc_id", TX.py_strip("text").alias("text"))
    return s.filter(F.length("text") > 0).select(_long("doc_id").alias("doc_id"), "text",
                                                 _long(F.length("text")).alias("n_chars"))


@register("pairing", """
SELECT d.doc_id::BIGINT AS doc_id, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic, d.n_chars::BIGINT AS n_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def pairing(spark, sf_dir):
    """Audio (documents) and transcripts (labels) paired by stem."""
    d = FX.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), "n_chars")
    lab = FX.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem"), "quality", "toxic")
    pairs, _, _ = ingest.pair_by_stem(d, lab, "stem")
    return pairs.select(_long("stem").alias("doc_id"), _long("quality").alias("quality"), _long("toxic").alias("toxic"),
                        _long("n_chars").alias("n_chars"))


@register("pairing_missing", """
SELECT 'no transcript' AS missing, doc_id::BIGINT AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'no audio', doc_id::BIGINT FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 1)
""")
def pairing_missing(spark, sf_dir):
    """J1 reports: audio without a transcript, and transcripts whose audio is missing."""
    d = FX.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"))
    lab = FX.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem"))
    _, no_text, _ = ingest.pair_by_stem(d, lab, "stem")
    _, _, no_audio = ingest.pair_by_stem(d.where("stem % 3 <> 1"), lab, "stem")
    return (no_text.select(F.lit("no transcript").alias("missing"), _long("stem").alias("doc_id"))
            .unionByName(no_audio.select(F.lit("no audio").alias("missing"), _long("stem").alias("doc_id"))))


@register("skip_done", """
SELECT d.doc_id::BIGINT AS doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def skip_done(spark, sf_dir):
    """Work left after removing stems whose output exists (labels = done)."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id")
    done = FX.table(spark, sf_dir, "labels").select("doc_id")
    return ingest.skip_done(d, done, "doc_id").select(_long("doc_id").alias("doc_id"))


@register("shard_paths", f"""
SELECT DISTINCT (doc_id // 100 - 1)::BIGINT AS shard, printf({_sql_str(V.SHARD_PATH_FORMAT)}, greatest(doc_id // 100 - 1, 0)) AS path
FROM documents
""")
def shard_paths(spark, sf_dir):
    """S3: shard index -> file name (indexes below 1 map to shard 0)."""
    from voxloom.sources.readers import shard_manifest
    d = FX.table(spark, sf_dir, "documents").select(F.expr("doc_id div 100 - 1").alias("shard")).distinct()
    return shard_manifest(d, "shard").select(_long("shard").alias("shard"), "path")


class BusyClient:
    """A service that turns the first ``id % 5`` calls of a job away."""

    def __init__(self) -> None:
        self.calls: dict[str, int] = {}

    def fetch(self, job: str) -> str:
        self.calls[job] = self.calls.get(job, 0) + 1
        if self.calls[job] <= int(job.split(":")[0]) % 5:
            raise ConnectionError(f"busy at call {self.calls[job]}")
        return f"got {job}"


@register("retry_calls", """
SELECT doc_id::BIGINT AS doc_id, CASE WHEN doc_id % 5 < 3 THEN 'got ' || doc_id::VARCHAR || ':' || n_chars::VARCHAR END AS result,
       CASE WHEN doc_id % 5 < 3 THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN doc_id % 5 >= 3 THEN 'ConnectionError: busy at call 3' END AS error,
       least(doc_id % 5 + 1, 3)::BIGINT AS attempts
FROM documents
""")
def retry_calls(spark, sf_dir):
    """M2 + M3 under failures: up to three calls a document to a service that is often busy."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "doc_id", "n_chars").alias("job"))
    got = call_with_retry(d, "job", lambda: itertools.repeat(BusyClient()), BusyClient.fetch, policy=RetryPolicy(attempts=3))
    return got.select(_long("doc_id").alias("doc_id"), "result", "status", "error", _long("attempts").alias("attempts"))


@register("status_counts", """
SELECT event_type AS status, count(*)::BIGINT AS n, arg_min(props, event_id) AS first_props FROM events GROUP BY event_type
""")
def status_counts(spark, sf_dir):
    """Run-log counts per status with the first message of each."""
    e = FX.table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), "props", F.col("event_id").alias("shard"))
    return ingest.status_counts(e, "status", "props").select(
        "status", _long("n").alias("n"), F.col("first_error").alias("first_props"))


RUN_SHARDS = 8
RUN_ERROR = "shard 3 cannot be decoded"


def logged_run(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """``documents`` dealt to 8 shard files and ingested in two passes, two shards coming late; shard 3
    fails in its first attempt and is retried.  Returns the ingested rows and the log."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/voxloom-run-{uuid.uuid4().hex}"
    src, sink, log, state = (f"{root}/{x}" for x in ("in", "rows", "log", "state"))
    docs = FX.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % RUN_SHARDS).cast("int").alias("part"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def transform(rows: DataFrame, attempt: int) -> DataFrame:
        broken = (F.col("doc_id") % RUN_SHARDS == 3) & (F.col("doc_id") % (2 * RUN_SHARDS) == 3) & F.lit(attempt == 1)
        return rows.select("shard", "doc_id", F.length("text").alias("n_chars"), F.when(broken, F.lit(RUN_ERROR)).alias("error"))

    for late in (False, True):
        sinks.write_sharded(docs.where((F.col("part") >= RUN_SHARDS - 2) == F.lit(late)), src, "part")
        streaming.ingest_logged(spark, f"{src}/part=*", schema, sink, log, state, transform, max_files_per_trigger=4)
    streaming.retry_failed(spark, schema, sink, log, transform)
    index = F.regexp_extract("shard", r"part=(\d+)/", 1).cast("long").alias("shard")
    return (streaming.read_ingested(spark, sink, log).select(index, "doc_id", "n_chars"),
            streaming.read_log(spark, log).select(index, "attempt", "status", "n_rows", "n_errors", "error"))


@register("ingest_run_log", f"""
WITH s AS (SELECT doc_id % {RUN_SHARDS} AS shard, count(*) AS n, coalesce(sum(length(text)), 0) AS n_chars FROM documents GROUP BY 1)
SELECT shard::BIGINT AS shard, CASE WHEN shard = 3 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN shard = 3 THEN 1 ELSE 0 END::BIGINT AS failures,
       n::BIGINT AS logged_rows, n::BIGINT AS n_rows, n::BIGINT AS n_docs, n_chars::BIGINT AS n_chars FROM s
""")
def ingest_run_log(spark, sf_dir):
    """Per shard its attempts and what is in the sink after two passes and a retry."""
    rows, log = logged_run(spark, sf_dir)
    per = log.groupBy("shard").agg(_long(F.max("attempt")).alias("attempts"), _long(F.count_if(F.col("status") == "failed")).alias("failures"),
                                   _long(F.sum("n_rows")).alias("logged_rows"))
    sink = rows.groupBy("shard").agg(_long(F.count("*")).alias("n_rows"), _long(F.countDistinct("doc_id")).alias("n_docs"),
                                     _long(F.coalesce(F.sum("n_chars"), F.lit(0))).alias("n_chars"))
    return per.join(sink, "shard", "left")


@register("ingest_status_counts", f"""
WITH s AS (SELECT doc_id % {RUN_SHARDS} AS shard, doc_id FROM documents)
SELECT 'done' AS status, count(DISTINCT shard)::BIGINT AS n, 0::BIGINT AS n_errors, NULL::VARCHAR AS first_error FROM s
UNION ALL
SELECT 'failed', 1, count(*)::BIGINT, '{RUN_ERROR}' FROM s WHERE shard = 3 AND doc_id % {2 * RUN_SHARDS} = 3
""")
def ingest_status_counts(spark, sf_dir):
    """A6 over the log that S11 wrote."""
    _, log = logged_run(spark, sf_dir)
    errors = log.groupBy("status").agg(_long(F.sum("n_errors")).alias("n_errors"))
    return ingest.status_counts(log, "status", "error").withColumn("n", _long("n")).join(errors, "status").select("status", "n", "n_errors", "first_error")


@register("quarantine_counts", f"""
WITH {DOC_CTE}
SELECT sum(CASE WHEN len(codes) < 700 THEN 0 ELSE 1 END)::BIGINT AS good, sum(CASE WHEN len(codes) < 700 THEN 1 ELSE 0 END)::BIGINT AS quarantined,
       max(len(codes))::BIGINT AS longest, sum(CASE WHEN len(codes) < 700 THEN 1 ELSE 0 END)::BIGINT AS read_back FROM dc
""")
def quarantine_counts(spark, sf_dir):
    """Counts observed while good and bad rows are written, in the one pass."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False).select("doc_id", "codes_list")
    path = f"{checkpoint_dir(spark).rstrip('/')}/voxloom-quarantine-{uuid.uuid4().hex}"
    seen = ingest.write_with_quarantine(b, F.when(F.size("codes_list") < 700, F.lit("fewer than 100 frames")), path,
                                        counts={"longest": F.max(F.size("codes_list"))})
    back = spark.read.parquet(path).where("quarantined = 'true'").agg(_long(F.count("*")).alias("read_back"))
    return back.select(*(F.lit(seen[c]).cast("long").alias(c) for c in ("good", "quarantined", "longest")), "read_back")


@register("quarantine", f"""
WITH {DOC_CTE},
q AS (SELECT doc_id, CASE WHEN len(codes) < 7 THEN 'no full audio frame'
                          WHEN length(regexp_replace(text, {_sql_str('^' + V.PY_WHITESPACE_CLASS + '+|' + V.PY_WHITESPACE_CLASS + '+$')}, '', 'g')) = 0 THEN 'empty transcript'
                          END AS error FROM dc)
SELECT doc_id::BIGINT AS doc_id, coalesce(error, 'ok') AS status FROM q
""")
def quarantine(spark, sf_dir):
    """Bad rows split off with an error text instead of failing the job."""
    b = FX.bulk_rows(spark, sf_dir, with_embedding=False)
    err = (F.when(F.size("codes_list") < 7, F.lit("no full audio frame"))
           .when(F.length(TX.py_strip("text")) == 0, F.lit("empty transcript")))
    tagged = ingest.tag_errors(b.select("doc_id", "text", "codes_list"), err)
    return tagged.select(_long("doc_id").alias("doc_id"), F.coalesce("error", F.lit("ok")).alias("status"))


@register("union_batches", f"""
WITH {DOC_CTE},
r AS (SELECT doc_id, len(text_ids) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM dc)
SELECT doc_id::BIGINT AS doc_id, (CASE WHEN idx < total // 2 THEN 0 ELSE 1 END)::BIGINT AS half,
       (idx // 1000)::BIGINT AS batch, n::BIGINT AS n_tokens FROM r
""")
def union_batches(spark, sf_dir):
    """O4 + U1: the table cut in two halves processed apart, then concatenated."""
    d = FX.table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    n = d.count()
    idx = sampling.with_global_index(d, ["doc_id"], "idx", n_rows=n)
    halves = [idx.filter(F.col("idx") < n // 2).withColumn("half", F.lit(0)),
              idx.filter(F.col("idx") >= n // 2).withColumn("half", F.lit(1))]
    done = [h.select("doc_id", "half", "idx", F.size(A.byte_tokens("text")).alias("n_tokens")) for h in halves]
    u = sampling.row_batches(done[0].unionByName(done[1]), "idx", V.BATCH_ROWS)
    return u.select(_long("doc_id").alias("doc_id"), _long("half").alias("half"), _long("batch").alias("batch"),
                    _long("n_tokens").alias("n_tokens"))


@register("embedding_split", """
WITH e AS (SELECT vec_id, embedding AS flat FROM embeddings),
k AS (SELECT vec_id, flat, unnest(range(0, len(flat) // 16)) AS k FROM e)
SELECT vec_id::BIGINT AS vec_id, k::BIGINT AS k, len(flat[k * 16 + 1:(k + 1) * 16])::BIGINT AS width,
       round(list_sum(list_transform(flat[k * 16 + 1:(k + 1) * 16], lambda x: x::DOUBLE)), 5) AS vec_sum FROM k
""")
def embedding_split(spark, sf_dir):
    """Q13 + Q14: nested ``[1, 1, d]`` embeddings flattened, then a flat run of
    floats split into 16-wide vectors."""
    e = FX.table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array("embedding")).alias("nested"))
    flat = e.select("vec_id", A.flatten_nested("nested").alias("flat"))
    parts = flat.select("vec_id", F.posexplode(A.split_flat("flat", 16)).alias("k", "v"))
    return parts.select(_long("vec_id").alias("vec_id"), _long("k").alias("k"), _long(F.size("v")).alias("width"),
                        _round(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 5).alias("vec_sum"))


@register("main_speaker_offsets", f"""
WITH {SEG_SQL},
mine AS (SELECT sg.* FROM sg JOIN ms ON sg.file = ms.file AND sg.speaker = ms.main_speaker)
SELECT file::BIGINT AS file, seg_order::BIGINT AS seg_order,
       coalesce(sum(length(text)) OVER (PARTITION BY file ORDER BY "start", "end", seg_order
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_start,
       length(text)::BIGINT AS n_chars
FROM mine
""")
def main_speaker_offsets(spark, sf_dir):
    """R3 in long form: where each main-speaker part lands in the joined output
    (a running length per file without a window per file)."""
    seg = FX.segments(spark, sf_dir)
    mine = SEG.main_speaker_segments(seg).withColumn("n_chars", F.length("text"))
    off = SEG.segment_offsets(mine, "n_chars", "file", "seg_order")
    return off.select(_long("file").alias("file"), _long("seg_order").alias("seg_order"),
                      _long("out_start").alias("out_start"), _long("n_chars").alias("n_chars"))


@register("training_rows", f"""
WITH {DOC_CTE},
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM dc),
h AS (SELECT dc.doc_id, text_ids, codes FROM dc JOIN r USING (doc_id) WHERE rn < n // 5),
s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS idx,
             ({PLAIN_SQL})[1:2048] AS ids FROM h)
SELECT doc_id::BIGINT AS doc_id, idx::BIGINT AS idx, len(ids)::BIGINT AS n_ids, {ck('ids')} AS ids_ck,
       len(ids)::BIGINT AS mask_len FROM s
""")
def training_rows(spark, sf_dir):
    """Training path without speaker: O2 (first fifth) -> O1 -> Q4 -> Q7 -> Q8 -> Q9."""
    from voxloom.plans.paths import plain_training_rows
    rows = FX.bulk_rows(spark, sf_dir, with_embedding=False).select("doc_id", "text", "codes_list")
    t = plain_training_rows(rows, "doc_id")
    return t.select(_long("doc_id").alias("doc_id"), _long("idx").alias("idx"), _long(F.size("input_ids")).alias("n_ids"),
                    A.checksum("input_ids").alias("ids_ck"), _long(F.size("attention_mask")).alias("mask_len"))


# --------------------------------------------------------------------------
# File sinks read back (S2, S4, S5, S7, S9, K5) and the curated path
# --------------------------------------------------------------------------
def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/voxloom-{tag}-{uuid.uuid4().hex}"


@register("sealed_shards", "WITH RECURSIVE " + PACK_INPUT_SQL + f"""
SELECT (shard // {PACK_INNER})::BIGINT AS outer_shard, shard::BIGINT AS shard, bin::BIGINT AS bin, n_rows::BIGINT AS n_rows,
       len(ids)::BIGINT AS n_tokens, {ck('ids')} AS ids_ck, CASE WHEN shard // {PACK_INNER} = 1 THEN 2 ELSE 1 END::BIGINT AS version,
       count(*) OVER (PARTITION BY shard // {PACK_INNER})::BIGINT AS sealed_rows
FROM pk
""")
def sealed_shards(spark, sf_dir):
    """K5 -> S2: packed rows per outer shard; shard 1 was cut short, is written again, and a further write dies unsealed."""
    path = _scratch(spark, "sealed")
    p = written(packed(spark, sf_dir).select(F.col("shard").alias("pack_shard"), "bin", "n_rows", "n_tokens", "input_ids",
                                             F.floor(F.col("shard") / PACK_INNER).cast("long").alias("shard")), "packed")
    broken = F.when(F.col("shard") == 1, F.slice("input_ids", 1, 10)).otherwise(F.col("input_ids"))
    sealed.write_sealed(p.withColumn("input_ids", broken), path)
    sealed.write_sealed(p.where("shard = 1"), path, files_per_shard=2)
    p.where("shard = 0").write.partitionBy("shard").parquet(f"{path}/run=r-died")
    rows = sealed.read_sealed(spark, path, p.schema).join(sealed.read_seals(spark, path).select("shard", "version", F.col("n_rows").alias("sealed_rows")), "shard")
    return rows.select(_long("shard").alias("outer_shard"), _long("pack_shard").alias("shard"), _long("bin").alias("bin"),
                       _long("n_rows").alias("n_rows"), _long("n_tokens").alias("n_tokens"), A.checksum("input_ids").alias("ids_ck"),
                       "version", "sealed_rows")


@register("shard_files", """
SELECT doc_id::BIGINT AS doc_id, (doc_id % 8)::BIGINT AS shard, length(CASE WHEN doc_id % 8 = 3 THEN upper(lang) ELSE lang END)::BIGINT AS n,
       CASE WHEN doc_id % 8 = 3 THEN upper(lang) ELSE lang END AS lang
FROM documents WHERE doc_id % 8 <> 5
""")
def shard_files(spark, sf_dir):
    """S7 -> S2: eight shards written, one written again, all but one read by number."""
    path = _scratch(spark, "shards")
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 8).cast("int").alias("shard"))
    sinks.write_sharded(d, path, files_per_shard=2)
    sinks.write_sharded(d.where("shard = 3").withColumn("lang", F.upper("lang")), path)
    back = readers.read_shards(spark, path, shards=[0, 1, 2, 3, 4, 6, 7], schema=d.schema)
    return back.select(_long("doc_id").alias("doc_id"), _long("shard").alias("shard"), _long(F.length("lang")).alias("n"), "lang")


RECORDING_DOCS = 50              # documents of one recording in transcript_files
STEM_SQL = ("CASE g % 6 WHEN 0 THEN 'a b ' || g WHEN 1 THEN 'c%d' || g WHEN 2 THEN '-' || g "
            "WHEN 3 THEN 'e=f/' || g WHEN 4 THEN '00' || g ELSE '_' || g || '+.txt' END")


@register("transcript_files", f"""
WITH d AS (SELECT doc_id // {RECORDING_DOCS} AS g, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1),
s AS (SELECT {STEM_SQL} AS stem, CASE WHEN g % 7 = 3 THEN ' ' ELSE ' ' || text || chr(10) END AS raw FROM d),
t AS (SELECT stem, raw, {STRIPPED_SQL.replace("(text,", "(raw,")} AS text FROM s)
SELECT stem, md5(text) AS text_md5, length(raw)::BIGINT AS n_raw, 1::BIGINT AS n_files FROM t WHERE NOT starts_with(stem, '-') AND length(text) > 0
""")
def transcript_files(spark, sf_dir):
    """S9 -> S4 -> S5 -> P5: recordings of 50 documents, a file per stem (spaces, signs, slashes, leading zeros
    and dashes), scanned and read back."""
    path = _scratch(spark, "transcripts")
    d = FX.table(spark, sf_dir, "documents").groupBy(F.expr(f"doc_id div {RECORDING_DOCS}").alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("parts"))
    n, form = F.col("g").cast("string"), F.col("g") % 6
    stem = (F.when(form == 0, F.concat(F.lit("a b "), n)).when(form == 1, F.concat(F.lit("c%d"), n)).when(form == 2, F.concat(F.lit("-"), n))
            .when(form == 3, F.concat(F.lit("e=f/"), n)).when(form == 4, F.concat(F.lit("00"), n)).otherwise(F.concat(F.lit("_"), n, F.lit("+.txt"))))
    raw = F.when(F.col("g") % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.array_join("parts.text", "\n"), F.lit("\n")))
    sinks.write_transcript_files(d.select(stem.alias("stem"), raw.alias("text")), path)
    files = readers.scan_transcript_files(spark, path).groupBy("stem").agg(F.count("*").alias("n_files"))
    exact = readers.read_transcript_files(spark, path, strip=False)
    t = exact.select("stem", F.length("text").alias("n_raw"), TX.py_strip("text").alias("text")).where(F.length("text") > 0)
    return t.join(files, "stem").select("stem", F.md5("text").alias("text_md5"), _long("n_raw").alias("n_raw"), _long("n_files").alias("n_files"))


class Transcriber:
    """A transcription client: recordings named ``<id>:<what is said>``.  Each of two clients is busy for another sixth
    of the recordings, a sixth cannot be decoded and a sixth is silent."""

    def __init__(self, busy: int) -> None:
        self.busy = busy

    def words(self, recording: str) -> list[dict[str, str]]:
        number, said = recording.split(":", 1)
        kind = int(number) % 6
        if kind in (self.busy, 5):
            raise ConnectionError("busy" if kind == self.busy else "cannot be decoded")
        spoken = [] if kind == 4 else said.split(" ")
        return [entry for w in spoken for entry in ({"type": "word", "text": w}, {"type": "spacing", "text": " "})]


@register("curated_rows", f"""
WITH {DOC_CTE}, ne AS (SELECT count(*) AS nv FROM embeddings),
st AS (SELECT doc_id, {STRIPPED_SQL} AS text FROM documents),
sb AS (SELECT doc_id, [128000] || {BYTES_SQL} AS text_ids FROM st WHERE doc_id % 6 < 4 AND length(text) > 0),
r AS (SELECT doc_id, {SPEAKER_SQL.format(ph=-100)} AS ids FROM (SELECT sb.doc_id, sb.text_ids, dd.dedup FROM sb JOIN dd USING (doc_id)))
SELECT r.doc_id::BIGINT AS doc_id, len(ids)::BIGINT AS n_tokens, {ck('ids')} AS ids_ck,
       len(list_filter(ids, lambda x: x = -100))::BIGINT AS n_placeholders, len(e.embedding)::BIGINT AS dim
FROM r, ne JOIN embeddings e ON e.vec_id = r.doc_id % ne.nv
""")
def curated_rows(spark, sf_dir):
    """The curated path: M3 (two clients taking turns) -> P8 -> P5 -> J1 -> Q15 -> Q3 -> Q5."""
    b = FX.bulk_rows(spark, sf_dir).withColumnRenamed("doc_id", "stem")
    audio = FX.table(spark, sf_dir, "documents", spread=True).select(F.col("doc_id").alias("stem"), F.concat_ws(":", "doc_id", "text").alias("path"))
    said = PATHS.transcripts(audio, lambda: itertools.cycle([Transcriber(2), Transcriber(3)]), Transcriber.words,
                             policy=RetryPolicy(attempts=2, first_wait=0.0))
    rows = PATHS.speaker_rows(said, b.select("stem", "codes_list"), b.select("stem", "speaker_embedding"))
    return rows.select(_long("stem").alias("doc_id"), _long(F.size("input_ids")).alias("n_tokens"), A.checksum("input_ids").alias("ids_ck"),
                       _long(A.count_value("input_ids", V.IGNORE_LABEL)).alias("n_placeholders"), _long(F.size("speaker_embedding")).alias("dim"))


@register("transcript_status", """
SELECT doc_id::BIGINT AS doc_id, CASE WHEN doc_id % 6 = 5 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN doc_id % 6 = 5 THEN 'ConnectionError: cannot be decoded' END AS error,
       CASE WHEN doc_id % 6 < 4 THEN length(text) ELSE 0 END::BIGINT AS n_chars
FROM documents
""")
def transcript_status(spark, sf_dir):
    """M3 by turns between clients: what each recording came to, and its transcript's length."""
    audio = FX.table(spark, sf_dir, "documents", spread=True).select(F.col("doc_id").alias("stem"), F.concat_ws(":", "doc_id", "text").alias("path"))
    said = PATHS.transcripts(audio, lambda: itertools.cycle([Transcriber(2), Transcriber(3)]), Transcriber.words,
                             policy=RetryPolicy(attempts=2, first_wait=0.0))
    return said.select(_long("stem").alias("doc_id"), "status", "error", _long(F.length("text")).alias("n_chars"))


@register("download_jobs", f"""
WITH u AS (SELECT page_id, CASE page_id % 5
    WHEN 0 THEN 'https://youtu.be/v' || page_id::VARCHAR || '?t=1'
    WHEN 1 THEN 'https://www.youtube.com/watch?v=v' || page_id::VARCHAR || '&feature=share'
    WHEN 2 THEN 'https://youtube.com/shorts/v' || page_id::VARCHAR
    WHEN 3 THEN 'https://m.youtube.com/watch?app=desktop&v=v' || page_id::VARCHAR
    ELSE url END AS url FROM pages),
x AS (SELECT page_id, url, nullif(regexp_extract(url, {_sql_str(V.VIDEO_ID_PATTERN)}, 1), '') AS video_id FROM u)
SELECT DISTINCT 'fetch' AS status, video_id AS item, 'audio/' || video_id || '.mp3' AS out_path FROM x
WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT 'v' || page_id::VARCHAR FROM pages WHERE page_id % 4 = 0)
UNION ALL SELECT 'no video id', url, NULL FROM x WHERE video_id IS NULL
""")
def download_jobs(spark, sf_dir):
    """P1 -> P2 -> S10: videos still to fetch, each once (every URL is listed twice), and URLs without one."""
    u = FX.video_urls(spark, sf_dir)
    done = FX.table(spark, sf_dir, "pages").where("page_id % 4 = 0").select(F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("video_id"))
    jobs, _ = PATHS.download_jobs(u.unionByName(u), done, "audio")
    _, bad = PATHS.download_jobs(u, done, "audio")
    return (jobs.select(F.lit("fetch").alias("status"), F.col("video_id").alias("item"), "out_path")
            .unionByName(bad.select(F.lit("no video id").alias("status"), F.col("url").alias("item"), F.lit(None).cast("string").alias("out_path"))))
