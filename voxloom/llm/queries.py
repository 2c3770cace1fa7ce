"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import (ann, chat, conversation_trie, hard_negatives, jaccard_join, mixing, packing, pii, quality_model, quality_rules,
                         substring_dedup, token_counts, toxicity)
from voxloom.llm.common import materialize, table

#: folder of the public vocabularies (a parameter of the operators)
TOKENIZERS = "/opt/tokenizers"


def _tokenizer(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), keep_ids=True, id_bytes=2)
    return packing.pieces_of(materialize(packing.sequences(packed, id_bytes=2), "packed"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: what conversation -1 says, as user and as assistant
_CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", _CONTROL_TEXT), (-1, 1, "assistant", _CONTROL_TEXT)], rows.schema)
    convs = materialize(chat.conversation_table(rows.unionByName(own)), "conversations")
    path = _tokenizer("byte_bpe_50k.json")
    said = chat.read_back(materialize(chat.format_conversations(convs, path), "sequences"), path)
    return convs.select("conv_id", "cls").join(said, "cls").drop("cls")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the mixed corpus is written; taken is counted in it (the SQL's columns do not show the positions)
    _, plan = mixing.mixed_corpus(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, quality_model.grades(table(spark, sf_dir, "labels")))
    return quality_model.score(docs, model)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = jaccard_join.linked_documents(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_shingles", "component_id", "n_links")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [F.aggregate("base", F.lit(0).cast("long"), _counter(i)) for i in range(4)]
    return found.select("doc_id", *(c.alias(f"n_{k}") for c, k in zip(counts, pii.KINDS)),
                        F.sha2(pii.span_string(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_string(F.col("spans")).alias("spans"))


def _counter(kind: int):
    return lambda n, s: n + (s["kind"] == kind).cast("long")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = conversation_trie.shared_openings(table(spark, sf_dir, "conversations"))
    nodes, ends = conversation_trie.prefix_trie(turns, convs)
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    both = nodes.join(conversation_trie.member_digests(ends), ["conv_id", "depth"], "left")
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_nearest_neighbours, op3_best_fit_packing, op4_toxicity, op5_chat_format, op6_mixing,
                            op7_quality_classifier, op8_jaccard_join, op9_token_counts, op10_pii, op11_conversation_trie, op12_substring_dedup,
                            op13_hard_negatives, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (
  SELECT rid, i, hash(list_slice(w, i, i + 7)) AS h, list_slice(w, i, i + 7) AS x
  FROM d, range(1, len(w) - 6) AS r(i) WHERE len(w) >= 8),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS g(k) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM ln
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (
  SELECT d.doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(dup.n_lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 2 > n_lines
            OR word_chars > n_words * 20 OR word_chars < n_words * 2
            OR len(regexp_extract_all(t, '\p{{Lu}}')) * 2 > word_chars
            OR len(regexp_extract_all(t, '[!?]')) * 2 > n_words
            OR len(regexp_extract_all(t, '[^\p{{L}}\s]')) * 2 > word_chars) AS kept
FROM j""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS x,
         regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(r) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
c AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
r AS (SELECT *, cap / weight AS ratio FROM c),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l AS x WHERE x.level <= x.ratio ORDER BY x.ratio, x.rank LIMIT 1)) AS target
  FROM l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * least(3, whole + CAST(before + size / 2 <= target - whole * source_size AS INT)) ELSE 0 END AS BIGINT) AS taken
FROM f""",
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM d, range(1, greatest(len(w) - 3, 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS root, a AS node FROM g UNION SELECT reach.root, g.b FROM reach JOIN g ON g.a = reach.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(l.k, 0) AS n_links
FROM (SELECT doc_id FROM documents) AS d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT node AS doc_id, min(root) AS c FROM reach GROUP BY node) AS m USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM g GROUP BY a) AS l USING (doc_id)""",
    "op11_conversation_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, CAST(xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))),
           lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
             lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) AS BIGINT) % 9 AS h
  FROM own),
r AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM crc AS c LEFT JOIN own AS b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS n, d, list_slice(turns, 1, d) AS key FROM r, range(0, len(turns) + 1) AS g(d)),
n AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY key, d),
k AS (SELECT list_slice(key, 1, d - 1) AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.key[n.d].text) END AS saved
  FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key),
s AS (
  SELECT list_slice(v.key, 1, a) AS key, a AS d, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM v, range(0, v.d + 1) AS g(a) GROUP BY 1, 2)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.d = v.d AND s.key = v.key LEFT JOIN n AS u ON u.d = v.d - 1 AND u.key = list_slice(v.key, 1, v.d - 1)""",
    "op12_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
x AS (
  SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s
  FROM d, range(1, len(w) - 48) AS r(i) WHERE len(w) >= 50 AND doc_id IS NOT NULL),
m AS (SELECT rid, i FROM x QUALIFY doc_id > min(doc_id) OVER (PARTITION BY s)),
gone AS (SELECT rid, list(DISTINCT i + k) AS places FROM m, range(0, 50) AS g(k) GROUP BY rid),
keep AS (
  SELECT rid, doc_id, len(w) AS n, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda y, j: NOT list_contains(places, j)), ' ') END AS kept
  FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM keep""",
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.q, e.q) AS BIGINT) AS score
  FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10""",
}
