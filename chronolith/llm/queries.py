"""The queries of the training-data operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language_id, mil_classifier, minhash, mixing, packing, pq_dedup, quality_rules, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ctl = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ctl).alias("text"))
    return chat_format.read_back(chat_format.formatted(conv.unionByName(more)))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_mil_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mil_classifier.classify(docs, mil_classifier.train(docs, table(spark, sf_dir, "labels")))


def op5_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.duplicates(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans_and_passages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_chat_format, op3_mixing, op4_mil_classifier, op5_pq_dedup, op6_suffix_dedup, op7_packing, op8_language_id, op9_warc, op10_minhash)}

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, w, CASE WHEN lead(w, 7) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o] END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, w, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM g),
k AS (SELECT r, w, coalesce(bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS rep FROM c),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE rep) AS n_repeat_words FROM k GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 6 * n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (10 * n_upper > 6 * word_chars)::BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

ORACLES["op2_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, (strlen(text) + 3) // 4 + 4 AS tok FROM c),
y AS (SELECT *, greatest(256, coalesce(sum(tok) FILTER (role = 'system') OVER (PARTITION BY conv_id), 0))::BIGINT AS sys FROM t),
z AS (SELECT *, greatest(256, floor((2048 - sys - 256) / 2))::BIGINT AS stride FROM y),
b AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // stride AS block FROM z),
k AS (SELECT *, (pos = 0 OR block <> lag(block) OVER o OR tok > stride OR lag(tok) OVER o > stride)::INT AS cut FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
w AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS win FROM k),
x AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id, win ORDER BY pos DESC) AS tail, max(win) OVER (PARTITION BY conv_id) AS last, sum(tok) OVER (PARTITION BY conv_id, win) AS fresh FROM w),
v AS (SELECT *, CASE WHEN lead(win) OVER o <> win THEN 2048 - sys - lead(fresh) OVER o END AS room FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
n AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 23 AS chars,
  1 + CASE WHEN role = 'system' THEN last - win WHEN win < last AND (tail <= 256 OR coalesce(tok <= room, false)) THEN 1 ELSE 0 END AS shown FROM v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars * shown)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

ORACLES["op3_mixing"] = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR), 1, 9))::BIGINT AS h FROM s),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
o AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap, (SELECT sum(size) FROM s)::BIGINT AS total FROM g),
l AS (SELECT *, cap <= (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE (1.5::DOUBLE * total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) / sum(w) FILTER (WHERE NOT capped) OVER () * w END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
u AS (SELECT source, h, sum(size) AS u FROM h GROUP BY source, h),
c AS (SELECT *, sum(u) OVER (PARTITION BY source ORDER BY h) AS cum FROM u),
e AS (SELECT c.source, c.h, cum <= target - copies * source_size OR (cum - u <= target - copies * source_size AND 2 * (target - copies * source_size - (cum - u)) >= u) AS more FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (copies + more::INT))::BIGINT AS taken
FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source JOIN e ON h.source IS NOT DISTINCT FROM e.source AND h.h = e.h
"""

ORACLES["op10_minhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
g AS (SELECT unnest(s) AS g, doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.node
"""

ORACLES["op9_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first, sha1(b) AS hex FROM p),
n AS (SELECT *, [strpos('0123456789abcdef', x) - 1 FOR x IN string_split(hex, '')] AS q FROM m),
t AS (SELECT *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[(5 * i) // 4 + 1] * 256 + coalesce(q[(5 * i) // 4 + 2], 0) * 16 + coalesce(q[(5 * i) // 4 + 3], 0)) // CASE i % 4 WHEN 0 THEN 128 WHEN 1 THEN 64 WHEN 2 THEN 32 ELSE 16 END) % 32 + 1, 1) FOR i IN range(0, 32)] AS z FROM n)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, array_to_string(z, '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM t
"""

ORACLES["op5_pq_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, len(e) AS d, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.d = b.d AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
c AS (SELECT u, count(*) AS n_links FROM p GROUP BY u),
r AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, p.v FROM r JOIN p ON r.seen = p.u),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON v.vec_id = m.node LEFT JOIN c ON v.vec_id = c.u
"""
