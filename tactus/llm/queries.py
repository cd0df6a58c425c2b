"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm import bpe, decontaminate, html_text, lines, neardup, pii, ppm, quality, sharding, substrings
from tactus.llm.common import table


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op3_fingerprint_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True).drop("text")


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(table(spark, sf_dir, "documents"))


def op7_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contract(table(spark, sf_dir, "documents"))


def op8_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op9_tag_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return found.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_trees": op1_quality_trees,
    "op2_wu_manber_decontamination": op2_wu_manber_decontamination,
    "op3_fingerprint_substrings": op3_fingerprint_substrings,
    "op4_trie_bpe": op4_trie_bpe,
    "op5_ppm_score": op5_ppm_score,
    "op6_bootstrapped_pii": op6_bootstrapped_pii,
    "op7_prefix_sum_shards": op7_prefix_sum_shards,
    "op8_odd_sketch_near_dedup": op8_odd_sketch_near_dedup,
    "op9_tag_ratio_text": op9_tag_ratio_text,
    "op10_fuzzy_line_dedup": op10_fuzzy_line_dedup,
}

# 0xEDB88320 is CRC-32's polynomial, reflected; its table follows from it.
OP7_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
docs AS (
  SELECT doc_id, text, 16 + coalesce(octet_length(encode(text)), 0) AS size, coalesce(md5(text), '') AS g,
    coalesce(substr(md5(doc_id::VARCHAR), 1, 3), '') AS u FROM documents),
sized AS (
  SELECT *, sum(size) OVER (ORDER BY g, u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start,
    sum(size) OVER () AS total, sum(size) OVER (PARTITION BY g) AS group_bytes,
    row_number() OVER (ORDER BY g, u, doc_id) AS r FROM docs),
grouped AS (SELECT *, min(start) OVER (PARTITION BY g) AS group_start FROM sized),
placed AS (
  SELECT *, least(39, ((CASE WHEN group_bytes * 8000 <= total THEN group_start ELSE start END) * 40) // total)::INT AS shard
  FROM grouped),
crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295::BIGINT) AS crc
  FROM docs, crc_table)
SELECT p.doc_id, p.size::BIGINT AS size, crc.crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed p JOIN crc USING (doc_id)
"""

OP2_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS s
  FROM b WHERE len(w) > 0),
x AS (
  SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: {'i': i, 's': array_to_string(w[i:i + m - 1], ' ')})) AS u
  FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT doc_id, x.m, u.i AS i, item_id FROM x JOIN p ON p.m = x.m AND p.s = u.s),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(item.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""

OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 's': md5(array_to_string(w[i:i + 49], ' '))})) AS u FROM d WHERE len(w) >= 50),
f AS (SELECT u.s AS s, min(doc_id) AS first FROM x GROUP BY u.s),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(u.i, u.i + 50)) AS pos FROM x JOIN f ON f.s = u.s WHERE doc_id > first)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (
  SELECT e.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS rest
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP8_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL: dict[str, str] = {
    "op2_wu_manber_decontamination": OP2_SQL,
    "op3_fingerprint_substrings": OP3_SQL,
    "op7_prefix_sum_shards": OP7_SQL,
    "op8_odd_sketch_near_dedup": OP8_SQL,
}
