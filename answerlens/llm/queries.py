"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.substring_dedup import substring_digest

    return substring_digest(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
k AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM k JOIN m USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n
  FROM words ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.decontaminate import decontamination_digest

    return decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, NULL AS item_id, text, false AS item FROM documents
  UNION ALL SELECT NULL, item_id, text, true FROM benchmark),
w AS (
  SELECT doc_id, item_id, item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM t),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
        FROM w WHERE item AND len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE NOT item AND len(ws) >= n)),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN grams USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) WHERE NOT item
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.simhash import simhash_digest

    return simhash_digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.quality_rules import quality_rules, train

    documents = table(spark, sf_dir, "documents")
    return quality_rules(documents, train(documents, table(spark, sf_dir, "labels")), keep=("doc_id",))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.quality_classifier import classifier_digest

    return classifier_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from answerlens.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) AS ws
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
s AS (SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS i FROM l),
k AS (
  SELECT doc_id, ls, i, j, array_to_string(ls[i:j], chr(10)) AS k
  FROM (SELECT *, CASE WHEN ws[i] >= 13 THEN i WHEN list_sum(ws[i:i + 1]) >= 13 THEN i + 1 WHEN list_sum(ws[i:i + 2]) >= 13 THEN i + 2 ELSE i + 3 END AS j FROM s)
  WHERE j <= len(ls)),
m AS (SELECT k, min({'d': doc_id, 'i': i}) AS place FROM k GROUP BY k),
met AS (
  SELECT k.doc_id, k.ls AS x, k.i AS a, k.j AS b, l.ls AS y, place.i AS c, place.i + k.j - k.i AS d
  FROM k JOIN m USING (k) JOIN l ON l.doc_id = place.d
  WHERE place.d < k.doc_id OR place.d = k.doc_id AND place.i < k.i),
wide AS (
  SELECT doc_id, a, b,
         CASE WHEN p1 AND p2 AND p3 THEN 3 WHEN p1 AND p2 THEN 2 WHEN p1 THEN 1 ELSE 0 END AS back,
         CASE WHEN n1 AND n2 AND n3 THEN 3 WHEN n1 AND n2 THEN 2 WHEN n1 THEN 1 ELSE 0 END AS onward
  FROM (SELECT *, a > 1 AND c > 1 AND x[a - 1] = y[c - 1] AS p1, a > 2 AND c > 2 AND x[a - 2] = y[c - 2] AS p2, a > 3 AND c > 3 AND x[a - 3] = y[c - 3] AS p3,
               x[b + 1] = y[d + 1] AS n1, x[b + 2] = y[d + 2] AS n2, x[b + 3] = y[d + 3] AS n3 FROM met)),
hit AS (SELECT DISTINCT doc_id, unnest(range(a - back, b + onward + 1)) AS j FROM wide),
lines AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS j FROM l),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY j) AS t, count(*) AS n FROM lines ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_removed_lines,
       sha256(CASE WHEN ls IS NOT NULL THEN coalesce(t, '') END) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)
"""

def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.html_extract import extract_html

    return extract_html(table(spark, sf_dir, "pages"), keep=("page_id", "url"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"), keep=("doc_id",))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "row_bytes", "shard", "shard_depth", "shard_bytes", "shard_rows")


OP10_SQL = """
WITH k AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS row_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT d, h >> (60 - d) AS p, sum(row_bytes) AS bytes, count(*) AS n
  FROM k, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS d) GROUP BY ALL),
best AS (
  SELECT h, min(d) AS d FROM (SELECT DISTINCT h FROM k) JOIN s ON h >> (60 - d) = p WHERE bytes <= 1048576 GROUP BY h)
SELECT k.doc_id, row_bytes, lpad(bin(p), d, '0') AS shard, d AS shard_depth, CAST(bytes AS BIGINT) AS shard_bytes, n AS shard_rows
FROM k JOIN (SELECT h, coalesce(d, 60) AS bd FROM (SELECT DISTINCT h FROM k) LEFT JOIN best USING (h)) USING (h)
JOIN s ON s.d = bd AND s.p = k.h >> (60 - bd)
"""

def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerlens.llm.sentencepieces import token_digest

    return token_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
}
#: None of op2 and op5 (trained models) and op9 (XXH64 isn't in DuckDB): see tests/llm.
ORACLES = {"op3_substring_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_decontaminate": OP8_SQL, "op10_sharding": OP10_SQL}
