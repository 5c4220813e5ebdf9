"""Text, chunk, evidence and ingest queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions import numbers as N
from answerlens.functions import text as X
from answerlens.operators import answer as A
from answerlens.operators import chunking, ingest
from answerlens.operators.evidence import first_rank, quote_hits
from answerlens.operators.metrics import token_stats


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("hash"))


TEXT_CLEAN = r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}]', '', 'g'), '•+', '•', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^\s*-\s*-\s*', '- ', 'g'), '[ \t]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t FROM b)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS hash FROM c"""


def exact_dup(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


EXACT_DUP = "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def sniff_kind(spark, d):
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".TXT").otherwise(".bin")).alias("name"), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text")).cast("binary").alias("content"))
    kind = X.sniff(F.col("content"), F.col("name"))
    return pages.unionByName(docs).select("name", kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


SNIFF_KIND = """
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 10 = 0 THEN 'pdf' WHEN doc_id % 3 < 2 THEN 'text' END AS kind FROM documents
  UNION ALL SELECT NULL FROM pages) GROUP BY kind"""


def token_stats_by_lang(spark, d):
    out = token_stats(table(spark, d, "documents").select("lang", X.token_count(F.col("text")).cast("long").alias("tokens")), "tokens", ["lang"])
    return out.select("lang", "n", "total", "min", "max", "p50", "p95")


TOKEN_STATS = r"""
WITH t AS (SELECT lang, CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS BIGINT) AS tokens FROM documents),
r AS (SELECT lang, tokens, row_number() OVER (PARTITION BY lang ORDER BY tokens) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM t)
SELECT lang, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS total, min(tokens) AS min, max(tokens) AS max, CAST(median(tokens) AS DOUBLE) AS p50,
       max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN tokens END) AS p95
FROM r GROUP BY lang"""


def chunk_fixed(spark, d):
    return chunking.fixed_slices(table(spark, d, "documents"), "doc_id", "text", 400).select("doc_id", "ord", F.md5("content").alias("hash"))


CHUNK_FIXED = """
SELECT doc_id, CAST(i AS INTEGER) AS ord, md5(substr(text, CAST(i * 400 + 1 AS BIGINT), 400)) AS hash
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 400.0) AS BIGINT))) AS i FROM documents)"""


def pages_of(spark, d):
    """Documents as pages of 5 lines."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("title"), F.split("text", "\n").alias("l"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 5).cast("int")), lambda i: F.array_join(F.slice("l", i * 5 + 1, 5), "\n"))
    return lines.select("document_id", "title", F.posexplode(cut).alias("at", "text")).select("document_id", "title", (F.col("at") + 1).alias("page"), "text")


def chunk_split(spark, d):
    return chunking.split_chunks(pages_of(spark, d), 200, 30).select("document_id", "ord", "page_start", "page_end", "token_count", F.md5("content").alias("hash"))


def policy_chunk(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page"), F.col("lang").alias("chapter"), F.col("source").alias("ministry"), F.col("doc_id").cast("string").alias("title"), "text")
    out = chunking.policy_chunks(pages, 100_000)
    return out.select("document_id", "ord", "page_start", "heading", F.md5("embed_text").alias("hash"), "token_count")


POLICY_CHUNK = r"""
SELECT source AS document_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS ord, CAST(doc_id AS INTEGER) AS page_start,
       lang || ' > ' || source || ' > ' || doc_id AS heading, md5(doc_id || ' (' || source || ', ' || lang || ')' || chr(10) || text) AS hash,
       CAST(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')) AS INTEGER) AS token_count
FROM documents"""

#: Sentences of conversations, for SQL; RE2 has no look-behind, so a mark is put at each end first.
SENTENCES = r"""
WITH lines AS (
  SELECT conv_id, turn, unnest(string_split(replace(regexp_replace(text, '\s*\[\d+\]', '', 'g'), '**', ''), chr(10))) AS line FROM conversations),
marked AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(line, '^\s*(?:[-*•]|\d+\.)\s*', '')), '([.?!])\s+', '\1' || chr(1), 'g') AS line FROM lines),
parts AS (SELECT conv_id, turn, trim(unnest(string_split(line, chr(1)))) AS s FROM marked)"""


def split_sentences(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.min("s").alias("least"), F.max("s").alias("most"))


SPLIT_SENTENCES = SENTENCES + """
SELECT conv_id, turn, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, min(s) AS least, max(s) AS most
FROM parts WHERE length(s) >= 6 GROUP BY conv_id, turn"""


def sentence_numbers(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.sort_array(N.numbers(F.col("text"))).alias("found"))
    return found.filter("size(found) > 0").select("doc_id", F.size("found").alias("n"), F.array_join("found", ",").alias("numbers"))


#: Without look-around: a comma between thousands is marked from both sides by taking digits along.
NUMBERS = r"""list_sort(list_distinct(regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace({0}, '(\d{{4}})\.(\d{{1,2}})\.(?:(\d{{1,2}})\.?)?', '\1 \2 \3 ', 'g'), '(\d),(\d{{3}})', '\1\2', 'g'), '(\d),(\d{{3}})', '\1\2', 'g'), '\d+(?:\.\d+)?')))"""
SENTENCE_NUMBERS = f"""
SELECT doc_id, CAST(len(f) AS INTEGER) AS n, array_to_string(f, ',') AS numbers FROM (SELECT doc_id, {NUMBERS.format('text')} AS f FROM documents) WHERE len(f) > 0"""


def value_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", N.value_count(F.col("text")).alias("n")).filter("n > 0")


VALUE_COUNTS = rf"""
WITH u AS (SELECT doc_id, text, '\d{{4}}\.\d{{1,2}}\.(?:\d{{1,2}}\.?)?|\d{{4}}년\s*\d{{1,2}}월(?:\s*\d{{1,2}}일)?|\d+(?:\.\d+)?\s*~\s*\d+(?:\.\d+)?' AS p FROM documents),
v AS (SELECT doc_id, len(list_distinct(regexp_extract_all(text, p))) + len({NUMBERS.format("regexp_replace(text, p, ' ', 'g')")}) AS n FROM u)
SELECT doc_id, CAST(n AS INTEGER) AS n FROM v WHERE n > 0"""


def turn_pairs(spark, d):
    """User turns with the assistant turn behind them."""
    c = table(spark, d, "conversations")
    users = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return users.join(said, ["conv_id", "turn"])


PAIRS = """
WITH pairs AS (
  SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def number_diff(spark, d):
    docs = table(spark, d, "documents")
    pair = docs.select("doc_id", "text").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    checked = pair.select("doc_id", N.fact_check(F.col("text"), F.array("next")).alias("c"))
    return checked.filter("size(c.lost) > 0 OR size(c.added) > 0").select("doc_id", F.array_join("c.lost", ",").alias("lost"), F.array_join("c.added", ",").alias("added"), F.size("c.crowded").alias("crowded"))


NUMBER_DIFF = VALUE_COUNTS.replace("SELECT doc_id, CAST(n AS INTEGER) AS n FROM v WHERE n > 0", f"""
, f AS (SELECT doc_id, {NUMBERS.format('text')} AS f FROM documents),
p AS (SELECT a.doc_id, a.f AS x, b.f AS y, b.doc_id AS next FROM f a JOIN f b ON b.doc_id = a.doc_id + 1),
w AS (SELECT doc_id, next, list_sort(list_filter(x, lambda i: NOT list_contains(y, i))) AS lost, list_sort(list_filter(y, lambda i: NOT list_contains(x, i))) AS added FROM p)
SELECT w.doc_id, array_to_string(lost, ',') AS lost, array_to_string(added, ',') AS added, CAST(v.n >= 3 AS INTEGER) AS crowded
FROM w JOIN v ON v.doc_id = next WHERE len(lost) > 0 OR len(added) > 0""")


def bigram_overlap(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.bround(X.bigram_overlap(F.col("q"), F.col("a")), 6).alias("overlap"))


BIGRAM_OVERLAP = PAIRS + r""",
c AS (SELECT conv_id, turn, regexp_replace(q, '[^\p{L}\p{N}_]', '', 'g') AS q, regexp_replace(a, '[^\p{L}\p{N}_]', '', 'g') AS a FROM pairs),
g AS (SELECT conv_id, turn, a, list_distinct(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) AS g FROM c)
SELECT conv_id, turn, CASE WHEN len(g) > 0 THEN round_even(len(list_filter(g, lambda x: contains(a, x))) / len(g), 6) ELSE 0.0 END AS overlap FROM g"""


def word_overlap(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.bround(X.word_overlap(F.col("q"), F.col("a")), 6).alias("overlap"))


WORD_OVERLAP = PAIRS + r""",
g AS (SELECT conv_id, turn, a, list_filter(regexp_extract_all(q, '[\p{L}\p{N}_·]+'), lambda x: length(x) >= 2) AS g FROM pairs)
SELECT conv_id, turn, CASE WHEN len(g) > 0 THEN round_even(len(list_filter(g, lambda x: contains(a, x))) / len(g), 6) ELSE 0.0 END AS overlap FROM g"""


def perturb_numbers(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("%", "세", "일", "x"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    answers = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), unit).alias("answer"))
    return answers.withColumn("p", N.perturb(F.col("answer"), F.lit(""))).select("l_orderkey", "l_linenumber", "answer", F.col("p.wrong").alias("wrong"), F.col("p.token").alias("token"))


PERTURB_NUMBERS = """
WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS v, ['%', '세', '일', 'x'][l_linenumber % 4 + 1] AS u FROM lineitem),
b AS (SELECT *, CASE u WHEN '%' THEN v * 2 WHEN '세' THEN v + 5 WHEN '일' THEN CASE WHEN v + 7 <= 28 THEN v + 7 WHEN v - 7 BETWEEN 1 AND 28 THEN v - 7 END
  ELSE CASE WHEN v < 10 THEN v + 1 ELSE v * 2 END END AS w FROM a)
SELECT l_orderkey, l_linenumber, 'about ' || v || u AS answer, 'about ' || w || u AS wrong, w || u AS token FROM b"""

HIT = "array(named_struct('ref', 1, 'title', 'A', 'document_id', 'a', 'content', text, 'page_start', 1, 'page_end', 1, 'printed_page', cast(null as int), 'heading', 'H', 'score', 0.5D), named_struct('ref', 2, 'title', 'B', 'document_id', 'b', 'content', role, 'page_start', 2, 'page_end', 3, 'printed_page', 9, 'heading', '', 'score', 0.25D))"


def citations(spark, d):
    c = table(spark, d, "conversations").withColumn("hits", F.expr(HIT))
    marked = F.concat("text", F.lit(" ["), (F.col("conv_id") % 4).cast("string"), F.lit("] and ["), (F.col("turn") % 3 + 1).cast("string"), F.lit("]"))
    return c.select("conv_id", "turn", A.check_citations(marked, F.col("hits")).alias("c")).select("conv_id", "turn", F.md5("c.answer").alias("answer"), F.array_join(F.col("c.refs").cast("array<string>"), ",").alias("refs"), F.array_join(F.col("c.invalid").cast("array<string>"), ",").alias("invalid"), F.size("c.warnings").alias("warnings"))


CITATIONS = """
WITH a AS (SELECT conv_id, turn, text, conv_id % 4 AS x, turn % 3 + 1 AS y FROM conversations),
b AS (SELECT *, x BETWEEN 1 AND 2 AS vx, y BETWEEN 1 AND 2 AS vy FROM a)
SELECT conv_id, turn, md5(trim(text || CASE WHEN vx THEN ' [' || x || '] and ' ELSE '  and ' END || CASE WHEN vy THEN '[' || y || ']' ELSE '' END)) AS answer,
       CASE WHEN vx AND vy AND x <> y THEN x || ',' || y WHEN vx THEN '' || x WHEN vy THEN '' || y ELSE '' END AS refs,
       CASE WHEN NOT vx AND NOT vy AND x <> y THEN least(x, y) || ',' || greatest(x, y) WHEN NOT vx THEN '' || x WHEN NOT vy THEN '' || y ELSE '' END AS invalid,
       CAST(NOT (vx AND vy) AS INTEGER) + CAST(NOT (vx OR vy) AS INTEGER) AS warnings
FROM b"""


def deltas_of(spark, d):
    """Assistant texts in parts of 20 characters; every fifth turn is the no-answer mark in two parts."""
    c = table(spark, d, "conversations").filter("role = 'assistant'").withColumn("request_id", F.concat_ws("-", "conv_id", "turn"))
    text = F.when(F.col("conv_id") % 5 == 0, X.NO_ANSWER).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("[1] "), "text")).otherwise(F.col("text"))
    width = F.when(F.col("conv_id") % 5 < 2, 2).otherwise(20)
    cut = c.select("request_id", text.alias("t"), width.alias("w")).withColumn("n", F.ceil(F.length("t") / F.col("w")).cast("int"))
    return cut.select("request_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("t").substr(i * F.col("w") + 1, F.col("w")))).alias("seq", "text"))


def sentinel_stream(spark, d):
    deltas = deltas_of(spark, d)
    shown = A.shown_deltas(deltas).groupBy("request_id").agg(F.count("shown").alias("deltas"), F.min(F.when(F.col("shown").isNotNull(), F.struct("seq", "shown"))).alias("first"))
    return shown.join(A.final_status(deltas), "request_id").select("request_id", "deltas", F.col("first.shown").alias("first"), "status")


SENTINEL_STREAM = """
WITH t AS (SELECT concat_ws('-', conv_id, turn) AS request_id, conv_id % 5 AS m,
             CASE conv_id % 5 WHEN 0 THEN '[[NO_ANSWER]]' WHEN 1 THEN '[1] ' || text ELSE text END AS t, CASE WHEN conv_id % 5 < 2 THEN 2 ELSE 20 END AS w
           FROM conversations WHERE role = 'assistant')
SELECT request_id, CAST(CASE WHEN m = 0 THEN 0 ELSE ceil(length(t) / w) END AS BIGINT) AS deltas,
       CASE WHEN m > 0 THEN substr(t, 1, w) END AS first, CASE WHEN contains(t, '[[NO_ANSWER]]') THEN 'insufficient_context' ELSE 'answered' END AS status
FROM t"""


def build_prompt(spark, d):
    c = table(spark, d, "conversations").withColumn("hits", F.expr(HIT))
    return c.select("conv_id", "turn", A.messages(F.col("text"), F.col("hits")).alias("m")).select("conv_id", "turn", F.md5("m.user").alias("user"))


BUILD_PROMPT = """
SELECT conv_id, turn, md5('[Sources]' || chr(10) || '[1] A p.1 (H)' || chr(10) || text || chr(10) || chr(10) || '[2] B p.9' || chr(10) || role || chr(10) || chr(10) || '[Question]' || chr(10) || text) AS user
FROM conversations"""


def evidence_quote(spark, d):
    return quote_hits(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


EVIDENCE_QUOTE = r"""
SELECT doc_id, item_id FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents)
JOIN (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS q FROM benchmark) ON contains(t, q) WHERE q <> ''"""


def evidence_page(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    hits = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4).cast("int")), lambda j: F.struct(F.col("doc_id").cast("string").alias("document_id"), (j * 4 + 1).alias("page_start"), (j * 4 + 4).alias("page_end"), F.lit("").alias("content")))
    evidence = F.array(F.struct(F.col("doc_id").cast("string").alias("document_id"), (1 + F.col("doc_id") % F.col("n")).cast("int").alias("page"), F.lit(None).cast("string").alias("quote")))
    return lines.select("doc_id", first_rank(hits, evidence).alias("rank"))


EVIDENCE_PAGE = """
SELECT doc_id, CAST((doc_id % n) // 4 + 1 AS INTEGER) AS rank FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)"""


def find_page(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l")).filter("size(l) >= 3")
    pages = F.transform("l", lambda x, i: F.struct((i + 1).alias("page"), x.alias("text")))
    return docs.select("doc_id", X.find_page(pages, F.col("l")[2].substr(1, 12)).alias("page"))


FIND_PAGE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS page, substr(l[3], 1, 12) AS q FROM l WHERE len(l) >= 3)
SELECT doc_id, CAST(min(page) AS INTEGER) AS page FROM p WHERE contains(regexp_replace(t, '\s+', '', 'g'), regexp_replace(q, '\s+', '', 'g')) GROUP BY doc_id"""


def ingest_tables(spark, d):
    """Files now, and a catalog from before: some documents unknown, some changed, some without chunks of this version."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", F.when(F.col("lang") != "es", "text").alias("kind"), F.sha2("text", 256).alias("content_hash"))
    known = docs.filter("doc_id % 5 <> 0").select(F.col("document_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), "doc_id")
    chunks = known.select(F.col("id").alias("document_id"), F.explode(F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("v0"))).otherwise(F.array(F.lit("v0"), F.lit("v1")))).alias("index_version"))
    return docs, known.drop("doc_id"), chunks


def ingest_plan(spark, d):
    docs, known, chunks = ingest_tables(spark, d)
    return ingest.plan(docs, known, chunks, "v1").select("document_id", "status")


INGEST_PLAN = """
SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN lang = 'es' THEN 'unsupported' WHEN doc_id % 5 = 0 THEN 'ingested' WHEN doc_id % 7 = 0 THEN 'replaced'
  WHEN doc_id % 11 = 0 THEN 'ingested' ELSE 'skipped' END AS status FROM documents"""


def upsert_documents(spark, d):
    docs, known, _ = ingest_tables(spark, d)
    return ingest.upserted(known, docs.filter("kind IS NOT NULL AND doc_id % 2 = 0").select(F.col("document_id").alias("id"), "content_hash"))


UPSERT_DOCUMENTS = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN NOT (lang <> 'es' AND doc_id % 2 = 0) AND doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS content_hash
FROM documents WHERE doc_id % 5 <> 0 OR (lang <> 'es' AND doc_id % 2 = 0)"""


def merge_chunks(spark, d):
    docs, known, chunks = ingest_tables(spark, d)
    planned = ingest.plan(docs, known, chunks, "v1")
    new = planned.filter(F.col("status").isin("ingested", "replaced")).select("document_id", F.lit("v1").alias("index_version"))
    return ingest.merged_chunks(chunks, planned, new, "v1")


MERGE_CHUNKS = """
WITH s AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'unsupported' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'replaced' WHEN doc_id % 11 = 0 THEN 'version' ELSE 'skipped' END AS s FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, v AS index_version FROM s, (VALUES ('v0'), ('v1')) t(v)
WHERE (v = 'v1' AND s IN ('new', 'replaced', 'version')) OR (doc_id % 5 <> 0 AND (v = 'v0' OR doc_id % 11 <> 0) AND s NOT IN ('new', 'replaced') AND NOT (s = 'version' AND v = 'v1'))"""


def variants_pair(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.filter("turn % 4 < 2").select("conv_id", "turn", F.col("text").alias("literal")).join(c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("user")), ["conv_id", "turn"]).select("conv_id", "turn", F.length("literal").alias("literal"), F.length("user").alias("user"))


VARIANTS_PAIR = """
SELECT a.conv_id, a.turn, CAST(length(a.text) AS INTEGER) AS literal, CAST(length(b.text) AS INTEGER) AS "user" FROM conversations a
JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2 AND b.role = 'user' WHERE a.role = 'user' AND a.turn % 4 < 2"""


def windowed_metrics(spark, d):
    from answerlens.streaming.answers import windowed

    out = windowed(table(spark, d, "events"), "ts", "value", ["event_type"], "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.bround("total", 4).alias("total"))


WINDOWED = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def session_metrics(spark, d):
    from answerlens.streaming.answers import sessions

    return sessions(table(spark, d, "events").select("ts", "user_id"), "ts", ["user_id"], "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("most"))


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(*) AS sessions, max(n) AS most FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY user_id, s) GROUP BY user_id"""

QUERIES = {
    "text_clean": text_clean, "exact_dup": exact_dup, "sniff_kind": sniff_kind, "token_stats": token_stats_by_lang, "chunk_fixed": chunk_fixed, "chunk_split": chunk_split,
    "policy_chunk": policy_chunk, "split_sentences": split_sentences, "sentence_numbers": sentence_numbers, "value_count": value_counts, "number_diff": number_diff,
    "bigram_overlap": bigram_overlap, "word_overlap": word_overlap, "perturb_numbers": perturb_numbers, "citations": citations, "sentinel_stream": sentinel_stream,
    "build_prompt": build_prompt, "evidence_quote": evidence_quote, "evidence_page": evidence_page, "find_page": find_page, "ingest_plan": ingest_plan,
    "upsert_documents": upsert_documents, "merge_chunks": merge_chunks, "variants_pair": variants_pair, "windowed_metrics": windowed_metrics, "session_metrics": session_metrics,
}
ORACLES = {
    "text_clean": TEXT_CLEAN, "exact_dup": EXACT_DUP, "sniff_kind": SNIFF_KIND, "token_stats": TOKEN_STATS, "chunk_fixed": CHUNK_FIXED, "policy_chunk": POLICY_CHUNK,
    "split_sentences": SPLIT_SENTENCES, "sentence_numbers": SENTENCE_NUMBERS, "value_count": VALUE_COUNTS, "number_diff": NUMBER_DIFF, "bigram_overlap": BIGRAM_OVERLAP,
    "word_overlap": WORD_OVERLAP, "perturb_numbers": PERTURB_NUMBERS, "citations": CITATIONS, "sentinel_stream": SENTINEL_STREAM, "build_prompt": BUILD_PROMPT,
    "evidence_quote": EVIDENCE_QUOTE, "evidence_page": EVIDENCE_PAGE, "find_page": FIND_PAGE, "ingest_plan": INGEST_PLAN, "upsert_documents": UPSERT_DOCUMENTS,
    "merge_chunks": MERGE_CHUNKS, "variants_pair": VARIANTS_PAIR, "windowed_metrics": WINDOWED, "session_metrics": SESSIONS,
}
