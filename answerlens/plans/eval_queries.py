"""Retrieval, scoring, metric, calibration and gold-set queries over the driver's tables, each with its DuckDB SQL.

The tables hold no judge results, so records, items and checks are derived from event numbers by the same arithmetic in
Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions.metrics import index_percentile
from answerlens.functions.text import tokens_cost
from answerlens.operators import calibrate as K
from answerlens.operators import checks as C
from answerlens.operators import goldgen as G
from answerlens.operators import goldset as S
from answerlens.operators import metrics as M
from answerlens.operators.compare import changes, rescore
from answerlens.operators.evidence import curve, missing, reciprocal_rank
from answerlens.operators.scoring import score
from answerlens.operators.vectors import gate, nearest
from answerlens.plans.text_queries import SENTENCES, table
from answerlens.settings import Settings
from answerlens.sources.files import label_sheet

KS = [1, 3, 5, 10, 20, 50]


def ranked(spark, d, k):
    e = table(spark, d, "embeddings")
    return nearest(e.filter("vec_id % 20 = 0"), e.withColumnRenamed("vec_id", "chunk_id"), k, "vec_id", exclude_self=True)


RANKED = """
WITH s AS (
  SELECT q.vec_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, chunk_id) AS INTEGER) AS ref FROM s)"""


def knn_topk(spark, d):
    return ranked(spark, d, 10)


KNN = RANKED + " SELECT vec_id, ref, chunk_id, score FROM r WHERE ref <= 10"


def knn_gate(spark, d):
    e = table(spark, d, "embeddings").filter("vec_id % 20 = 0")
    return gate(e, ranked(spark, d, 1), 0.5, "vec_id")


KNN_GATE = RANKED + " SELECT vec_id, score AS top_score, CASE WHEN score < 0.5 THEN 'insufficient_context' ELSE 'open' END AS status FROM r WHERE ref = 1"


def label_ranks(spark, d, k):
    """(id, group, unit, rank): the first neighbour of the same label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    hits = ranked(spark, d, k).join(e, "vec_id").join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("found")), "chunk_id")
    first = hits.filter("label = found").groupBy("vec_id").agg(F.min("ref").alias("rank"))
    return e.filter("vec_id % 20 = 0").join(first, "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("group"), F.lit(0).alias("unit"), "rank")


FIRST = RANKED + """,
f AS (SELECT vec_id AS id, CAST(min(ql) AS VARCHAR) AS grp, min(CASE WHEN ql = cl AND ref <= 50 THEN ref END) AS rank FROM r GROUP BY vec_id)"""


def retrieval_curve(spark, d):
    return curve(label_ranks(spark, d, max(KS)), KS)


CURVE = FIRST + """,
k AS (SELECT grp, id, rank, unnest([1, 3, 5, 10, 20, 50]) AS k FROM f),
g AS (SELECT grp, k, rank FROM k UNION ALL SELECT 'total', k, rank FROM k)
SELECT grp AS "group", CAST(k AS INTEGER) AS k, count(*) AS items, count(*) AS units, round_even(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 4) AS hit,
       round_even(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 4) AS recall FROM g GROUP BY grp, k"""


def retrieval_mrr(spark, d):
    return reciprocal_rank(label_ranks(spark, d, 50), 5)


MRR = FIRST + """
SELECT grp AS "group", count(*) AS n, round_even(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS hit, round_even(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0.0 END), 4) AS mrr
FROM f GROUP BY grp"""


def missing_units(spark, d):
    return missing(label_ranks(spark, d, 1))


MISSING = RANKED + " SELECT vec_id AS id, CAST(0 AS INTEGER) AS unit FROM r WHERE ref = 1 AND ql <> cl"


def doc_title_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "lang", "source").alias("title"), "n_chars")
    return ranked(spark, d, 5).join(docs, "chunk_id").select("vec_id", "ref", "chunk_id", "title", "n_chars")


TITLES = RANKED + " SELECT vec_id, ref, chunk_id, lang || '/' || source AS title, n_chars FROM r JOIN documents ON doc_id = chunk_id WHERE ref <= 5"


def derived(spark, d):
    """(items, records, checks), one of each item for every event."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("quant", "qual", "unanswerable", "false_premise"))), (e % 4 + 1).cast("int"))
    events = table(spark, d, "events").select("event_id", kind.alias("type"), F.concat(F.lit("i"), e.cast("string")).alias("id"))
    evidence = F.array(F.struct(F.lit("d").alias("document_id"), (e % 3).cast("int").alias("page"), F.lit(None).cast("string").alias("quote")))
    positive = F.col("type").isin("quant", "qual")
    items = events.select(
        "id", "type", F.when(F.col("type") == "quant", evidence).alias("evidence"),
        F.when(F.col("type") == "qual", F.array(F.struct(F.lit("p").alias("point"), F.array(*map(F.lit, "abc")).alias("facts"), evidence.alias("evidence")))).alias("must_include"),
        F.when(~positive, F.when(F.col("type") == "unanswerable", "insufficient_context").otherwise("answered")).alias("expected_status"),
        F.when(F.col("type") == "unanswerable", F.create_map(F.lit("2"), F.lit("x"), F.lit("0"), F.lit("y"))).when(F.col("type") == "false_premise", F.create_map(*[F.lit(x) for x in ("2", "x", "1", "y", "0", "z")])).alias("scoring"),
    )
    status = F.when(e % 11 == 0, "error").when(e % 7 == 0, "insufficient_context").otherwise("answered")
    hit = F.array(F.struct(F.lit(1).alias("ref"), F.lit("d").alias("document_id"), F.lit("t").alias("content"), (e % 5).cast("int").alias("page_start"), (e % 5).cast("int").alias("page_end")))
    cite = F.struct(F.lit(1).alias("ref"))
    records = events.select(
        "id", "type", F.when(positive, F.col("type")).otherwise("negative").alias("group"), (e % 3).cast("int").alias("repeat"), status.alias("status"), hit.alias("retrieved"),
        F.filter(F.array(F.when(e % 2 == 0, cite)), lambda c: c.isNotNull()).alias("citations"),
        F.struct((e % 1000 + 1).alias("prompt_tokens"), (e % 100 + 1).alias("completion_tokens")).alias("usage"), (e % 977).alias("latency_ms"), (e % 50).alias("judge_tokens"),
    )
    check = lambda name, k, p=None, choice=None: F.struct(F.lit(name).alias("check_id"), F.lit(k).alias("kind"), (p if p is not None else F.lit(None).cast("double")).alias("p"), (choice if choice is not None else F.lit(None).cast("string")).alias("choice"))
    base = [check("s0", "support", e * 37 % 100 / 100)]
    of = {
        "quant": [check("value", "value", e * 53 % 100 / 100)],
        "qual": [*[check(f"f0_{i}", "fact", e * (17 + 2 * i) % 10 / 10) for i in range(3)], check("m0", "must_not", e * 13 % 100 / 100)],
        "negative": [check("grade", "grade", None, (e % 3).cast("string"))],
    }
    asked = F.when(F.col("type") == "quant", F.array(*base, *of["quant"])).when(F.col("type") == "qual", F.array(*base, *of["qual"])).otherwise(F.array(*base, *of["negative"]))
    checks = events.filter(status == "answered").select("id", (e % 3).cast("int").alias("repeat"), F.explode(asked).alias("c")).select("id", "repeat", "c.*")
    return items, records, checks


def scored_sql(tau_support="0.5", tau_value="0.5", full="0.75"):
    return f"""
WITH e AS (
  SELECT event_id AS e, ['quant', 'qual', 'unanswerable', 'false_premise'][event_id % 4 + 1] AS type,
         CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'insufficient_context' ELSE 'answered' END AS status FROM events),
x AS (
  SELECT *, 'i' || e AS id, CASE WHEN e % 4 < 2 THEN type ELSE 'negative' END AS grp, e % 3 AS repeat, e % 5 = e % 3 AS hit, status = 'answered' AND e * 37 % 100 / 100 < {tau_support} AS bad,
         CASE WHEN status = 'answered' THEN e * 53 % 100 / 100 >= {tau_value} ELSE NULL END AS value_ok,
         CAST(e * 17 % 10 / 10 >= 0.8 AS INTEGER) + CAST(e * 19 % 10 / 10 >= 0.8 AS INTEGER) + CAST(e * 21 % 10 / 10 >= 0.8 AS INTEGER) AS facts, e * 13 % 100 / 100 >= 0.7 AS wrong FROM e),
s AS (
  SELECT *, CASE
    WHEN status = 'error' THEN 'E' WHEN e % 4 < 2 AND status <> 'answered' THEN 'F'
    WHEN type = 'quant' AND (NOT value_ok OR bad) THEN 'H' WHEN type = 'quant' AND hit AND e % 2 = 0 THEN '2' WHEN type = 'quant' THEN 'C'
    WHEN type = 'qual' AND (wrong OR bad) THEN 'H' WHEN type = 'qual' AND facts / 3 >= {full} THEN '2' WHEN type = 'qual' AND NOT hit AND facts < 3 THEN 'R' WHEN type = 'qual' THEN 'G'
    WHEN status <> 'answered' AND type = 'false_premise' THEN 'F' WHEN status <> 'answered' THEN '2'
    WHEN e % 3 = 0 OR bad THEN 'H' WHEN e % 3 = 1 THEN 'F' ELSE '2' END AS code FROM x),
scored AS (
  SELECT *, CAST(CASE code WHEN 'E' THEN NULL WHEN 'H' THEN 0 WHEN '2' THEN 2 ELSE 1 END AS INTEGER) AS score,
         CASE code WHEN 'E' THEN 'execution_error' WHEN 'F' THEN 'false_refusal' WHEN 'H' THEN 'hallucination' WHEN 'C' THEN 'citation_error' WHEN 'R' THEN 'retrieval_failure' WHEN 'G' THEN 'generation_omission' END AS cause FROM s)"""


HEAD = """count(score) AS n, count(*) - count(score) AS errors, round_even(avg(CASE WHEN score >= 1 THEN 1.0 WHEN score = 0 THEN 0.0 END), 4) AS safety, round_even(avg(score) / 2, 4) AS usefulness,
  count(*) FILTER (score = 0) AS score_0, count(*) FILTER (score = 1) AS score_1, count(*) FILTER (score = 2) AS score_2"""
HEADLINE_SQL = f"""
g AS (SELECT grp, repeat, score FROM scored UNION ALL SELECT 'total', repeat, score FROM scored),
p AS (SELECT grp, min(safety) AS safety_min, max(safety) AS safety_max, min(usefulness) AS usefulness_min, max(usefulness) AS usefulness_max FROM (SELECT grp, repeat, {HEAD} FROM g GROUP BY grp, repeat) GROUP BY grp),
h AS (SELECT grp, {HEAD} FROM g GROUP BY grp)"""


def score_rules(spark, d):
    return score(*derived(spark, d)).select("id", "repeat", "score", "cause", "refusal_reason", "first_hit_rank")


SCORE_RULES = scored_sql() + """
SELECT id, CAST(repeat AS INTEGER) AS repeat, score, cause, CASE WHEN code = 'F' AND status <> 'answered' THEN CASE WHEN e % 4 < 2 AND NOT hit THEN 'retrieval' ELSE 'generation' END END AS refusal_reason,
       CAST(CASE WHEN e % 4 < 2 AND hit AND status <> 'error' THEN 1 END AS INTEGER) AS first_hit_rank FROM scored"""


def headline_groups(spark, d):
    return M.headline(score(*derived(spark, d)))


HEADLINE = scored_sql() + f", {HEADLINE_SQL} SELECT grp AS \"group\", h.* EXCLUDE (grp), p.* EXCLUDE (grp) FROM h JOIN p USING (grp)"


def diagnostics(spark, d):
    return M.diagnostics(score(*derived(spark, d)))


DIAGNOSTICS = scored_sql() + """,
o AS (SELECT *, e % 4 < 2 AS pos, status = 'answered' AS ans FROM scored WHERE status <> 'error'),
l AS (SELECT e % 977 AS ms, row_number() OVER (ORDER BY e % 977) - 1 AS i, count(*) OVER () AS n FROM o WHERE e % 977 > 0)
SELECT round_even(avg(CASE WHEN pos THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 4) AS retrieval_hit_at_k, round_even(avg(CASE WHEN pos THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END), 4) AS mrr,
  round_even(avg(CASE WHEN type = 'quant' THEN CASE WHEN value_ok THEN 1.0 ELSE 0.0 END END), 4) AS quant_accuracy,
  round_even(avg(CASE WHEN type = 'quant' AND value_ok THEN CASE WHEN hit AND e % 2 = 0 THEN 1.0 ELSE 0.0 END END), 4) AS quant_citation_accuracy,
  round_even(avg(CASE WHEN type = 'qual' AND ans THEN round_even(facts / 3, 4) END), 4) AS qual_fact_coverage,
  round_even(avg(CASE WHEN type = 'qual' AND ans THEN round_even((e * 17 % 10 / 10 + e * 19 % 10 / 10 + e * 21 % 10 / 10) / 3, 4) END), 4) AS qual_fact_coverage_soft,
  round_even(1 - sum(CASE WHEN ans AND bad THEN 1 ELSE 0 END) / sum(CASE WHEN ans THEN 1 ELSE 0 END), 4) AS faithfulness,
  round_even(avg(CASE WHEN type = 'unanswerable' THEN CASE WHEN score = 2 THEN 1.0 ELSE 0.0 END END), 4) AS abstention_accuracy,
  round_even(avg(CASE WHEN type <> 'unanswerable' THEN CASE WHEN NOT ans THEN 1.0 ELSE 0.0 END END), 4) AS false_refusal_rate,
  round_even(avg(((e % 1000 + 1) * 304.0::DOUBLE + (e % 100 + 1) * 1827.0::DOUBLE) / 1e6), 2) AS cost_per_query,
  (SELECT CAST(sum(event_id % 50) AS BIGINT) FROM events) AS judge_tokens, round_even((SELECT sum(event_id % 50) FROM events) * 0.042::DOUBLE / 1e6, 4) AS judge_cost,
  (SELECT ms FROM l WHERE i = round_even(0.5 * (n - 1), 0)) AS latency_p50_ms, (SELECT ms FROM l WHERE i = round_even(0.95 * (n - 1), 0)) AS latency_p95_ms
FROM o"""


def cause_hist(spark, d):
    return M.cause_counts(score(*derived(spark, d)))


CAUSES = scored_sql() + " SELECT cause, count(*) AS n FROM scored WHERE cause IS NOT NULL GROUP BY cause"


def compare_runs(spark, d):
    items, records, checks = derived(spark, d)
    scored = score(items, records, checks).select((F.substring("id", 2, 20).cast("long") % 100).cast("string").alias("id"), F.substring("id", 2, 20).cast("long").alias("e"), "score")
    return changes(scored.filter("e % 200 < 100"), scored.filter("e % 200 >= 100")).select("id", F.bround("before", 6).alias("before"), F.bround("after", 6).alias("after"), "change")


COMPARE = scored_sql() + """,
m AS (SELECT CAST(e % 100 AS VARCHAR) AS id, avg(score) FILTER (e % 200 < 100) AS a, avg(score) FILTER (e % 200 >= 100) AS b FROM scored GROUP BY 1)
SELECT id, round_even(a, 6) AS before, round_even(b, 6) AS after, CASE WHEN b > a THEN 'improved' WHEN b < a THEN 'regressed' ELSE 'same' END AS change FROM m WHERE a IS NOT NULL AND b IS NOT NULL"""


def rescore_grid(spark, d):
    out = rescore(*derived(spark, d), {"base": Settings(), "strict": Settings(tau_support=0.9, tau_value=0.9), "loose": Settings(coverage_full=0.3)})
    return out.select("settings", "group", "n", "safety", "usefulness")


RESCORE = " UNION ALL ".join(f"SELECT * FROM ({scored_sql(*taus)}, {HEADLINE_SQL} SELECT '{name}' AS settings, grp AS \"group\", n, safety, usefulness FROM h)" for name, taus in (("base", ()), ("strict", ("0.9", "0.9")), ("loose", ("0.5", "0.5", "0.3"))))


def latency_percentile(spark, d):
    events = table(spark, d, "events").filter("value > 0")
    p50, p95 = (index_percentile(events, "value", q, ["event_type"], n) for q, n in ((0.5, "p50"), (0.95, "p95")))
    return p50.join(p95, "event_type")


LATENCY = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0)
SELECT event_type, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95 FROM r GROUP BY event_type"""


def cost_per_query(spark, d):
    cost = tokens_cost(F.col("l_quantity") * 100, F.col("l_extendedprice"), 304.0, 1827.0)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.bround(F.avg(cost), 2).alias("cost"))


COST = "SELECT l_returnflag, count(*) AS n, round_even(avg((l_quantity * 100 * 304.0::DOUBLE + l_extendedprice * 1827.0::DOUBLE) / 1e6), 2) AS cost FROM lineitem GROUP BY 1"


def check_expand(spark, d):
    said = table(spark, d, "conversations").filter("role = 'assistant'").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    m = F.col("conv_id") % 3
    none = F.lit(None).cast("array<struct<point:string,facts:array<string>>>")
    items = said.select("id", F.when(m == 0, "quant").when(m == 1, "qual").otherwise("partial").alias("type"), F.lit("42").alias("answer"), F.when(m == 1, F.array(F.struct(F.lit("p").alias("point"), F.array(F.lit("one"), F.lit("two")).alias("facts")))).otherwise(none).alias("must_include"), F.when(m == 1, F.array(F.lit("no (really)"))).alias("must_not"), F.when(m == 2, F.create_map(F.lit("2"), F.lit("ok"))).alias("scoring"))
    records = said.select("id", F.lit(0).alias("repeat"), F.lit("answered").alias("status"), F.col("text").alias("answer"))
    return C.expand(items, records).select("id", "check_id", "kind", "target")


CHECK_EXPAND = SENTENCES.replace("FROM conversations)", "FROM conversations WHERE role = 'assistant')").replace("SELECT conv_id, turn, unnest(string_split(replace", "SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(replace").replace("SELECT conv_id, turn, regexp_replace(trim", "SELECT conv_id, turn, n, regexp_replace(trim").replace("SELECT conv_id, turn, trim(unnest(string_split(line, chr(1)))) AS s", "SELECT conv_id, turn, n, generate_subscripts(string_split(line, chr(1)), 1) AS m, trim(unnest(string_split(line, chr(1)))) AS s") + """,
c AS (SELECT conv_id, turn, conv_id || '-' || turn AS id FROM conversations WHERE role = 'assistant')
SELECT conv_id || '-' || turn AS id, 's' || (row_number() OVER (PARTITION BY conv_id, turn ORDER BY n, m) - 1) AS check_id, 'support' AS kind, s AS target FROM parts WHERE length(s) >= 6
UNION ALL SELECT id, 'value', 'value', '42' FROM c WHERE conv_id % 3 = 0
UNION ALL SELECT id, k, 'fact', t FROM c, (VALUES ('f0_0', 'one'), ('f0_1', 'two')) v(k, t) WHERE conv_id % 3 = 1
UNION ALL SELECT id, 'm0', 'must_not', 'no' FROM c WHERE conv_id % 3 = 1
UNION ALL SELECT id, 'grade', 'grade', '{"2":"ok"}' FROM c WHERE conv_id % 3 = 2"""


def votes(spark, d):
    """Three votes on a check for every event; every fourth is a grade."""
    e, v = F.col("event_id"), F.col("vote")
    rows = table(spark, d, "events").select("event_id", F.explode(F.array(*map(F.lit, range(3)))).alias("vote"))
    grade = e % 4 == 0
    kind = F.when(grade, "grade").otherwise(F.element_at(F.array(*map(F.lit, ("value", "fact", "support"))), (e % 4).cast("int") + F.when(grade, 1).otherwise(0)))
    return rows.select(e.cast("string").alias("id"), F.lit(0).alias("repeat"), F.lit("c").alias("check_id"), kind.alias("kind"), F.lit("t").alias("target"), "vote", F.when(~grade, e * (7 + v) % 100 / 100).alias("p"), F.when(grade, F.create_map(((e + v * v) % 3).cast("string"), F.lit(1.0))).alias("probabilities"))


def judge_repeat_mean(spark, d):
    return C.votes_mean(votes(spark, d)).select("id", "kind", "p", "choice")


REPEAT_MEAN = """
WITH v AS (SELECT event_id AS e, unnest([0, 1, 2]) AS v FROM events),
c AS (SELECT e, (e + v * v) % 3 AS choice, count(*) AS n FROM v WHERE e % 4 = 0 GROUP BY ALL)
SELECT CAST(e AS VARCHAR) AS id, ['value', 'fact', 'support'][e % 4] AS kind, round_even(sum(e * (7 + v) % 100) / 100 / 3, 4) AS p, NULL AS choice FROM v WHERE e % 4 > 0 GROUP BY e
UNION ALL SELECT CAST(e AS VARCHAR), 'grade', NULL, CAST(arg_min(choice, [-n, choice]) AS VARCHAR) FROM c GROUP BY e"""


def judge_consistency(spark, d):
    return M.consistency(C.votes_mean(votes(spark, d)), Settings().taus())


CONSISTENCY = """
WITH v AS (SELECT event_id AS e, CASE WHEN event_id % 4 = 0 THEN 'grade' ELSE ['value', 'fact', 'support'][event_id % 4] END AS kind, unnest([0, 1, 2]) AS v FROM events),
p AS (SELECT e, kind, max(round_even(e * (7 + v) % 100 / 100, 4)) AS hi, min(round_even(e * (7 + v) % 100 / 100, 4)) AS lo, count(DISTINCT (e + v * v) % 3) AS d, CASE kind WHEN 'fact' THEN 0.8 ELSE 0.5 END AS tau FROM v GROUP BY e, kind)
SELECT kind, count(*) AS n, round_even(avg(CASE WHEN kind = 'grade' AND d > 1 OR kind <> 'grade' AND hi >= tau AND lo < tau THEN 1.0 ELSE 0.0 END), 4) AS flip_rate,
       round_even(avg(CASE WHEN kind <> 'grade' THEN hi - lo END), 4) AS mean_diff, round_even(max(CASE WHEN kind <> 'grade' THEN hi - lo END), 4) AS max_diff
FROM p GROUP BY kind"""


def vote_majority(spark, d):
    v = votes(spark, d).filter("kind = 'grade'").select("id", F.map_keys("probabilities")[0].alias("choice"))
    return C.majority(v, ["id"])


MAJORITY = """
WITH c AS (SELECT event_id AS e, (event_id + v * v) % 3 AS choice, count(*) AS n FROM (SELECT event_id, unnest([0, 1, 2]) AS v FROM events WHERE event_id % 4 = 0) GROUP BY ALL)
SELECT CAST(e AS VARCHAR) AS id, CAST(arg_min(choice, [-n, choice]) AS VARCHAR) AS choice, CAST(sum(n) AS BIGINT) AS votes, count(*) > 1 AS split FROM c GROUP BY e"""


def judged_labels(spark, d):
    """Labels of quality against a score that the length of a text gives, by language; items are sources."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(F.col("lang").alias("kind"), F.col("source").alias("item"), (F.col("n_chars") % 101 / 100).alias("p"), (F.col("quality") == 1).alias("human"))


LABELLED = "WITH l AS (SELECT lang AS kind, source AS item, n_chars % 101 / 100 AS p, quality = 1 AS human FROM documents JOIN labels USING (doc_id))"
TAUS = """
c AS (SELECT kind, (p + lead(p) OVER (PARTITION BY kind ORDER BY p)) / 2 AS tau FROM (SELECT kind, p FROM l UNION SELECT kind, 0.0 FROM l UNION SELECT kind, 1.0 FROM l))"""


def calibrate_confusion(spark, d):
    return K.confusion(judged_labels(spark, d), 0.5, ["kind"])


CONFUSION = LABELLED + """,
c AS (SELECT kind, count(*) AS n, count(*) FILTER (p >= 0.5 AND human) AS tp, count(*) FILTER (p >= 0.5 AND NOT human) AS fp, count(*) FILTER (p < 0.5 AND human) AS fn, count(*) FILTER (p < 0.5 AND NOT human) AS tn FROM l GROUP BY kind),
k AS (SELECT *, (tp + tn) / n AS po, (tp + fp) / n AS j, (tp + fn) / n AS h FROM c)
SELECT kind, n, tp, fp, fn, tn, round_even(po, 3) AS accuracy, CASE WHEN j * h + (1 - j) * (1 - h) < 1 THEN round_even((po - (j * h + (1 - j) * (1 - h))) / (1 - (j * h + (1 - j) * (1 - h))), 3) END AS kappa FROM k"""


def calibrate_best_tau(spark, d):
    return K.best_threshold(judged_labels(spark, d), ["kind"]).select("kind", F.bround("tau", 6).alias("tau"), "accuracy")


BEST_TAU = LABELLED + f", {TAUS}, " + """
m AS (SELECT c.kind, tau, count(*) FILTER ((p >= tau) = human) AS m, count(*) AS n FROM c JOIN l USING (kind) WHERE tau IS NOT NULL GROUP BY c.kind, tau),
b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY m DESC, abs(tau - 0.5), tau) AS r FROM m)
SELECT kind, round_even(tau, 6) AS tau, round_even(m / n, 3) AS accuracy FROM b WHERE r = 1"""


def calibrate_loo(spark, d):
    return K.held_out_accuracy(judged_labels(spark, d), ["kind"])


LOO = LABELLED + """,
i AS (SELECT DISTINCT kind, item AS held FROM l),
v AS (SELECT i.kind, held, p FROM i JOIN l ON l.kind = i.kind AND item <> held UNION SELECT kind, held, 0.0 FROM i UNION SELECT kind, held, 1.0 FROM i),
c AS (SELECT kind, held, (p + lead(p) OVER (PARTITION BY kind, held ORDER BY p)) / 2 AS tau FROM v),
m AS (SELECT c.kind, held, tau, count(*) FILTER ((p >= tau) = human) AS m FROM c JOIN l ON l.kind = c.kind AND item <> held WHERE tau IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY kind, held ORDER BY m DESC, abs(tau - 0.5), tau) AS r FROM m)
SELECT l.kind, round_even(avg(CASE WHEN (p >= tau) = human THEN 1.0 ELSE 0.0 END), 3) AS cv_accuracy FROM l JOIN b ON b.kind = l.kind AND held = item AND r = 1 GROUP BY l.kind"""


def auc(spark, d):
    return K.auc(judged_labels(spark, d), ["kind"])


AUC = LABELLED + """,
k AS (SELECT kind, count(*) FILTER (human) AS positives, count(*) FILTER (NOT human) AS negatives FROM l GROUP BY kind),
a AS (SELECT a.kind, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS auc FROM l a JOIN l b ON a.kind = b.kind AND a.human AND NOT b.human GROUP BY a.kind)
SELECT kind, positives, negatives, round_even(auc, 4) AS auc FROM k LEFT JOIN a USING (kind)"""


def stratified_pick(spark, d):
    return G.stratified(table(spark, d, "documents").select("doc_id"), 10, "doc_id", "doc_id", 5).select("doc_id", "stratum", "pick")


STRATIFIED = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, (SELECT max(i) FROM (SELECT unnest(range(0, 10)) AS i) WHERE round_even(i * n / 10.0, 0) < place) AS stratum FROM r),
t AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('5:' || doc_id), doc_id) AS turn FROM s)
SELECT doc_id, CAST(stratum AS INTEGER) AS stratum, row_number() OVER (ORDER BY turn, stratum) AS pick FROM t"""


def chapter_pick(spark, d):
    return G.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5).select("doc_id", "pick")


CHAPTERS = """
WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS turn FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY turn, source) AS pick FROM t"""


def quota_cap(spark, d):
    return G.capped(table(spark, d, "events").select("event_id", "event_type"), "event_id", F.col("event_type") == "click", 50)


QUOTA = """
SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type = 'click' ORDER BY event_id) AS n FROM events) WHERE event_type <> 'click' OR n <= 50"""


def keyword_absent(spark, d):
    words = F.filter(F.regexp_extract_all("text", F.lit(r"(\p{L}{14,})"), F.lit(1)), lambda w: w != "")
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.slice(words, 1, 2).alias("keywords"))
    return G.absent_keywords(c, table(spark, d, "benchmark"), "id").select("id")


KEYWORDS = r"""
WITH c AS (SELECT conv_id || '-' || turn AS id, regexp_extract_all(text, '\p{L}{14,}')[1:2] AS k FROM conversations),
b AS (SELECT regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark),
h AS (SELECT DISTINCT id FROM (SELECT id, unnest(k) AS w FROM c) JOIN b ON contains(t, w))
SELECT id FROM c WHERE len(k) > 0 AND id NOT IN (SELECT id FROM h)"""


def draft_checks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\n")[0].alias("line"), F.col("doc_id").alias("m"))
    m = F.col("m") % 6
    drafts = docs.select("doc_id", "text", F.when(m == 1, "no topic").alias("skip"), F.when(m == 5, F.col("line")).otherwise("zzz question?").alias("question_literal"), F.when(m == 2, " ").otherwise("u").alias("question_user"), F.when(m == 4, "zzz").otherwise(F.col("line").substr(1, 5)).alias("answer"), F.when(m == 3, "zzz not here").otherwise(F.col("line")).alias("quote"))
    return G.check_quant(drafts.filter("trim(quote) <> '' AND trim(answer) <> ''")).select("doc_id", "reason")


DRAFTS = """
SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'skipped' WHEN 2 THEN 'missing field' WHEN 3 THEN 'quote not in source' WHEN 4 THEN 'answer not in quote' WHEN 5 THEN 'question copied from source' END AS reason
FROM (SELECT *, string_split(text, chr(10))[1] AS line FROM documents) WHERE (doc_id % 6 = 3 OR trim(line) <> '') AND (doc_id % 6 = 4 OR trim(substr(line, 1, 5)) <> '')"""


def gold_validate(spark, d):
    e = F.col("event_id")
    m = e % 8
    evidence = "array<struct<document_id:string,page:int,quote:string>>"
    full = F.array(F.struct(F.lit("d").alias("document_id"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("quote")))
    poor = F.array(F.struct(F.lit("d").alias("document_id"), F.lit(None).cast("int").alias("page"), F.lit("").alias("quote")))
    items = table(spark, d, "events").select(
        e.cast("string").alias("id"), F.when(m < 5, "quant").when(m == 5, "qual").when(m == 6, "partial").otherwise("odd").alias("type"), F.lit("q?").alias("question"),
        F.when(m == 1, "lost").otherwise("approved").alias("status"), F.when(m == 2, "").otherwise("p").alias("provenance"), F.when(m != 3, "a").alias("answer"),
        F.when(m == 4, poor).when(m == 0, F.array().cast(evidence)).otherwise(full).alias("evidence"),
        F.when(m == 5, F.array(F.struct(F.lit("x").alias("point"), F.array().cast("array<string>").alias("facts"), full.alias("evidence")))).alias("must_include"),
        F.when(m == 6, F.create_map(F.lit("2"), F.lit("x"))).alias("scoring"), F.when(m == 6, "answered").alias("expected_status"),
    )
    return S.validate(items).select("id", F.array_join("errors", "; ").alias("errors"))


GOLD_VALIDATE = """
SELECT CAST(event_id AS VARCHAR) AS id, ['no evidence', 'unknown status', 'no provenance', 'no answer', 'evidence needs document_id and page or quote', 'point without facts', 'scoring needs 2 and 0, and 1 at most besides', 'unknown type'][event_id % 8 + 1] AS errors FROM events"""


def dup_ids(spark, d):
    return S.duplicates(table(spark, d, "events").select(F.col("user_id").alias("id")))


def preflight(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha256"))
    held = docs.filter("doc_id % 9 <> 0").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.sha2("text", 256)).alias("content_hash"))
    return S.document_problems(wanted, held)


PREFLIGHT = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 7 = 0"""


def label_sheet_parse(spark, d):
    from answerlens.functions.text import cell

    e = table(spark, d, "events")
    m = (F.col("event_id") % 6).cast("int")
    verdict = F.element_at(F.array(*map(F.lit, ("o", "X", "?", "", "2", "0"))), m + 1)
    line = F.concat(F.lit("| "), F.col("event_id").cast("string"), F.lit("#f0_1 | fact | "), cell(F.concat("event_type", F.lit(" | x"))), F.lit(" | "), verdict, F.lit(" | "), "event_type", F.lit(" |"))
    lines = e.select(line.alias("value")).unionByName(e.select(F.concat(F.lit("| key | "), "event_type", F.lit(" |")).alias("value")))
    return label_sheet(lines)


LABEL_SHEET = """
SELECT CAST(event_id AS VARCHAR) AS id, 'f0_1' AS check_id, ['O', 'X', '?', '', '2', '0'][event_id % 6 + 1] AS verdict, event_type AS memo FROM events WHERE event_id % 6 <> 3"""

QUERIES = {
    "knn_topk": knn_topk, "knn_gate": knn_gate, "retrieval_curve": retrieval_curve, "retrieval_mrr": retrieval_mrr, "missing_units": missing_units, "doc_title_join": doc_title_join,
    "score_rules": score_rules, "headline_groups": headline_groups, "diagnostics": diagnostics, "cause_hist": cause_hist, "compare_runs": compare_runs, "rescore_grid": rescore_grid,
    "latency_percentile": latency_percentile, "cost_per_query": cost_per_query, "check_expand": check_expand, "judge_repeat_mean": judge_repeat_mean, "judge_consistency": judge_consistency,
    "vote_majority": vote_majority, "calibrate_confusion": calibrate_confusion, "calibrate_best_tau": calibrate_best_tau, "calibrate_loo": calibrate_loo, "auc": auc,
    "stratified_pick": stratified_pick, "chapter_pick": chapter_pick, "quota_cap": quota_cap, "keyword_absent": keyword_absent, "draft_checks": draft_checks,
    "gold_validate": gold_validate, "dup_ids": dup_ids, "preflight": preflight, "label_sheet_parse": label_sheet_parse,
}
ORACLES = {
    "knn_topk": KNN, "knn_gate": KNN_GATE, "retrieval_curve": CURVE, "retrieval_mrr": MRR, "missing_units": MISSING, "doc_title_join": TITLES, "score_rules": SCORE_RULES,
    "headline_groups": HEADLINE, "diagnostics": DIAGNOSTICS, "cause_hist": CAUSES, "compare_runs": COMPARE, "rescore_grid": RESCORE, "latency_percentile": LATENCY, "cost_per_query": COST,
    "check_expand": CHECK_EXPAND, "judge_repeat_mean": REPEAT_MEAN, "judge_consistency": CONSISTENCY, "vote_majority": MAJORITY, "calibrate_confusion": CONFUSION,
    "calibrate_best_tau": BEST_TAU, "calibrate_loo": LOO, "auc": AUC, "stratified_pick": STRATIFIED, "chapter_pick": CHAPTERS, "quota_cap": QUOTA, "keyword_absent": KEYWORDS,
    "draft_checks": DRAFTS, "gold_validate": GOLD_VALIDATE, "dup_ids": "SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1", "preflight": PREFLIGHT, "label_sheet_parse": LABEL_SHEET,
}
