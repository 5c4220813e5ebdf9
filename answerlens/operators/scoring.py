"""Scores 0, 1 or 2 with a cause, from records, items and checks. The first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even
from answerlens.operators.evidence import covers, first_rank, item_evidence, retrieved_any
from answerlens.settings import Settings


def check_summary(checks: DataFrame, s: Settings) -> DataFrame:
    """(id, repeat, ...): what the rules need of a record's checks, in one aggregation."""
    kind, p = F.col("kind"), F.col("p")
    return checks.groupBy("id", "repeat").agg(
        F.count_if(kind == "support").alias("sentences_judged"),
        F.count_if((kind == "support") & (p < s.tau_support)).alias("unsupported"),
        F.max(F.when(kind == "value", p)).alias("value_p"),
        F.count_if((kind == "must_not") & (p >= s.tau_must_not)).alias("violations"),
        F.max(F.when(kind == "grade", F.col("choice"))).alias("grade"),
        F.collect_list(F.when(kind == "fact", F.struct(F.regexp_extract("check_id", r"^f(\d+)_", 1).cast("int").alias("point"), (p >= s.tau_fact).alias("covered"), p.alias("p")))).alias("facts"),
    )


def score(items: DataFrame, records: DataFrame, checks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Records with group, score (null after an error), cause and the details of the rules.

    Citations are looked up among the retrieved chunks by their number, so a document without pages can be cited by its
    text.
    """
    s = settings or Settings()
    evidence = item_evidence({"type": F.col("type"), "must_include": F.col("must_include"), "evidence": F.col("evidence")})
    asked = items.select("id", "type", "must_include", "evidence", "scoring", "expected_status").withColumn("all_evidence", evidence)
    rows = records.drop("type").join(asked, "id").join(check_summary(checks, s), ["id", "repeat"], "left")
    has = F.size("all_evidence") > 0
    refs = F.transform(F.coalesce("citations", F.array().cast(records.schema["citations"].dataType)), lambda c: c["ref"])
    cited_hits = F.filter("retrieved", lambda h: F.array_contains(refs, h["ref"]))
    rows = rows.withColumns({
        "evidence_retrieved": F.when(has, retrieved_any(F.col("retrieved"), F.col("all_evidence"))),
        "first_hit_rank": F.when(has, first_rank(F.col("retrieved"), F.col("all_evidence"))),
        "cited_evidence": F.exists("all_evidence", lambda e: F.exists(cited_hits, lambda h: covers(h, e))),
        "unsupported": F.coalesce("unsupported", F.lit(0)), "sentences_judged": F.coalesce("sentences_judged", F.lit(0)),
        "value_ok": F.col("value_p") >= s.tau_value,
        "point_hits": F.when(F.col("type") == "qual", F.transform("must_include", lambda p: retrieved_any(F.col("retrieved"), p["evidence"]))),
    })
    n = F.size("facts")
    missing = F.filter("facts", lambda f: ~f["covered"])
    lost = F.size(F.filter(missing, lambda f: ~F.coalesce(F.get(F.col("point_hits"), f["point"]), F.lit(False))))
    rows = rows.withColumns({
        "coverage_raw": F.when((F.col("type") == "qual") & (n > 0), (n - F.size(missing)) / n),
        "coverage_soft": F.when((F.col("type") == "qual") & (n > 0), half_even(F.aggregate("facts", F.lit(0.0), lambda a, f: a + f["p"]) / n)),
        "lost_facts": lost, "missing_facts": F.size(missing),
    })
    refused = F.col("status") == "insufficient_context"
    positive = F.col("type").isin("quant", "qual")
    bad = F.col("unsupported") > 0
    graded = F.col("grade").cast("int")
    soft_one = F.map_contains_key("scoring", F.lit("1"))
    final_grade = F.when((graded > 0) & bad, 0).otherwise(graded)
    rules = [
        (F.col("status") == "error", None, "execution_error"),
        (positive & refused, 1, "false_refusal"),
        ((F.col("type") == "quant") & (~F.coalesce("value_ok", F.lit(False)) | bad), 0, "hallucination"),
        ((F.col("type") == "quant") & F.col("cited_evidence"), 2, None),
        (F.col("type") == "quant", 1, "citation_error"),
        ((F.col("type") == "qual") & ((F.coalesce("violations", F.lit(0)) > 0) | bad), 0, "hallucination"),
        ((F.col("type") == "qual") & (F.col("coverage_raw") >= s.coverage_full), 2, None),
        ((F.col("type") == "qual") & (F.col("lost_facts") * 2 > F.col("missing_facts")), 1, "retrieval_failure"),
        (F.col("type") == "qual", 1, "generation_omission"),
        (refused & soft_one, 1, "false_refusal"),
        (refused, 2, None),
        (final_grade == 0, 0, "hallucination"),
        (final_grade == 1, 1, "false_refusal"),
        (final_grade == 2, 2, None),
    ]
    points, cause = F.lit(None).cast("int"), F.lit(None).cast("string")
    for test, value, why in reversed(rules):
        points, cause = F.when(test, F.lit(value).cast("int")).otherwise(points), F.when(test, F.lit(why).cast("string")).otherwise(cause)
    reason = F.when(cause.eqNullSafe("false_refusal") & refused, F.when(F.col("evidence_retrieved").eqNullSafe(False), "retrieval").otherwise("generation"))
    error = F.col("status") == "error"
    out = rows.withColumns({"score": points, "cause": cause, "refusal_reason": reason, "coverage": half_even(F.col("coverage_raw")), "has_evidence": has})
    for name in ("evidence_retrieved", "first_hit_rank", "value_ok", "cited_evidence"):
        out = out.withColumn(name, F.when(~error, F.col(name)))
    return out.drop("coverage_raw", "point_hits", "lost_facts", "missing_facts", "all_evidence", "must_include", "evidence")
