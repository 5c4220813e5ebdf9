"""Summaries of scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even, index_percentile, mean, share
from answerlens.functions.text import tokens_cost
from answerlens.settings import Settings

GROUPS = ("quant", "qual", "negative")


def headline_columns(score: Column) -> list[Column]:
    """n, errors, safety (share of 1 or better), usefulness (mean / 2), and counts of the three scores."""
    return [
        F.count(score).alias("n"), F.count_if(score.isNull()).alias("errors"),
        half_even(F.avg((score >= 1).cast("double"))).alias("safety"), half_even(F.avg(score) / 2).alias("usefulness"),
        *[F.count_if(score == k).alias(f"score_{k}") for k in (0, 1, 2)],
    ]


def headline(scored: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """A row per group, empty ones too, and 'total', with the range of both shares over repeats."""
    spark = scored.sparkSession
    score = F.col("score")
    sets = lambda by: scored.groupingSets([["group", *by], by], "group", *by).agg(*headline_columns(score)).withColumn("group", F.coalesce("group", F.lit("total")))
    whole = sets([])
    per = sets(["repeat"]).groupBy("group").agg(*[f(m).alias(f"{m}_{n}") for m in ("safety", "usefulness") for f, n in ((F.min, "min"), (F.max, "max"))])
    names = spark.createDataFrame([(g,) for g in (*groups, "total")], "`group` string")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n", "errors", "score_0", "score_1", "score_2")}
    return names.join(whole, "group", "left").join(per, "group", "left").withColumns(counts)


def diagnostics(scored: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of rates over all records, computed in one aggregation, and two latency percentiles."""
    s = settings or Settings()
    ok = F.col("status") != "error"
    answered = F.col("status") == "answered"
    refused = F.col("status") == "insufficient_context"
    quant, qual = F.col("type") == "quant", F.col("type") == "qual"
    value_ok = F.coalesce("value_ok", F.lit(False))
    judged = F.sum(F.when(ok & answered, F.col("sentences_judged")))
    cost = tokens_cost(F.col("usage.prompt_tokens"), F.col("usage.completion_tokens"), s.price_in, s.price_out)
    out = scored.agg(
        share(F.col("first_hit_rank").isNotNull(), ok & F.col("has_evidence")).alias("retrieval_hit_at_k"),
        mean(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)), ok & F.col("has_evidence")).alias("mrr"),
        share(value_ok, ok & quant).alias("quant_accuracy"),
        share(F.col("cited_evidence"), ok & quant & value_ok).alias("quant_citation_accuracy"),
        mean(F.col("coverage"), ok & qual & answered).alias("qual_fact_coverage"),
        mean(F.col("coverage_soft"), ok & qual & answered).alias("qual_fact_coverage_soft"),
        half_even(1 - F.sum(F.when(ok & answered, F.col("unsupported"))) / F.nullif(judged, F.lit(0))).alias("faithfulness"),
        share(F.col("score") == 2, ok & F.col("expected_status").eqNullSafe("insufficient_context")).alias("abstention_accuracy"),
        share(refused, ok & (quant | qual | F.col("expected_status").eqNullSafe("answered"))).alias("false_refusal_rate"),
        half_even(F.avg(F.when(ok, cost)), 2).alias("cost_per_query"),
        F.coalesce(F.sum("judge_tokens"), F.lit(0)).alias("judge_tokens"),
        half_even(F.coalesce(F.sum("judge_tokens"), F.lit(0)) * s.judge_price / 1e6).alias("judge_cost"),
    )
    timed = scored.filter(ok & (F.coalesce("latency_ms", F.lit(0)) > 0))
    for q in (50, 95):
        at = index_percentile(timed, "latency_ms", q / 100, name=f"latency_p{q}_ms").agg(F.max(f"latency_p{q}_ms").alias(f"latency_p{q}_ms"))
        out = out.crossJoin(F.broadcast(at))  # one row each
    return out


def cause_counts(scored: DataFrame) -> DataFrame:
    return scored.filter("cause IS NOT NULL").groupBy("cause").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause")


def consistency(checks: DataFrame, taus: dict[str, float]) -> DataFrame:
    """(kind, n, flip_rate, mean_diff, max_diff) of checks with two votes or more: how far repeats differ."""
    tau = F.create_map(*[F.lit(x) for pair in taus.items() for x in pair])[F.col("kind")]
    ps = F.col("ps")
    grade = F.col("kind") == "grade"
    enough = F.when(grade, F.size(F.coalesce("choices", F.array().cast("array<string>"))) >= 2).otherwise(F.size(F.coalesce(ps, F.array().cast("array<double>"))) >= 2)
    flip = F.when(grade, F.size(F.array_distinct("choices")) > 1).otherwise(F.exists(ps, lambda x: x >= tau) & F.exists(ps, lambda x: x < tau))
    diff = F.when(~grade, F.array_max(ps) - F.array_min(ps))
    rows = checks.filter(enough).select("kind", flip.alias("flip"), diff.alias("diff"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), share(F.col("flip")).alias("flip_rate"), mean(F.col("diff")).alias("mean_diff"), half_even(F.max("diff")).alias("max_diff"))


def token_stats(df: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """(by, n, total, min, max, p50, p95): the median, and the 95th percentile at the whole part of its index."""
    base = df.groupBy(*by).agg(F.count(tokens).alias("n"), F.sum(tokens).alias("total"), F.min(tokens).alias("min"), F.max(tokens).alias("max"), F.median(tokens).alias("p50"))
    return base.join(index_percentile(df, tokens, 0.95, by, "p95", cut=True), by, "left")
