"""Run comparison and rescoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even
from answerlens.operators.metrics import headline
from answerlens.operators.scoring import score
from answerlens.settings import Settings


def item_means(scored: DataFrame) -> DataFrame:
    """(id, mean_score) over repeats, errors left out."""
    return scored.filter("score IS NOT NULL").groupBy("id").agg(F.avg("score").alias("mean_score"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, before, after, change) of items scored in both runs."""
    both = item_means(a).withColumnRenamed("mean_score", "before").join(item_means(b).withColumnRenamed("mean_score", "after"), "id")
    return both.withColumn("change", F.when(F.col("after") > F.col("before"), "improved").when(F.col("after") < F.col("before"), "regressed").otherwise("same"))


def group_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(group, safety and usefulness of both runs and their differences in percentage points)."""
    side = lambda df, n: headline(df).select("group", *[F.col(m).alias(f"{m}_{n}") for m in ("safety", "usefulness")])
    out = side(a, "a").join(side(b, "b"), "group")
    return out.withColumns({f"{m}_points": half_even((F.col(f"{m}_b") - F.col(f"{m}_a")) * 100, 1) for m in ("safety", "usefulness")})


def rescore(items: DataFrame, records: DataFrame, checks: DataFrame, grid: dict[str, Settings]) -> DataFrame:
    """Headlines of stored answers under each named settings, without asking a model again."""
    out = None
    for name, settings in grid.items():
        one = headline(score(items, records, checks, settings)).withColumn("settings", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
