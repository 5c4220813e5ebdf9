"""Rounding, shares and index percentiles with the semantics that all metrics use: null for an empty denominator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCURACY = 10_000


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounded, ties to even."""
    return F.bround(value.cast("double"), digits)


def share(flag: Column, among: Column | None = None) -> Column:
    """Aggregate: share of true flags (null counts as false) among the rows that count."""
    counted = F.coalesce(flag, F.lit(False)).cast("double")
    return half_even(F.avg(counted if among is None else F.when(among, counted)))


def mean(value: Column, among: Column | None = None) -> Column:
    return half_even(F.avg(value if among is None else F.when(among, value)))


def index_percentile(df: DataFrame, value: str, q: float, by: list[str] | None = None, name: str = "value", cut: bool = False) -> DataFrame:
    """The value at index round(q (n-1)) of the sorted values (cut: the whole part), nulls left out. Exact.

    In groups of more than ACCURACY values, a sketch of bounded rank error gives two values that enclose it; values
    outside are only counted, and only those inside, a few in a thousand besides equal ones, are put in order.
    """
    by = by or []
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(f"__{c}") for c in by], F.col(value).alias("__v"))
    spare = 8 / ACCURACY
    ends = F.percentile_approx("__v", F.array(F.lit(max(0.0, q - spare)), F.lit(min(1.0, q + spare))), ACCURACY)
    bounds = rows.groupBy(*[F.col(f"__{c}").alias(c) for c in by]).agg(ends.alias("__ends"), F.count("*").alias("__all"))
    if by:
        same = reduce(lambda a, b: a & b, [rows[f"__{c}"].eqNullSafe(bounds[c]) for c in by])
        near = rows.join(bounds, same)
    else:
        near = rows.crossJoin(F.broadcast(bounds))  # one row
    zone = F.when(F.col("__all") <= ACCURACY, 0).when(F.col("__v") < F.col("__ends")[0], -1).when(F.col("__v") > F.col("__ends")[1], 1).otherwise(0)
    counts = near.select(*by, zone.alias("__zone"), F.when(zone == 0, F.col("__v")).alias("__v")).groupBy(*by, "__zone", "__v").agg(F.count("*").alias("__n"))
    window = Window.partitionBy(*by)
    upto = F.sum("__n").over(window.orderBy("__zone", "__v").rowsBetween(Window.unboundedPreceding, 0))
    at = F.lit(q) * (F.sum("__n").over(window) - 1)
    index = F.floor(at) if cut else F.bround(at, 0)
    ranked = counts.select(*by, "__zone", "__v", upto.alias("__upto"), index.alias("__index"))
    return ranked.filter("__upto > __index AND __zone = 0").groupBy(*by).agg(F.min("__v").alias(name))
