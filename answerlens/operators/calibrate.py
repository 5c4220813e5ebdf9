"""Agreement of a judge with human labels: confusion, kappa, the best threshold and its cross-validation, AUC.

Rows are (kind, item, p, human). Votes are first counted by (item, p), and thresholds are swept with running counts, so
no row is paired with every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even


def confusion(rows: DataFrame, tau: Column | float, by: list[str]) -> DataFrame:
    """(by, n, tp, fp, fn, tn, accuracy, kappa) at a threshold; kappa is null where chance agreement is certain."""
    yes, human = F.col("p") >= tau, F.col("human")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(yes & human).alias("tp"), F.count_if(yes & ~human).alias("fp"), F.count_if(~yes & human).alias("fn"), F.count_if(~yes & ~human).alias("tn"))
    n, tp, fp, fn, tn = (F.col(c).cast("double") for c in ("n", "tp", "fp", "fn", "tn"))
    observed = (tp + tn) / n
    judge, person = (tp + fp) / n, (tp + fn) / n
    chance = judge * person + (1 - judge) * (1 - person)
    return out.withColumns({"accuracy": half_even(observed, 3), "kappa": F.when(chance < 1, half_even((observed - chance) / (1 - chance), 3))})


def thresholds(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, tau, matches, n): agreement at the middles between neighbouring distinct p, 0 and 1 among them."""
    spans = rows.select(*by).distinct()
    ends = spans.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("p"), F.lit(0).alias("yes"), F.lit(0).alias("no"))
    values = rows.groupBy(*by, "p").agg(F.count_if(F.col("human")).cast("int").alias("yes"), F.count_if(~F.col("human")).cast("int").alias("no"))
    points = values.unionByName(ends).groupBy(*by, "p").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    order = Window.partitionBy(*by).orderBy("p")
    whole = Window.partitionBy(*by)
    below_no = F.sum("no").over(order.rowsBetween(Window.unboundedPreceding, 0))
    above_yes = F.sum("yes").over(whole) - F.sum("yes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    tau = (F.col("p") + F.lead("p").over(order)) / 2
    return points.select(*by, tau.alias("tau"), (below_no + above_yes).alias("matches"), F.sum(F.col("yes") + F.col("no")).over(whole).alias("n")).filter("tau IS NOT NULL")


def best_threshold(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, tau, accuracy): most matches, then closest to a half, then smallest."""
    best = thresholds(rows, by).groupBy(*by).agg(F.min_by(F.struct("tau", "matches", "n"), F.struct(-F.col("matches"), F.abs(F.col("tau") - 0.5), F.col("tau"))).alias("b"))
    return best.select(*by, F.col("b.tau").alias("tau"), half_even(F.col("b.matches") / F.col("b.n"), 3).alias("accuracy"))


def held_out_accuracy(rows: DataFrame, by: list[str], fallback: float = 0.5) -> DataFrame:
    """(by, cv_accuracy): each item judged at the best threshold of all others (fallback if there are none).

    All points are swept once; an item's sweep is the whole less its own rows, at the points that stay without it.
    """
    items = rows.select(*by, "item").distinct().withColumnRenamed("item", "held")
    counted = rows.groupBy(*by, "item", "p").agg(F.count_if(F.col("human")).alias("yes"), F.count_if(~F.col("human")).alias("no"))
    total = counted.groupBy(*by, "p").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    own = counted.withColumnRenamed("item", "held").withColumnsRenamed({"yes": "own_yes", "no": "own_no"})
    # A row for each item and distinct p: labels are made by hand, and both are few. Nothing here grows with the corpus.
    rest = items.join(total, by).join(own, [*by, "held", "p"], "left").select(*by, "held", "p", (F.col("yes") - F.coalesce("own_yes", F.lit(0))).alias("yes"), (F.col("no") - F.coalesce("own_no", F.lit(0))).alias("no")).filter("yes + no > 0")
    ends = items.select(*by, "held", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("p"), F.lit(0).cast("long").alias("yes"), F.lit(0).cast("long").alias("no"))
    points = rest.unionByName(ends).groupBy(*by, "held", "p").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    part = Window.partitionBy(*by, "held")
    order = part.orderBy("p")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    matches = F.sum("no").over(upto) + F.sum("yes").over(part) - F.sum("yes").over(upto)
    swept = points.select(*by, "held", ((F.col("p") + F.lead("p").over(order)) / 2).alias("tau"), matches.alias("matches"), F.sum(F.col("yes") + F.col("no")).over(part).alias("n")).filter("tau IS NOT NULL")
    best = swept.groupBy(*by, "held").agg(F.min_by("tau", F.struct(-F.col("matches"), F.abs(F.col("tau") - 0.5), F.col("tau"))).alias("tau"), F.max("n").alias("n"))
    tau = F.when(F.col("n") > 0, F.col("tau")).otherwise(fallback)
    judged = rows.join(best.withColumnRenamed("held", "item"), [*by, "item"])
    return judged.groupBy(*by).agg(half_even(F.avg(((F.col("p") >= tau) == F.col("human")).cast("double")), 3).alias("cv_accuracy"))


def auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, positives, negatives, auc): share of pairs in order, ties as halves, from counts below each p."""
    counts = rows.groupBy(*by, "p").agg(F.count_if(F.col("human")).alias("yes"), F.count_if(~F.col("human")).alias("no"))
    below = F.coalesce(F.sum("no").over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("won", F.col("yes") * (below + F.col("no") / 2))
    out = won.groupBy(*by).agg(F.sum("yes").alias("positives"), F.sum("no").alias("negatives"), F.sum("won").alias("won"))
    return out.select(*by, "positives", "negatives", half_even(F.col("won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"))


def calibrate(labels: DataFrame, checks: DataFrame, taus: dict[str, float]) -> DataFrame:
    """(kind, n, ...) from labels (id, check_id, verdict O, X or ?) and checks; '?' is left out and counted as skipped.

    Grades are compared as they are: agreement is the share of equal choices.
    """
    both = labels.join(checks.select("id", "check_id", "kind", "p", "choice"), ["id", "check_id"])
    skipped = both.filter("kind <> 'grade'").groupBy("kind").agg(F.count_if(~F.col("verdict").isin("O", "X")).alias("skipped"))
    rows = both.filter(F.col("verdict").isin("O", "X") & (F.col("kind") != "grade")).select("kind", F.col("id").alias("item"), "p", (F.col("verdict") == "O").alias("human"))
    tau = F.create_map(*[F.lit(x) for pair in taus.items() for x in pair])[F.col("kind")]
    found = confusion(rows, tau, ["kind"]).withColumn("tau", tau)
    best = best_threshold(rows, ["kind"]).withColumnsRenamed({"tau": "best_tau", "accuracy": "best_tau_accuracy"}).withColumn("best_tau", half_even(F.col("best_tau"), 3))
    out = found.join(best, "kind").join(held_out_accuracy(rows, ["kind"]), "kind").join(skipped, "kind")
    grades = both.filter("kind = 'grade'").groupBy("kind").agg(F.count("*").alias("n"), half_even(F.avg((F.col("choice") == F.col("verdict")).cast("double")), 3).alias("agreement"))
    return out.unionByName(grades, allowMissingColumns=True)
