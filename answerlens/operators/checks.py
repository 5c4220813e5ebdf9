"""Checks: what a judge is asked about an answer, and the mean of its repeated votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even
from answerlens.functions.text import sentences, strip_explanation

MOST_IN_A_REQUEST = 64


def expand(items: DataFrame, records: DataFrame) -> DataFrame:
    """(id, repeat, check_id, kind, target) of every answered record: its sentences, then what its type asks for."""
    keys = ["id", "repeat"]
    both = records.filter("status = 'answered'").select(*keys, "answer").join(items.select("id", "type", F.col("answer").alias("expected"), "must_include", "must_not", "scoring"), "id")
    check = lambda df, check_id, kind, target: df.select(*keys, check_id.alias("check_id"), F.lit(kind).alias("kind"), target.alias("target"))
    text = lambda c: F.col(c).cast("string")
    support = check(both.select(*keys, F.posexplode(sentences(F.col("answer"))).alias("i", "s")), F.concat(F.lit("s"), text("i")), "support", F.col("s"))
    value = check(both.filter("type = 'quant'"), F.lit("value"), "value", F.col("expected"))
    qual = both.filter("type = 'qual'")
    facts = qual.select(*keys, F.posexplode("must_include").alias("p", "point")).select(*keys, "p", F.posexplode("point.facts").alias("i", "fact"))
    fact = check(facts, F.concat(F.lit("f"), text("p"), F.lit("_"), text("i")), "fact", F.col("fact"))
    wrong = check(qual.select(*keys, F.posexplode("must_not").alias("i", "w")), F.concat(F.lit("m"), text("i")), "must_not", strip_explanation(F.col("w")))
    grade = check(both.filter("type NOT IN ('quant', 'qual')"), F.lit("grade"), "grade", F.to_json("scoring"))
    return support.unionByName(value).unionByName(fact).unionByName(wrong).unionByName(grade)


def requests(checks: DataFrame, most: int = MOST_IN_A_REQUEST) -> DataFrame:
    """With request: the number of the judge call of a record that a check goes in, `most` checks each."""
    order = Window.partitionBy("id", "repeat").orderBy("check_id")
    return checks.withColumn("request", F.floor((F.row_number().over(order) - 1) / most).cast("int"))


def votes_mean(votes: DataFrame) -> DataFrame:
    """Checks from votes (id, repeat, check_id, kind, target, vote, p, probabilities): a row per check.

    p: mean of the votes; grades have the mean probability of each choice, a missing one as 0, and the best choice, the
    lowest of equals. ps and choices keep single votes in their order.
    """
    keys = ["id", "repeat", "check_id"]
    yes = votes.filter("kind <> 'grade'").groupBy(*keys, "kind", "target").agg(half_even(F.avg("p")).alias("p"), F.sort_array(F.collect_list(F.struct("vote", half_even(F.col("p")).alias("p")))).alias("v"))
    yes = yes.select(*keys, "kind", "target", "p", F.transform("v", lambda x: x["p"]).alias("ps"))
    grades = votes.filter("kind = 'grade'").groupBy(*keys, "kind").agg(F.sort_array(F.collect_list(F.struct("vote", F.map_entries("probabilities").alias("d")))).alias("v"))
    names = F.sort_array(F.array_distinct(F.flatten(F.transform("v", lambda x: F.transform(x["d"], lambda e: e["key"])))))
    of = lambda x, k: F.coalesce(F.get(F.filter(x["d"], lambda e: e["key"] == k), F.lit(0))["value"], F.lit(0.0))
    mean = lambda k: half_even(F.aggregate("v", F.lit(0.0), lambda s, x: s + of(x, k)) / F.size("v"))
    grades = grades.withColumn("names", names).withColumn("probabilities", F.map_from_arrays("names", F.transform("names", mean)))
    grades = grades.select(*keys, "kind", "probabilities", best_choice(F.map_entries("probabilities")).alias("choice"), F.transform("v", lambda x: best_choice(x["d"])).alias("choices"))
    return yes.unionByName(grades, allowMissingColumns=True)


def best_choice(entries: Column) -> Column:
    """The key of the largest value, the lowest key of equals."""
    return F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))[0]["key"]


def majority(votes: DataFrame, by: list[str], choice: str = "choice") -> DataFrame:
    """(by, choice, votes, split): the most frequent choice (the least of equals), and whether votes differ."""
    counts = votes.filter(F.col(choice).isNotNull()).groupBy(*by, choice).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(choice, F.struct(-F.col("n"), F.col(choice))).alias(choice), F.sum("n").alias("votes"), (F.count("*") > 1).alias("split"))
