"""Drafts of gold items: samples spread over a corpus, and mechanical checks of what a model wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.numbers import perturb
from answerlens.functions.text import holds, squeezed, word_overlap
from answerlens.operators.evidence import quote_hits
from answerlens.storage import materialise

BATCH = 8


def mixed(seed: int, *keys: str) -> Column:
    """A fixed random order: MD5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified(df: DataFrame, k: int, order: str, key: str, seed: int = 0) -> DataFrame:
    """df with stratum and pick: rows in `order` fall into k equal spans, and picks go round them, one row each.

    Span i ends at round(i n / k), ties to even. Positions come from counts per range of the order, so no task sorts all
    rows: see numbered().
    """
    rows = numbered(df, order, "__at")
    n = df.count()
    k = max(1, min(k, n))
    i = F.floor((F.col("__at") - 1) * k / n)  # the span or a neighbour of it
    end = lambda j: F.bround(j * n / F.lit(float(k)), 0)
    stratum = F.when(F.col("__at") > end(i + 1), i + 1).when(F.col("__at") <= end(i), i - 1).otherwise(i)
    spread = turns(rows.withColumn("stratum", stratum.cast("int")), "stratum", key, seed)
    return spread.withColumn("__pair", F.struct("__turn", "stratum")).transform(lambda x: numbered(x, "__pair", "pick")).drop("__at", "__turn", "__pair")


def round_robin(df: DataFrame, by: str, key: str, seed: int = 0) -> DataFrame:
    """df with pick: groups in order take turns, each in its own mixed order."""
    spread = turns(df, by, key, seed).withColumn("__pair", F.struct("__turn", by))
    return numbered(spread, "__pair", "pick").drop("__pair", "__turn")


def turns(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """df with __turn: the place from 1 of a row in its group, in a mixed order; a large group is not one task's."""
    placed = numbered(df.withColumn("__mixed", F.struct(F.col(by).alias("a"), mixed(seed, key).alias("m"), F.col(key).alias("b"))), "__mixed", "__place")
    first = placed.groupBy(by).agg(F.min("__place").alias("__first")).withColumnRenamed(by, "__by")
    return placed.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__turn", F.col("__place") - F.col("__first") + 1).drop("__mixed", "__place", "__first", "__by")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its positions from 1 in `order`, without one task for all rows.

    Rows are dealt by range and sorted within it; a range's first position is the count of rows before it.
    """
    place = {"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)}
    # Written, so that both uses below see the same ranges.
    ranged = materialise(df.repartitionByRange(order).sortWithinPartitions(order).withColumns(place), "ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__in") + 1).cast("long")).drop("__part", "__in", "__before")


def first_rejection(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that is true, else null."""
    out = F.lit(None).cast("string")
    for test, reason in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(True)), reason).otherwise(out)
    return out


def blank(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) == "")
    return out


def check_quant(drafts: DataFrame, text: str = "text") -> DataFrame:
    """Drafts (skip, question_literal, question_user, answer, quote, text) with reason: why one is refused, or null."""
    source = F.col(text)
    return drafts.withColumn("reason", first_rejection(
        (F.coalesce(F.col("skip"), F.lit("")) != "", "skipped"),
        (blank("question_literal", "question_user", "answer", "quote"), "missing field"),
        (~holds(source, F.col("quote")), "quote not in source"),
        (~holds(F.col("quote"), F.col("answer")), "answer not in quote"),
        (holds(source, F.col("question_literal")), "question copied from source"),
    ))


def check_titled(drafts: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """The chain for titled pages: quotes in one style, and a user's question that doesn't reuse the title."""
    inside = lambda a, b: holds(F.col(a), F.col(b), quotes=True)
    return drafts.withColumn("reason", first_rejection(
        (blank("question_literal", "question_user", "answer", "quote"), "missing field"),
        (~inside(text, "quote"), "quote not in source"),
        (~inside("quote", "answer"), "answer not in quote"),
        (inside("question_user", title), "question holds the title"),
        (word_overlap(F.col(title), F.col("question_user")) >= 0.5, "question reuses the title"),
    ))


def with_traps(quant: DataFrame, text: str = "text") -> DataFrame:
    """quant with wrong and token: the answer made wrong, and what was changed."""
    p = perturb(F.col("answer"), F.col(text))
    return quant.withColumn("__p", p).withColumns({"wrong": F.col("__p.wrong"), "token": F.col("__p.token")}).drop("__p").filter("wrong IS NOT NULL")


def check_trap(drafts: DataFrame) -> DataFrame:
    """Drafts (question, token, answer): the wrong value must be in the question, the right one must not."""
    return drafts.withColumn("reason", first_rejection((~holds(F.col("question"), F.col("token")), "wrong value not in question"), (holds(F.col("question"), F.col("answer")), "right answer in question")))


def check_qual(drafts: DataFrame, text: str = "text") -> DataFrame:
    """Drafts (skip, question, must_include of (point, quote)): points whose quote is in the text stay, two at least."""
    full = F.filter("must_include", lambda p: (F.trim(F.coalesce(p["point"], F.lit(""))) != "") & (F.trim(F.coalesce(p["quote"], F.lit(""))) != ""))
    found = lambda p: holds(F.col(text), p["quote"])
    out = drafts.withColumn("__full", full).withColumns({"must_include": F.filter("__full", found), "dropped_points": F.filter("__full", lambda p: ~found(p))})
    return out.drop("__full").withColumn("reason", first_rejection((F.coalesce(F.col("skip"), F.lit("")) != "", "skipped"), (blank("question") | (F.size("must_include") < 2), "fewer than two points found in the source")))


def absent_keywords(candidates: DataFrame, texts: DataFrame, key: str, keywords: str = "keywords", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Candidates (key, keywords) none of whose keywords stands in any text.

    Distinct keywords are looked for by quote_hits, in blocks of a measured size: their number isn't bounded.
    """
    words = candidates.select(key, F.explode(keywords).alias("w")).select(key, squeezed(F.col("w")).alias("w")).filter("w <> ''")
    distinct = materialise(words.select("w").distinct().select(F.monotonically_increasing_id().alias("q"), "w"), "keywords")
    hits = quote_hits(texts.select(F.lit(0).alias("d"), F.col(text).alias("t")), distinct, "d", "t", "q", "w", block_bytes)
    seen = distinct.join(hits.select("q").distinct(), "q", "left_semi").select("w")
    hit = words.join(seen, "w").select(key).distinct()
    return candidates.filter(F.size(keywords) > 0).join(hit, key, "left_anti")


def capped(rows: DataFrame, order: str, flag: Column, most: int) -> DataFrame:
    """Rows without those flagged ones that come after `most` flagged ones."""
    flagged = numbered(rows.filter(flag), order, "__nth").filter(F.col("__nth") <= most).drop("__nth")
    return rows.filter(~flag).unionByName(flagged)


def first_passing(rows: DataFrame, order: str, passing: Column, n: int) -> DataFrame:
    """The first n rows that pass."""
    return rows.filter(passing).orderBy(order).limit(n)


def batches_needed(rows: DataFrame, order: str, passing: Column, n: int, size: int = BATCH) -> DataFrame:
    """Rows that are looked at when candidates go in batches of `size` and stop after the batch with the nth pass."""
    at = numbered(rows.withColumn("__pass", passing.cast("int")), order, "__at").withColumn("__batch", F.floor((F.col("__at") - 1) / size))
    per = at.groupBy("__batch").agg(F.sum("__pass").alias("__got"))
    before = per.withColumn("__before", F.coalesce(F.sum("__got").over(Window.orderBy("__batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return at.join(before.filter(F.col("__before") < n).select("__batch"), "__batch").drop("__at", "__batch", "__pass")
