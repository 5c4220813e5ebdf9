"""Gold sets: validation, duplicates, approval and the documents they rest on."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("approved", "draft", "rejected")
NEGATIVE_TYPES = ("unanswerable", "partial", "false_premise", "confusion", "temporal")


def evidence_errors(evidence: Column, where: str) -> Column:
    """Messages for no evidence at all, and for each without document, or without page and quote."""
    poor = lambda e: (F.coalesce(e["document_id"], F.lit("")) == "") | (e["page"].isNull() & (F.coalesce(e["quote"], F.lit("")) == ""))
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, F.array(F.lit(f"{where}no evidence"))).otherwise(F.transform(F.filter(evidence, poor), lambda e: F.lit(f"{where}evidence needs document_id and page or quote")))


def validate(items: DataFrame) -> DataFrame:
    """items with errors: an array of messages, empty for a valid item."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    some = lambda *tests: F.filter(F.array(*[F.when(t, message) for t, message in tests]), lambda e: e.isNotNull())
    common = some(*[(blank(c), f"no {c}") for c in ("id", "type", "question", "status", "provenance")], (~blank("status") & ~F.col("status").isin(*STATUSES), "unknown status"))
    quant = F.concat(some((blank("answer"), "no answer")), evidence_errors(F.col("evidence"), ""))
    points = F.flatten(F.transform("must_include", lambda p: F.concat(F.when(F.coalesce(F.size(p["facts"]), F.lit(0)) <= 0, F.array(F.lit("point without facts"))).otherwise(F.array().cast("array<string>")), evidence_errors(p["evidence"], "point: "))))
    qual = F.when(size("must_include") <= 0, F.array(F.lit("no must_include"))).otherwise(points)
    keys = F.coalesce(F.map_keys("scoring"), F.array().cast("array<string>"))
    full = F.array_contains(keys, "2") & F.array_contains(keys, "0") & (F.size(F.array_except(keys, F.array(*map(F.lit, "210")))) == 0)
    negative = some((~full, "scoring needs 2 and 0, and 1 at most besides"), (~F.coalesce(F.col("expected_status").isin("answered", "insufficient_context"), F.lit(False)), "no expected_status"))
    kind = F.col("type")
    errors = F.concat(common, F.when(kind == "quant", quant).when(kind == "qual", qual).when(kind.isin(*NEGATIVE_TYPES), negative).otherwise(F.array(F.lit("unknown type"))))
    return items.withColumn("errors", errors)


def duplicates(items: DataFrame) -> DataFrame:
    """(id, n) of ids that occur more than once."""
    return items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def approved(items: DataFrame) -> DataFrame:
    return items.filter("status = 'approved'")


def skipped(items: DataFrame) -> DataFrame:
    """One row: how many items aren't approved."""
    return items.agg(F.count_if(~F.col("status").eqNullSafe("approved")).alias("skipped"))


def document_problems(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, problem) of gold documents (id, sha256) that the catalog lacks or holds with another hash."""
    both = wanted.join(documents.select("id", "content_hash"), "id", "left")
    problem = F.when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") != F.col("sha256"), "changed")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("id", "problem")


def gold_hash(manifest: bytes, files: list[bytes]) -> str:
    """First 12 hex digits of SHA-256 over the manifest and then each file."""
    digest = hashlib.sha256(manifest)
    for data in files:
        digest.update(data)
    return digest.hexdigest()[:12]
