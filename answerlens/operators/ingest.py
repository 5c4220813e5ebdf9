"""Idempotent, versioned ingestion into two parquet tables, documents and chunks (partitioned by index_version)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from answerlens.schemas import CHUNKS, DOCUMENTS


def plan(files: DataFrame, documents: DataFrame, chunks: DataFrame, version: str, force: bool = False) -> DataFrame:
    """files (document_id, kind, content_hash) with status: unsupported, skipped, replaced or ingested.

    skipped: known by the same hash, with chunks of this version, and not forced. replaced: the hash changed. All else is
    ingested: new files, new index versions, forced ones.
    """
    known = documents.select(F.col("id").alias("document_id"), F.col("content_hash").alias("old_hash"))
    counts = chunks.filter(F.col("index_version") == version).groupBy("document_id").agg(F.count("*").alias("old_chunks"))
    both = files.join(known, "document_id", "left").join(counts, "document_id", "left")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    status = F.when(F.col("kind").isNull(), "unsupported").when(same & (F.coalesce("old_chunks", F.lit(0)) > 0) & F.lit(not force), "skipped").when(F.col("old_hash").isNotNull() & ~same, "replaced").otherwise("ingested")
    return both.withColumn("status", status)


def upserted(documents: DataFrame, new: DataFrame) -> DataFrame:
    """documents with the rows of new in place of those of the same id."""
    return documents.join(new.select("id"), "id", "left_anti").unionByName(new)


def merged_chunks(chunks: DataFrame, planned: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """chunks without those that planned files replace, and the new ones.

    A replaced or new document loses its chunks of all versions; one with the same hash only those of this version.
    """
    work = planned.filter(F.col("status").isin("ingested", "replaced"))
    changed = work.filter(~F.col("old_hash").eqNullSafe(F.col("content_hash"))).select("document_id")
    again = work.filter(F.col("old_hash").eqNullSafe(F.col("content_hash"))).select("document_id", F.lit(version).alias("index_version"))
    kept = chunks.join(changed, "document_id", "left_anti").join(again, ["document_id", "index_version"], "left_anti")
    return kept.unionByName(new)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: what a unique constraint would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents that don't exist: what a foreign key would delete."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


@dataclass
class Catalog:
    """The two tables under one root. A commit writes new copies, then one small pointer names them.

    Readers see one generation or the other, never a mixture, and a failed job leaves the old one in place.
    """

    spark: SparkSession
    root: str

    def _pointer(self) -> int:
        try:
            return self.spark.read.schema("generation int").json(f"{self.root}/current").agg(F.max("generation")).first()[0] or 0
        except AnalysisException:
            return 0

    def _read(self, name: str, schema: str) -> DataFrame:
        generation = self._pointer()
        if not generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{generation}")

    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def commit(self, documents: DataFrame, chunks: DataFrame) -> int:
        generation = self._pointer() + 1
        documents.write.mode("overwrite").parquet(f"{self.root}/documents/{generation}")
        chunks.write.mode("overwrite").partitionBy("index_version").parquet(f"{self.root}/chunks/{generation}")
        self.spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("append").json(f"{self.root}/current")
        return generation

    def count(self, version: str) -> int:
        """Chunks of a version; reads that partition alone."""
        return self.chunks().filter(F.col("index_version") == version).count()
