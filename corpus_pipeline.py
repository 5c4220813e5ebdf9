"""Corpus pipeline: documents to token ids, in five stages.

Each stage takes the documents its predecessor kept and returns a DataFrame with the columns of documents (the last one:
token ids instead of the text). run() writes each stage's result to the shared folder and reads it again, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.decontaminate import contaminated, decontaminate
from answerlens.llm.line_dedup import line_dedup
from answerlens.llm.quality_rules import quality_rules, train
from answerlens.llm.sentencepieces import Pieces, encode
from answerlens.llm.simhash_similar import similar_dedup
from answerlens.storage import materialise


def with_text(out: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents, with another column's text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; nulls and empty texts go."""
    out = quality_rules(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.filter(F.col(out.columns[-1])).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut; a document that consists of such runs alone goes."""
    out = line_dedup(docs)
    n_lines, removed, kept = out.columns[-3:]
    return with_text(out.filter((F.col(removed) == 0) | (F.col(removed) < F.col(n_lines))), docs.columns, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more of five-word shingles): that of the smallest doc_id."""
    return similar_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of benchmark words go; from others the benchmark's stretches are cut."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_words, n_hit, _, clean = out.columns[-4:]
    return with_text(out.filter(~contaminated(F.col(n_words), F.col(n_hit))), docs.columns, clean)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to its text, and its other columns but the text."""
    out = encode(docs, Pieces.load(), decoded=True)
    same = F.col(out.columns[-1]).eqNullSafe(F.col("text")).alias("decodes")
    return out.select(*[c for c in out.columns[:-1] if c != "text"], same)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: Trained trees, XXH64 and the encoder have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
