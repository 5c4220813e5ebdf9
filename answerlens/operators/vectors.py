"""Cosine nearest neighbours, exact.

Questions are scored against chunks in Arrow batches, a tile of questions by one matrix product each. A task keeps the best
k of all its batches, so no more than k rows a question leave it; a window ranks what is left. Questions go out in blocks of
a checked number, one pass over the chunks for each, so a broadcast never exceeds a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions of a broadcast, and of a matrix product.
BLOCK, TILE = 4096, 256


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in the JVM: for small tables and single pairs."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit(rows: list | np.ndarray) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def nearest(questions: DataFrame, chunks: DataFrame, k: int, question_id: str = "question_id", chunk_id: str = "chunk_id", vector: str = "embedding", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(question_id, ref, chunk_id, score): the k chunks of the highest cosine for every question, ref from 1.

    Scores are rounded to `digits` before ranking and ties go to the smaller id, so ranks don't depend on how chunks are
    dealt out. Rows without id or vector take no part. exclude_self drops pairs of equal ids.
    """
    rows = questions.select(F.col(question_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("q IS NOT NULL AND v IS NOT NULL")
    pool = chunks.select(F.col(chunk_id).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v")).filter("c IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    found = None
    for block in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        scored = _score(part.toArrow(), pool, k, digits, exclude_self)
        found = scored if found is None else found.unionByName(scored)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.withColumn("ref", F.row_number().over(order)).filter(F.col("ref") <= k).select(F.col("q").alias(question_id), "ref", F.col("c").alias(chunk_id), "score")


def _keep_best(best: np.ndarray, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Puts the best of old and new scores into best and who, a row each, equal scores by the smaller id.

    Only scores that reach the k-th are sorted.
    """
    k = best.shape[1]
    both = np.concatenate([best, scores], axis=1)
    least = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
    row, at = np.nonzero((both >= least[:, None]) & (both > -np.inf))
    score = both[row, at]
    old = at < k
    chunk = np.where(old, who[row, np.where(old, at, 0)], ids[np.where(old, 0, at - k)])
    order = np.lexsort((chunk, -score, row))
    row, score, chunk = row[order], score[order], chunk[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    best[row[kept], place[kept]], who[row[kept], place[kept]] = score[kept], chunk[kept]


def _score(part: pa.Table, pool: DataFrame, k: int, digits: int, exclude_self: bool) -> DataFrame:
    ids = part.column("q").to_numpy()
    matrix = unit(np.array(part.column("v").to_pylist(), np.float64).reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))
    shared = pool.sparkSession.sparkContext.broadcast((ids, matrix))
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, m = shared.value
        best, who = np.full((len(asked), k), -np.inf), np.full((len(asked), k), none)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            columns = unit(_matrix(batch.column(1))).T
            for start in range(0, len(asked), TILE):
                tile = slice(start, start + TILE)
                scores = np.round(m[tile] @ columns, digits) + 0.0
                if exclude_self:
                    scores[asked[tile, None] == c[None, :]] = -np.inf
                _keep_best(best[tile], who[tile], scores, c)
        q, place = np.nonzero(best > -np.inf)
        for start in range(0, len(q), 1 << 16):
            rows, at = q[start : start + (1 << 16)], place[start : start + (1 << 16)]
            yield pa.record_batch([pa.array(asked[rows]), pa.array(who[rows, at]), pa.array(best[rows, at])], names=["q", "c", "score"])

    return pool.mapInArrow(run, "q long, c long, score double")


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame, index_version: str, k: int) -> DataFrame:
    """Hits of every question in one index version: ranked chunks with their content and their documents' titles."""
    pool = chunks.filter(F.col("index_version") == index_version)
    ranked = nearest(questions, pool, k)
    hits = ranked.join(pool.drop("embedding"), "chunk_id").join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
    return hits.select("question_id", "ref", "chunk_id", "document_id", "title", "content", "page_start", "page_end", "score", F.col("meta.printed_page").alias("printed_page"), F.col("meta.heading").alias("heading"))


def hit_list(hits: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, retrieved): the hits of a question as an array in order of ref."""
    fields = ["ref", "chunk_id", "document_id", "title", "content", "page_start", "page_end", "score", "printed_page", "heading"]
    return hits.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("retrieved"))


def gate(questions: DataFrame, ranked: DataFrame, min_score: float, question_id: str = "question_id") -> DataFrame:
    """(question_id, top_score, status): insufficient_context without hits or with a best score under min_score."""
    top = ranked.filter("ref = 1").select(question_id, F.col("score").alias("top_score"))
    poor = F.col("top_score").isNull() | (F.col("top_score") < min_score)
    return questions.select(question_id).join(top, question_id, "left").withColumn("status", F.when(poor, "insufficient_context").otherwise("open"))
