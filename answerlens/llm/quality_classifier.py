"""Quality classifier by positive-unlabelled learning.

Trusted positives are a bounded sample of documents of label 1; the unlabelled set is all web text without a label. No
negative label is used. An additive model over quantile bins of document statistics minimises the non-negative unbiased
risk pi R+_P + max(0, R-_U - pi R-_P) with the sigmoid loss. The class prior pi is estimated from positives and unlabelled
texts alone: above any threshold of a score, the share of unlabelled texts is at least pi times that of positives, so pi is
estimated as their ratio at the threshold with the smallest upper bound of it (best-bin estimation; each half of the
positives is graded by a score learnt from the other half). Labels are read only of ids whose crc32 mod 3 is not
1; scores depend on the text alone.

The statistics of each text are taken once and written; the sums over the unlabelled texts that each step of the descent
needs are made by the cluster over the bins of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import arrow_map, extended
from answerlens.storage import materialise
from answerlens.llm.textstats import NAMES, matrix, stats_map, taught, with_stats

BINS, ROUNDS, GUESS_ROUNDS, RATE, DECAY = 16, 60, 10, 0.05, 1e-4
#: Score bins and the confidence of bounds in the estimate of the prior.
GRADES, DELTA = 200, 0.1
SIZE = len(NAMES) * BINS
#: Fixed point of the sums, so that their order doesn't matter.
UNIT = 2.0**24
MOST_TASKS = 1000


@dataclass
class Additive:
    """Score of a text: sigmoid of the bias and one weight for the bin of each statistic."""

    edges: list[np.ndarray]
    weight: np.ndarray
    bias: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The bin of each statistic, numbered over all statistics."""
        return np.stack([np.searchsorted(e, x[:, j], side="left") + j * BINS for j, e in enumerate(self.edges)], axis=1)

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weight[cells].sum(axis=1), -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.of_cells(self.cells(x)) if len(x) else np.zeros(0)


#: Sums over texts, for a model: by cell the slopes s (1 - s) of the score s, then that of all, the scores, and the number of texts.
Sums = Callable[[Additive], np.ndarray]


def summed(model: Additive, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    s = model.of_cells(cells)
    slope = n * s * (1 - s)
    return np.concatenate([np.bincount(cells.ravel(), np.repeat(slope, cells.shape[1]), SIZE), [slope.sum(), (n * s).sum(), n.sum()]])


def descend(edges: list[np.ndarray], positive: Sums, unlabelled: Sums, prior: float, rounds: int, discern: bool = False) -> Additive:
    """Full-batch descent on the non-negative risk, or (discern) on the sigmoid loss of telling positives from unlabelled."""
    model = Additive(edges, np.zeros(SIZE), 0.0)
    first, second = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for step in range(1, rounds + 1):
        p, u = positive(model), unlabelled(model)
        grad = slope(p, u, prior, discern)
        grad[:-1] += DECAY * model.weight
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model.weight -= move[:-1]
        model.bias -= move[-1]
    return model


def slope(p: np.ndarray, u: np.ndarray, prior: float, discern: bool = False) -> np.ndarray:
    """The gradient of the risk (weights, then bias), from the sums over positives and over unlabelled texts."""
    dp, du = p[: SIZE + 1] / p[-1], u[: SIZE + 1] / u[-1]
    if discern:
        return du - dp
    if u[-2] / u[-1] - prior * p[-2] / p[-1] >= 0:  # the sigmoid loss of calling a text positive is its score
        return du - 2 * prior * dp
    return prior * dp - du  # the risk of negatives can't be below zero: only step back from it


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The non-negative risk, of the scores of positives and of unlabelled texts."""
    return prior * float((1 - positive).mean()) + max(0.0, float(unlabelled.mean()) - prior * float(positive.mean()))


def prior_of(edges: list[np.ndarray], p: np.ndarray, unlabelled: Sums, grades: Callable[[Additive], np.ndarray]) -> float:
    """The class prior, of the cells of positives and sums and grades of the unlabelled texts."""
    of_p, of_u = np.zeros(GRADES), np.zeros(GRADES)
    for half in (0, 1):
        a, b = p[half::2], p[1 - half :: 2]
        if len(a) and len(b):
            guess = descend(edges, lambda m: summed(m, a, np.ones(len(a))), unlabelled, 0.5, GUESS_ROUNDS, discern=True)  # noqa: B023
            of_p, of_u = of_p + graded(guess, b, np.ones(len(b))), of_u + grades(guess)
    return best_bin(of_p, of_u)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior, of numbers of positives and of unlabelled texts by grade of the score; one half without any."""
    if not positive.sum() or not unlabelled.sum():
        return 0.5
    p, u = np.cumsum(positive[::-1]) / positive.sum(), np.cumsum(unlabelled[::-1]) / unlabelled.sum()
    slack = sum(np.sqrt(np.log(4 / DELTA) / 2 / x.sum()) for x in (positive, unlabelled))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def graded(model: Additive, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((model.of_cells(cells) * GRADES).astype(np.int64), GRADES - 1), n, GRADES)


def constant(prior: float) -> Additive:
    return Additive([np.zeros(0)] * len(NAMES), np.zeros(SIZE), float(np.log(prior / (1 - prior))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Additive:
    """A model of texts in memory; deterministic. Without positives or unlabelled texts every score is the prior (or one half)."""
    if not len(positive) or not len(unlabelled):
        return constant(prior or 0.5)
    probs = np.arange(1, BINS) / BINS
    edges = [np.unique(np.quantile(unlabelled[:, j], probs, method="lower")) for j in range(len(NAMES))]
    cells = constant(0.5)
    cells.edges = edges
    p, u = cells.cells(positive), cells.cells(unlabelled)
    one, many = np.ones(len(p)), np.ones(len(u))
    own, other = lambda m: summed(m, p, one), lambda m: summed(m, u, many)
    if prior is None:
        prior = prior_of(edges, p, other, lambda m: graded(m, u, many))
    return descend(edges, own, other, prior, ROUNDS)


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, stats) of all documents, written: the only pass over the texts."""
    found, name = with_stats(documents.select("doc_id", text), text, keep=("doc_id",))
    return materialise(found.withColumnRenamed(name, "stats"), "statistics")


def learn(known: DataFrame, labels: DataFrame, trusted: int = 20_000) -> tuple[Additive, float]:
    """The model and the prior, from statistics() of all documents.

    Positives are at most `trusted` documents of label 1 that taught() allows, first in the order of a hash of the id; an id
    with several texts counts with the least statistics. Unlabelled are all documents without a label; all documents if each
    has one.
    """
    said = labels.filter("doc_id IS NOT NULL")
    ids = said.filter(F.col("quality").isNotNull() & taught("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("y")).filter("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).select("doc_id")
    positive = matrix(known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats")).orderBy("doc_id").select("stats"))
    web = known.join(said.select("doc_id").distinct(), "doc_id", "left_anti").select("stats")
    probs = [k / BINS for k in range(1, BINS)]
    for texts in (web, known.select("stats")):
        row = texts.agg(*[F.percentile_approx(F.col("stats")[j], probs, 2000) for j in range(len(NAMES))]).first()
        if row[0] is not None:
            break
    if not len(positive) or row[0] is None:
        return constant(0.5), 0.5
    cells = constant(0.5)
    cells.edges = [np.unique(np.array(x)) for x in row]
    bins = binned(texts, cells)
    p = cells.cells(positive)
    one = np.ones(len(p))
    own, other = lambda m: summed(m, p, one), lambda m: over(bins, m, summed, SIZE + 3)
    prior = prior_of(cells.edges, p, other, lambda m: over(bins, m, graded, GRADES))
    return descend(cells.edges, own, other, prior, ROUNDS), prior


def binned(texts: DataFrame, model: Additive) -> DataFrame:
    """(cells, n): the bins of the statistics, one byte each, and the texts that have them; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            own = (model.cells(x) - np.arange(len(NAMES)) * BINS).astype(np.uint8)
            yield pa.record_batch([pa.array([r.tobytes() for r in own], pa.binary())], names=["cells"])

    return materialise(arrow_map(texts, run, "cells binary").groupBy("cells").agg(F.count("*").alias("n")), "bins")


def over(bins: DataFrame, model: Additive, sums: Callable[[Additive, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """sums() over all rows of binned(): one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(NAMES))
            if len(raw):
                total += sums(model, raw + np.arange(len(NAMES)) * BINS, batch.column(1).to_numpy().astype(np.float64))
        yield pa.record_batch([pa.array([np.rint(total * UNIT).astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["units"])

    told = arrow_map(bins, run, "units array<long>")
    if bins.rdd.getNumPartitions() > MOST_TASKS:  # the driver gets a bounded number of rows
        told = told.select(F.posexplode("units").alias("cell", "units")).groupBy("cell").agg(F.sum("units").alias("units")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "units"))), lambda x: x.units).alias("units"))
    return np.sum([r.units for r in told.collect()], axis=0, dtype=np.int64) / UNIT


def train(documents: DataFrame, labels: DataFrame, trusted: int = 20_000) -> Additive:
    """A model from at most `trusted` labelled positives and all unlabelled documents."""
    return learn(statistics(documents), labels, trusted)[0]


def quality_scores(df: DataFrame, model: Additive, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input row: its columns (or `keep`), then score and predicted; names that are taken get underscores.

    Null and empty texts are scored as texts without words. Equal texts have equal scores. Empty table: empty result.
    """
    return stats_map(df, text, keep, [("score", "double"), ("predicted", "int")], lambda x: said(model, x))


def said(model: Additive, x: np.ndarray) -> list[pa.Array]:
    score = model.score(x)
    return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]


def classifier_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); the texts are read once."""
    known = statistics(documents)
    model, _ = learn(known, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *said(model, x)], names=["doc_id", "score", "predicted"])

    scored = arrow_map(known, run, extended(known.select("doc_id"), ("score", "double"), ("predicted", "int")))
    return scored.select("doc_id", (~taught("doc_id")).alias("held_out"), "score", "predicted")
