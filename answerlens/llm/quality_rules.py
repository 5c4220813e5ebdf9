"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled documents (`sample` rows), on quantile histograms,
with monotonic constraints: more symbols, repeated lines, repeated passages or capitals never raise a score. They are
flattened into numpy arrays of nodes, one row a tree, and score a whole batch level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from answerlens.llm.textstats import NAMES, labelled_sample, stats_map

#: -1: the score never rises with the statistic
MONOTONIC = {"symbols_a_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "top_word": -1}
MIN_WORDS, MOST_REPEATED = 20, 30
TREES, DEPTH, RATE, BINS, LAMBDA = 60, 3, 0.2, 48, 1.0


@dataclass
class Forest:
    """Node arrays of shape (trees, 2**depth - 1), leaves of shape (trees, 2**depth)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        if not len(x) or not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.leaf))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        total = self.base + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, signs: np.ndarray | None = None) -> Forest:
    """Boosted trees for the logistic loss; signs: per feature -1, 0 or 1 for a falling, free or rising score."""
    n, width = x.shape if len(x) else (0, len(NAMES))
    inner = 2**depth - 1
    share = (y.sum() + 1) / (n + 2)
    model = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return model
    signs = np.zeros(width, np.int64) if signs is None else signs
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(width) * BINS
    margin = np.full(n, model.base)
    kept = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        members, low, high = {0: np.arange(n)}, {0: -np.inf}, {0: np.inf}
        for node in range(inner):
            rows = members[node]
            lo, hi = low[node], high[node]
            cut = best_split(flat[rows], g[rows], h[rows], width, signs, lo, hi, edges) if len(rows) > 20 else None
            left, right = 2 * node + 1, 2 * node + 2
            goes = np.ones(len(rows), bool)
            bounds = (lo, hi, lo, hi)
            if cut:
                feature[node], at, middle = cut
                threshold[node] = edges[feature[node]][at]
                goes = binned[rows, feature[node]] <= at
                sign = signs[feature[node]]
                bounds = (lo, middle, middle, hi) if sign > 0 else (middle, hi, lo, middle) if sign < 0 else bounds
            members[left], members[right] = rows[goes], rows[~goes]
            low[left], high[left], low[right], high[right] = bounds
        for k in range(inner + 1):
            rows = members[inner + k]
            if len(rows):
                leaf[k] = rate * np.clip(-g[rows].sum() / (h[rows].sum() + LAMBDA), low[inner + k], high[inner + k])
                margin[rows] += leaf[k]
        kept.append((feature, threshold, leaf))
    return Forest(model.base, *(np.stack([t[i] for t in kept]) for i in range(3)))


def best_split(flat: np.ndarray, g: np.ndarray, h: np.ndarray, width: int, signs: np.ndarray, low: float, high: float, edges: list[np.ndarray]) -> tuple[int, int, float] | None:
    """(feature, bin, middle of the children's values) of the largest gain that keeps the constraints."""
    size = width * BINS
    sum_g = np.bincount(flat.ravel(), np.repeat(g, width), size).reshape(width, BINS)
    sum_h = np.bincount(flat.ravel(), np.repeat(h, width), size).reshape(width, BINS)
    gl, hl = sum_g.cumsum(axis=1)[:, :-1], sum_h.cumsum(axis=1)[:, :-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    vl, vr = np.clip(-gl / (hl + LAMBDA), low, high), np.clip(-gr / (hr + LAMBDA), low, high)
    loss = lambda s, t, v: s * v + 0.5 * (t + LAMBDA) * v * v
    v = np.clip(-g.sum() / (h.sum() + LAMBDA), low, high)
    gain = loss(g.sum(), h.sum(), v) - loss(gl, hl, vl) - loss(gr, hr, vr)
    real = np.arange(BINS - 1)[None, :] < np.array([len(e) for e in edges])[:, None]
    gain[~real | (hl < 1e-3) | (hr < 1e-3) | (signs[:, None] * (vr - vl) < 0)] = -np.inf
    k = int(np.argmax(gain))
    f, at = divmod(k, BINS - 1)
    return (f, at, float((vl[f, at] + vr[f, at]) / 2)) if gain[f, at] > 1e-6 else None


def train(documents: DataFrame, labels: DataFrame, sample: int = 20_000) -> Forest:
    """Trees from at most `sample` labelled documents."""
    signs = np.array([MONOTONIC.get(name, 0) for name in NAMES])
    return grow(*labelled_sample(documents, labels, "quality", sample), signs=signs)


def quality_rules(df: DataFrame, model: Forest, text: str = "text", least: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per input row: its columns (or `keep`), then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, quality_score, kept; names that are taken get underscores.

    Words are runs of anything but ASCII white space. base_failed: fewer than 20 words, or more than 30 in 100 words in
    8-word windows that the text holds twice or more. kept: not base_failed and a score of `least` or more. Null and
    empty texts have no words and fail. Repeated rows are judged alike; an empty table gives an empty result. A model
    from no labels, or from labels of one kind, scores all texts alike.
    """
    fields = [*((n, "long") for n in NAMES[:5]), ("base_failed", "boolean"), ("quality_score", "double"), ("kept", "boolean")]

    def judged(x: np.ndarray) -> list[pa.Array]:
        failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > MOST_REPEATED * x[:, 0])
        score = model.score(x)
        return [*(pa.array(x[:, j].astype(np.int64)) for j in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))]

    return stats_map(df, text, keep, fields, judged)
