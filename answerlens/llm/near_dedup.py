"""Near-duplicate removal by the exact Jaccard similarity of word shingles.

No query uses the MinHash below: the pipeline's stage finds its candidates by SimHash (simhash_similar) and shares the exact
comparison.

MinHash only finds candidates: the minima of BANDS * ROWS hash orders are cut into bands, and texts that agree in all rows
of a band are candidates. Two texts of similarity s share no band with a chance of (1 - s**ROWS)**BANDS, which is 1.3e-7 at
0.8 and less above. Candidates make clusters; the texts of a cluster meet in one task, which compares their whole sets of
shingles (as 64-bit hashes) and emits a spanning forest of the links, never all pairs. A text goes out once at most,
however many bands it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlens.llm.shared import HashCache, arrow_map, as_bytes, mix, rolling
from answerlens.storage import materialise
from answerlens.llm.simhash import components, firsts, grouped

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, SEED = 40, 5, 11
ORDERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int, cache: HashCache) -> np.ndarray:
    """The sorted distinct hashes of all word shingles of a text (UTF-8; A-Z lower-cased); of all its words if they are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return np.unique(rolling(h, min(shingle, len(words)), 0x9E3779B97F4A7C55))


def bands(shingle_set: np.ndarray) -> np.ndarray:
    """One value a band; texts without words have the same in all."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 512):
        np.minimum(least, (ORDERS[:, None] * shingle_set[at : at + 512]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key ^ rows[:, j])
    return key.view(np.int64)


def signed(df: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, bands) of (doc_id, text): fp is a hash of the whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(SEED)
        for batch in batches:
            sets = [shingles(t, shingle, cache) for t in as_bytes(batch.column(1))]
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = np.concatenate([np.zeros(0, np.int64), *map(bands, sets)])
            ends = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
            yield pa.record_batch([batch.column(0), pa.array(prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names=["doc_id", "fp", "bands"])

    return arrow_map(df, run, "doc_id long, fp long, bands array<long>")


def forest(sets: list[np.ndarray], similar: float) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the graph 'Jaccard similarity of `similar` or more'."""
    size = np.array([len(s) for s in sets])
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(term, kind="stable")]
    ends = np.cumsum(np.bincount(term))
    starts = np.concatenate([[0], ends[:-1]])
    own = np.concatenate([[0], np.cumsum(size)])
    left = np.ones(len(sets), bool)
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            p = queue.pop()
            mine = term[own[p] : own[p + 1]]
            n = ends[mine] - starts[mine]
            shared = np.bincount(holders[np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            near = np.flatnonzero(left & (shared / np.maximum(size + size[p] - shared, 1) >= similar)).tolist()
            left[near] = False
            yield from ((p, q) for q in near)
            queue += near


def verified(rows: DataFrame, clusters: DataFrame, shingle: int, similar: float) -> DataFrame:
    """(a, b): links within the clusters (node, root) between texts that are similar enough; rows: (doc_id, text)."""
    met = rows.join(clusters, rows.doc_id == clusters.node).select("root", "doc_id", "text").repartition("root").sortWithinPartitions("root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(SEED)
        now, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            found = list(forest(sets, similar)) if len(sets) > 1 else []
            return pa.record_batch([pa.array([ids[x[i]] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for root, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                if root != now:
                    yield out()
                    now, ids, sets = root, [], []
                ids.append(d)
                sets.append(shingles(t, shingle, cache))
        yield out()

    return arrow_map(met, run, "a long, b long").filter("a <> b").distinct()


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, fp, component_id) per input row; fp is a hash of the set of shingles.

    Texts whose sets of shingles have a Jaccard similarity of `similar` or more are linked; component_id is the smallest
    doc_id reachable. `similar` below 0.8 misses more candidates (see above). Null or empty text: the empty set, linked to
    its like alone. Null and repeated doc_ids and empty tables: as in simhash_groups.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def link(nodes: DataFrame) -> DataFrame:
        dealt = nodes.select(F.explode("bands").alias("band"), "rep")
        star = dealt.select(F.col("rep").alias("a"), F.min("rep").over(Window.partitionBy("band")).alias("b"))
        found = components(star)
        clusters = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        return verified(rows, clusters, shingle, similar)

    return grouped(materialise(signed(rows, shingle), "bands"), link, F.first("bands").alias("bands"))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The rows of df whose doc_id is the smallest of its component, one row for each such doc_id (the least by value).

    Rows without doc_id stay, all of them.
    """
    return firsts(df, near_groups(df, doc_id, text, shingle, similar), doc_id)
