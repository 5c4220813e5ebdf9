"""Near-duplicate removal at a Jaccard similarity: SimHash, covering tables, Hamming radius, exact check.

The fingerprint is a SimHash of the set of a text's word shingles, wide enough for sets that share four fifths, which differ
in 15 % of its bits: WORDS words of WORD_BITS bits for the tables, and CHECK_BITS further bits. The tables are simhash's
covering masks, of radius WORD_RADIUS for each word: two texts whose words differ in fewer than WORDS * (WORD_RADIUS + 1)
bits in all have a word within that radius, so they meet in a table, always. Texts that meet are candidates if their
check bits differ in CHECK_RADIUS or fewer. A fingerprint goes out three times a word, not seven: tables that keep some bits in
common go together, to the task of these bits, which makes the buckets of each.

Candidates make clusters; the texts of a cluster meet in one task, which compares their whole sets of shingles, so a link
is never wrong. By calculation, one is missed with a chance of 5e-7 at a similarity of exactly 0.8 (3e-7 that the pair
meets nowhere, 2e-7 that the check bits differ in more; each bit differs with 0.1516) and of less above. Sets of 4 and 5
shingles, whose bits differ with 0.1875, are the worst: 3e-4.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.near_dedup import SEED, SHINGLE, SIMILAR, shingles, verified
from answerlens.llm.shared import HashCache, arrow_map, as_bytes, mix
from answerlens.llm.simhash import MOST_IDS, components, firsts, grouped, masks
from answerlens.storage import materialise

WORDS, WORD_BITS, WORD_RADIUS = 28, 24, 2
CHECK_BITS, CHECK_RADIUS = 160, 49
PRINT_BYTES = (WORDS * WORD_BITS + CHECK_BITS) // 8
#: Bucket sizes up to which all pairs are compared, rows and pairs of a large bucket compared at once, fingerprints dealt at once.
SMALL, TILE, PAIRS, DEALT = 32, 64, 1 << 20, 512
#: Tables (from 1, of the seven of a word) that go together: 1, 3, 5 and 7 keep 4 bits in common, 2 and 6 keep 8. So a task holds
#: a sixteenth of all fingerprints at once; where there are more than MOST_TOGETHER, each table goes by itself.
TOGETHER, ALONE = ((1, 3, 5, 7), (2, 6), (4,)), tuple((t,) for t in range(1, 2 ** (WORD_RADIUS + 1)))
MOST_TOGETHER = 1 << 24
#: Links that a task holds before it reduces them to a forest.
HELD_LINKS = 1 << 19
SALTS = np.arange(1, PRINT_BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Each byte with its bits in eight bytes, so that 255 rows are counted by plain sums.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def wide_print(shingle_set: np.ndarray) -> bytes:
    """SimHash of a set of 64-bit hashes: each bit is 1 if over half of the set have it; zero for the empty set."""
    counts = np.zeros(PRINT_BYTES * 8, np.int64)
    for at in range(0, len(shingle_set), 255):
        h = mix(shingle_set[at : at + 255, None] + SALTS)
        counts += SPREAD[h.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(counts * 2 > len(shingle_set), bitorder="little").tobytes()


def printed(df: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, print) of (doc_id, text): fp is a hash of the whole set of shingles, print its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(SEED)
        for batch in batches:
            sets = [shingles(t, shingle, cache) for t in as_bytes(batch.column(1))]
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints), pa.array(map(wide_print, sets), pa.binary())], names=["doc_id", "fp", "print"])

    return arrow_map(df, run, "doc_id long, fp long, print binary")


def kept(group: tuple[int, ...]) -> tuple[int, list[int], int]:
    """The bits of a word that some table of the group keeps, those that each keeps, and those that all keep."""
    own = [masks(WORD_RADIUS, WORD_BITS)[t - 1] for t in group]
    return reduce(or_, own), own, reduce(and_, own)


def dealt(prints: list[bytes], split: tuple[tuple[int, ...], ...] = ALONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, check, check): a row per fingerprint, a column of keys per word and group of tables.

    A key is the number of word and group (8 bits), the bits of the word that the group keeps (24), and the first 32 check bits.
    """
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(-1, PRINT_BYTES)
    own = raw[:, : WORDS * WORD_BITS // 8].reshape(len(raw), WORDS, WORD_BITS // 8).astype(np.uint64)
    words = own[:, :, 0] | own[:, :, 1] << np.uint64(8) | own[:, :, 2] << np.uint64(16)
    bits = (words[:, :, None] & np.array([kept(g)[0] for g in split], np.uint64)).reshape(len(raw), -1)
    check = np.ascontiguousarray(raw[:, -CHECK_BITS // 8 :])
    rest = np.ascontiguousarray(check[:, 4:]).view(np.uint64)
    keys = np.arange(bits.shape[1], dtype=np.uint64) << np.uint64(56) | bits << np.uint64(32) | np.ascontiguousarray(check[:, :4]).view(np.uint32)
    return keys, rest[:, 0], rest[:, 1]


def differ(key: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Check bits that are set in the XOR of the columns of two rows of one bucket, whose keys differ in check bits alone."""
    return np.bitwise_count(key) + np.bitwise_count(one) + np.bitwise_count(two)


def forest(cols: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a spanning forest of one bucket's links: unrelated rows go by tiles, trees are walked breadth first."""
    left = np.arange(len(cols[0]))
    while len(left) > 1:
        tile = left[: max(1, min(TILE, PAIRS // len(left)))]
        some = (differ(*(c[tile][:, None] ^ c[left] for c in cols)) <= radius).sum(axis=1) > 1
        left = left[len(tile) :]
        waiting = tile[some]
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            others = np.concatenate([waiting, left])
            while queue and len(others):
                p = queue.pop()
                near = differ(*(c[others] ^ c[p] for c in cols)) <= radius
                if near.any():
                    hit = others[near]
                    yield np.full(len(hit), p), hit
                    others = others[~near]
                    queue.extend(hit.tolist())
            waiting, left = others[others <= tile[-1]], others[others > tile[-1]]


def bucket_links(cols: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect, in each bucket of sorted rows, all that differ in `radius` check bits or fewer."""
    bucket = cols[0] >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(start, len(bucket)))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    small = size <= SMALL
    place = np.arange(len(bucket)) - np.repeat(start, size)
    at = np.flatnonzero(np.repeat(small, size))
    for back in range(1, SMALL):
        at = at[place[at] >= back]
        near = at[differ(*(c[at] ^ c[at - back] for c in cols)) <= radius]
        found.append((near, near - back))
    for s, n in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
        found += [(a + s, b + s) for a, b in forest([c[s : s + n] for c in cols], radius)]
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def table_links(cols: list[np.ndarray], split: tuple[tuple[int, ...], ...], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the links of all tables of whole shards, whose rows are in any order."""
    group = (cols[0] >> np.uint64(56)) % np.uint64(len(split))
    for g, tables in enumerate(split):
        at = np.flatnonzero(group == g)
        if not len(at):
            continue
        for mask in kept(tables)[1]:
            key = cols[0][at] & np.uint64(0xFF << 56 | mask << 32 | 0xFFFFFFFF)
            order = np.argsort(key)
            x, y = bucket_links([key[order], *(c[at[order]] for c in cols[1:])], radius)
            yield at[order[x]], at[order[y]]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): each node of the links (a, b) but the smallest of its component, and that one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def candidates(nodes: DataFrame, radius: int = CHECK_RADIUS) -> DataFrame:
    """(a, b): links that connect all nodes (rep, print) that meet in a table and are within the radius, and no others.

    A task reduces the links of its buckets to stars around the smallest node of each component it sees, so that a large
    group costs it a link a node, not one a node and table.
    """
    split = TOGETHER if nodes.select("rep").count() <= MOST_TOGETHER else ALONE

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, DEALT) for at in range(0, batch.num_rows, DEALT)):
                keys, *rest = dealt(part.column(1).to_pylist(), split)
                more = [np.repeat(c, keys.shape[1]) for c in (*rest, part.column(0).to_numpy())]
                yield pa.record_batch([pa.array(c.ravel().view(np.int64)) for c in (keys, *more)], names=["key", "one", "two", "rep"])

    rows = arrow_map(nodes.select("rep", "print"), deal, "key long, one long, two long, rep long")
    common = np.array([0xFF << 24 | kept(g)[2] for _ in range(WORDS) for g in split], np.uint64)
    shard = F.expr(f"shiftright(key, 32) & array({', '.join(f'{m}L' for m in common.tolist())})[cast(shiftrightunsigned(key, 56) as int)]")
    met = rows.repartition(shard).sortWithinPartitions(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, n_links = [], 0

        def forest_of() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in links)]) for i in (0, 1)))

        def out(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x) for x in found], names=["a", "b"])

        held = [np.zeros(0, np.uint64)] * 4
        for batch in chain(batches, [None]):
            cols = held
            if batch is not None:
                own = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
                cols = [np.concatenate(x) for x in zip(held, own, strict=True)]
            shards = cols[0] >> np.uint64(32) & common[cols[0] >> np.uint64(56)]
            change = np.flatnonzero(shards[1:] != shards[:-1])
            whole = len(shards) if batch is None else int(change[-1]) + 1 if len(change) else 0  # the last shard may go on in the next batch
            held, cols = [c[whole:] for c in cols], [c[:whole] for c in cols]
            reps = cols[3].view(np.int64)
            for x, y in table_links(cols[:3], split, radius):
                links.append((reps[x], reps[y]))
                n_links += len(x)
                if n_links > HELD_LINKS:
                    links = [forest_of()]
                    n_links = len(links[0][0])
                    if n_links > HELD_LINKS // 2:
                        yield out(links[0])
                        links, n_links = [], 0
        yield out(forest_of())

    return arrow_map(met, run, "a long, b long").distinct()


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, fp, component_id) per input row; fp is a hash of the set of shingles.

    Texts whose sets of shingles have a Jaccard similarity of `similar` or more are linked; component_id is the smallest
    doc_id reachable. `similar` below 0.8 misses more (see above). Null or empty text: the empty set, linked to its like
    alone. Null and repeated doc_ids and empty tables: as in simhash_groups.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def link(nodes: DataFrame) -> DataFrame:
        found = components(candidates(nodes))
        clusters = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        # Broadcast, so that only the texts of clusters move.
        if clusters.limit(MOST_IDS // 2 + 1).count() <= MOST_IDS // 2:
            clusters = F.broadcast(clusters)
        return verified(rows, clusters, shingle, similar)

    return grouped(materialise(printed(rows, shingle), "prints"), link, F.first("print").alias("print"))


def similar_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The rows of df whose doc_id is the smallest of its component, one row for each such doc_id (the least by value).

    Rows without doc_id stay, all of them.
    """
    return firsts(df, similar_groups(df, doc_id, text, shingle, similar), doc_id)
