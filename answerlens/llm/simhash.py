"""SimHash near-dedup with covering locality-sensitive hashing.

Bit i of a fingerprint gets a non-zero vector m(i) of radius + 1 bits, dealt out in turn. Table v (any non-zero vector of
radius + 1 bits) keeps the bits i with <m(i), v> odd. The vectors of up to `radius` differing bits span no more than
`radius` dimensions, so some v is orthogonal to all of them: two fingerprints within the radius agree in that table's
bits, always. 31 tables of about 32 bits serve radius 4.

Only distinct fingerprints are hashed to tables. In a bucket, a breadth-first walk compares whole fingerprints and emits
a spanning forest of its links, never all pairs; a large bucket is first split by stretches of bits that links must share. Components come from alternating large-star and small-star rounds, each
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import arrow_map, as_bytes, extended, free_name
from answerlens.storage import discard, materialise

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a bucket beyond which it is compared in parts, and ids that are broadcast (8 bytes each).
LARGE, MOST_IDS = 2048, 4_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 of all word shingles of a text (UTF-8; A-Z lower-cased); 0 if it has no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    step = 1 << 15
    for at in range(0, n, step):
        spans = zip(starts[at : at + step].tolist(), ends[min(shingle, len(words)) - 1 :][at : at + step].tolist(), strict=True)
        h = np.fromiter([digest(line[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint as a signed long behind."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in as_bytes(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, name])

    return arrow_map(df, run, extended(df, (name, "long")))


def masks(radius: int, bits: int = 64) -> list[int]:
    """The bits each table keeps of fingerprints of `bits` bits, as signed longs."""
    vectors = range(1, 2 ** (radius + 1))
    dealt = [vectors[i % len(vectors)] for i in range(bits)]
    unsigned = [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() % 2) for v in vectors]
    return [x - (1 << 64) if x >> 63 else x for x in unsigned]


def forest(prints: np.ndarray, nodes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the graph 'differ in `radius` bits or fewer'; linear memory."""
    left = np.arange(len(prints))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[p]) <= radius
            if near.any():
                hit = left[near]
                yield np.full(len(hit), nodes[p]), nodes[hit]
                left = left[~near]
                queue.extend(hit.tolist())


def stretches(prints: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Groups of a large bucket that together hold each pair within the radius: fingerprints that agree in one of radius + 1
    stretches of bits, as such a pair must."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        value = (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(value, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(group) > 1:
                yield group


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between nodes (fp, rep) that connect all fingerprints within the radius."""
    bucket = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("table", "bucket")
    dealt = nodes.select(bucket, "fp", "rep").repartition("table", "bucket").sortWithinPartitions("table", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            table, bucket, prints, reps = cols
            prints = prints.view(np.uint64)  # bits of negative numbers are counted of their absolute value
            new = np.ones(len(table), bool)
            new[1:] = (table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(table)))
            two = start[size == 2]
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
            found = [(reps[near], reps[near + 1])]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own, rep = prints[s : s + n], reps[s : s + n]
                for group in stretches(own, radius) if n > LARGE else (np.arange(n),):
                    found += forest(own[group], rep[group], radius)
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(a):
                yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            whole = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on in the next batch
            if whole:
                yield from linked([c[:whole] for c in cols])
            held = [c[whole:] for c in cols]
        if held is not None and len(held[0]):
            yield from linked(held)

    return arrow_map(dealt, run, "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of (a, b) links but the roots.

    Rounds go on until nothing changes; their number grows with the logarithm of a component's size. Each replaces the
    table of the last, whose files go.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    told = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low).distinct()
        last, now = now, materialise(small, "stars")
        discard(last)
        tale = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if tale == told:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        told = tale


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per input row; fp is the fingerprint as a signed long.

    Fingerprints at `radius` or fewer differing bits are linked; component_id is the smallest doc_id reachable. Null or
    empty text: fingerprint 0, linked like any other. Null doc_id: the row links nothing, and gets the component that
    its fingerprint has through other rows, else null. Rows of equal doc_id are one document. Empty table: empty result.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    printed = materialise(fingerprints(rows, "text", "fp").select("doc_id", "fp"), "fingerprints")
    return grouped(printed, lambda nodes: links(nodes.select("fp", "rep"), radius))


def grouped(printed: DataFrame, link: Callable[[DataFrame], DataFrame], *more: Column) -> DataFrame:
    """(doc_id, fp, component_id) per row of printed (doc_id, fp), as in simhash_groups.

    link makes (a, b) links of the nodes (fp, rep, copies and the aggregates `more`): rep is the smallest doc_id of an fp.
    """
    nodes = printed.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *more).filter("rep IS NOT NULL")
    known = printed.filter("doc_id IS NOT NULL")
    repeated = known.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id")
    bridges = known.join(repeated, "doc_id", "left_semi").distinct().join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    roots = components(link(nodes).union(bridges))
    of = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", "copies", F.coalesce("root", "rep").alias("component_id"))
    # Fingerprints of over a thousandth of all rows: a thousand of them at most, so they are broadcast, not dealt by key.
    least = printed.count() / 1000
    hot = F.broadcast(of.filter(F.col("copies") > least).select("fp", F.col("component_id").alias("hot")))
    found = printed.join(hot, "fp", "left")
    common = found.filter("hot IS NOT NULL").select("doc_id", "fp", F.col("hot").alias("component_id"))
    rare = found.filter("hot IS NULL").select("doc_id", "fp").join(of.filter(F.col("copies") <= least).select("fp", "component_id"), "fp", "left")
    return common.unionByName(rare.select("doc_id", "fp", "component_id"))


def simhash_digest(df: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)."""
    return simhash_groups(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of df whose doc_id is the smallest of its component, one row for each such doc_id (the least by value).

    Rows without doc_id stay, all of them.
    """
    return firsts(df, simhash_groups(df, doc_id, text, radius), doc_id)


def firsts(df: DataFrame, groups: DataFrame, doc_id: str) -> DataFrame:
    """The rows of df that simhash_dedup keeps, given the groups.

    The ids to leave out are broadcast if there are MOST_IDS at most, so that texts move only where a doc_id repeats.
    """
    told = materialise(groups.select("doc_id", "component_id").filter("doc_id IS NOT NULL"), "groups")
    name = free_name("other_id", df.columns)
    lost = told.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    again = told.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(name))
    sized = lambda ids: F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids
    same = df[doc_id].cast("long") == F.col(name)
    kept = df.join(sized(lost), same, "left_anti")
    if not again.take(1):
        return kept
    again = sized(again)
    rest = [c for c in df.columns if c != doc_id]
    row = free_name("row", df.columns)
    many = kept.join(again, same, "left_semi").groupBy(doc_id).agg(F.min(F.struct(*rest)).alias(row))
    one = many.select(*[doc_id if c == doc_id else F.col(f"{row}.{c}") for c in df.columns])
    return kept.join(again, same, "left_anti").unionByName(one)
