"""Benchmark decontamination: training words inside a benchmark n-gram are found, verified and removed.

The n-grams of the benchmark are indexed on the driver in blocks of at most about `block_bytes` of benchmark text, each
broadcast on its own; the size of the benchmark is measured first, and a larger one gets more blocks, scanned one after
another over the same rows. A document is scanned by a rolling hash over the numbers of its words in the benchmark's
vocabulary; a window with a foreign word can't match, and each hash hit is verified word by word.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import arrow_map, as_bytes, cover, extended, free_name, mix, rolling

WINDOW = 13
#: A-Z to a-z; digits, a-z and bytes of non-ASCII characters stay; all else is a gap
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP_WORDS = 500_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Vocabulary(dict):
    """word -> number from 1; 0 for words the benchmark doesn't have."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Index:
    """Windows of some benchmark items: by length, the sorted hashes, the words and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        vocabulary: dict[bytes, int] = {}
        grams: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            width = min(window, len(numbers))
            for i in range(len(numbers) - width + 1 if width else 0):
                grams[width][tuple(numbers[i : i + width])].add(item)
        self.vocabulary, self.by_width = Vocabulary(vocabulary), {}
        for width, of in grams.items():
            words = np.array(list(of), np.int64).reshape(len(of), width)
            owners = [sorted(x) for x in of.values()]
            base = 0x9E3779B97F4A7C55
            while True:
                hashes = rolling(mix(words.ravel().astype(np.uint64)), width, base)[::width]
                if len(np.unique(hashes)) == len(hashes):
                    break
                base += 2
            order = np.argsort(hashes)
            self.by_width[width] = base, hashes[order], words[order], [owners[i] for i in order]

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """(words, mask of hit words, items) of each text, in order."""
        held, size = [], 0
        for t in texts:
            words = words_of(t) if t else ()
            held.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)))
            size += len(words)
            if size >= GROUP_WORDS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        gap = np.zeros(1, np.int64)
        flat = np.concatenate([x for t in texts for x in (t, gap)] or [gap])
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        foreign = np.concatenate([[0], np.cumsum(flat == 0)])
        hit = np.zeros(len(flat), bool)
        items: dict[int, set[str]] = defaultdict(set)
        for width, (base, hashes, words, owners) in self.by_width.items():
            at = np.flatnonzero(foreign[width:] == foreign[: max(0, len(foreign) - width)])
            if not len(at):
                continue
            grams = flat[at[:, None] + np.arange(width)] if len(at) < 200_000 else None
            h = rolling(mix(grams.ravel().astype(np.uint64)), width, base)[::width] if grams is not None else rolling(mix(flat.astype(np.uint64)), width, base)[at]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.flatnonzero(hashes[place] == h)
            found = found[(flat[at[found][:, None] + np.arange(width)] == words[place[found]]).all(axis=1)]
            hit |= cover(at[found], width, len(flat))
            for text, p in zip((np.searchsorted(starts, at[found], side="right") - 1).tolist(), place[found].tolist(), strict=True):
                items[text].update(owners[p])
        for i, t in enumerate(texts):
            yield len(t), hit[starts[i] : starts[i] + len(t)], items.get(i, set())


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """text without the stretches from the first to the last word of each run of hit words."""
    spans = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(TABLE))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, last = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[last : spans[a][0]])
        last = spans[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: its columns, then n_words, n_hit, items (ids as strings, sorted), clean_text.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A word is hit if it lies in any
    occurrence of a window of an item: `window` consecutive words, or the whole item if it is shorter. clean_text lacks
    the hit stretches. Null text: no words, clean_text null. Items without words match nothing; a null item_id counts as
    the id "null"; repeated ids count once. Names that are taken get underscores. Empty tables give empty or unhit rows.
    """
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    names: list[str] = []
    for wanted in ("n_words", "n_hit", "items", "clean_text"):
        names.append(free_name(wanted, df.columns + names))
    width = len(df.columns)
    middle = extended(df, ("__hit", "binary"), ("__items", "array<string>"))
    last = extended(df, *zip(names, ("long", "long", "array<string>", "string"), strict=True))
    at = df.columns.index(text)
    context = df.sparkSession.sparkContext
    out = df
    for block in range(blocks):
        rows = (bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)).collect()
        index = context.broadcast(Index([(r.i, r.t.encode()) for r in rows], window))
        final = block == blocks - 1

        def run(batches: Iterator[pa.RecordBatch], index=index, first=block == 0, final=final) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_bytes(batch.column(at))
                found = list(index.value.scan(texts))
                if not first:
                    old_hits, old_items = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
                    found = [(n, hit | np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) if b else hit, items | set(o or ())) for (n, hit, items), b, o in zip(found, old_hits, old_items, strict=True)]
                if final:
                    new = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([int(h.sum()) for _, h, _ in found], pa.int64()), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())), pa.array([t if t is None or not h.any() else cut(t, h) for t, (_, h, _) in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())]
                else:
                    new = [pa.array([np.packbits(h).tobytes() if h.any() else None for _, h, _ in found], pa.binary()), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*batch.schema.names[:width], *(names if final else ("__hit", "__items"))])

        out = arrow_map(out, run, last if final else middle)
    return out


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontamination_digest(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of decontaminate()."""
    out = decontaminate(df.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))
