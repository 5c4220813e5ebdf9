"""Small helpers for Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, or wanted with underscores until no column (whatever its case) has that name."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def extended(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """The schema of df with (name, type) fields behind."""
    schema = StructType(list(df.schema.fields))
    for name, kind in fields:
        schema.add(StructType.fromDDL(f"`{name}` {kind}").fields[0])
    return schema


BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of 8 MB at most (but whole rows).

    The session's limit is lowered to that and stays so: Spark reads it when the result is computed, and larger batches would
    be in memory twice, in the JVM and in the worker, before a task could slice them.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES or int(now.rstrip("bB")) <= 0:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class HashCache(dict):
    """word (bytes) -> XXH64, or (again) XXH3, an independent hash; kept for at most `limit` short words so that memory stays bounded."""

    def __init__(self, seed: int = 0, limit: int = 200_000, again: bool = False):
        self.seed, self.limit, self.digest = seed, limit, xxhash.xxh3_64_intdigest if again else xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.digest(word, self.seed)
        if len(word) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads any 64-bit values over all 64 bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash mod 2**64 of each k consecutive values of h, mixed; empty if h is shorter than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, b = h[:n].copy(), np.uint64(base)
    for j in range(1, k):
        out *= b
        out += h[j : j + n]
    return mix(out)


def second_half(units: Callable[[int], list[bytes]], n: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cache: HashCache) -> np.ndarray:
    """32 bits of each window that begins at a place of the concatenated units (n[i] of row i) and has a length, by the
    hashes of cache; only rows and units in a window are hashed."""
    needed = cover(starts, lengths, int(n.sum()))
    flat, ends = np.zeros(len(needed), np.uint64), np.cumsum(n)
    for i in np.unique(np.searchsorted(ends, starts, side="right")).tolist():
        base = int(ends[i] - n[i])
        at, own = np.flatnonzero(needed[base : ends[i]]), units(i)
        flat[base + at] = np.fromiter((cache[own[x]] for x in at.tolist()), np.uint64, len(at))
    out, b = np.zeros(len(starts), np.uint64), np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(int(lengths.max(initial=0))):
        more = lengths > j
        out[more] = out[more] * b + flat[starts[more] + j]
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def cover(starts: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of length n: true where some interval [s, s + width) of `starts` lies."""
    if not len(starts):
        return np.zeros(n, bool)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()
