"""Which windows of a document stand in an earlier place: packed exchanges between chunks and hash shards.

Documents are packed into chunks (one table row each), written to the shared folder so that every pass sees the same chunks
even after an executor is lost. Two question-and-answer rounds follow:

1. sketch: every chunk sends the sketch cells of its windows, sorted and delta-coded, to the shard of the cell. A shard
   merges the partial sketches and answers one bit a cell: present in two chunks or more.
2. exact: every chunk sends a 96-bit key, the smallest place (doc_id and position) and, if the operator wants it, what
   stands around that place for each window whose cell is repeated (by the answer or inside the chunk). A shard joins
   equal keys and answers one bit a key, whether a smaller doc_id has the window elsewhere, and what stands around its
   smallest place. The halves of the key come from two independent hashes of the bytes of each word or line.

Each chunk sends a window once however often it holds it, so a passage in a third of all documents costs its shard one
entry a chunk. Chunks and shards both grow with the square root of the input (see sizes), so that a message has as many
windows at any size and their number grows with the input alone. Nothing is broadcast and nothing but one sum of bytes
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import arrow_map
from answerlens.storage import bucketed, materialise

CHUNK = "chunk_id long, n_bytes long, blob binary"
MESSAGE = "shard int, chunk_id long, body binary"
MESSAGE_ARROW = pa.schema([("shard", pa.int32()), ("chunk_id", pa.int64()), ("body", pa.binary())])
#: Windows a message, and bounds of a chunk (bytes) and of a shard (windows): what one task holds.
A_MESSAGE, LEAST_CHUNK, MOST_CHUNK, LEAST_SHARD, MOST_SHARD = 1024, 2 << 20, 32 << 20, 1 << 17, 1 << 27


@dataclass
class Windows:
    """Windows of one chunk: row, place in it and length of each, hash for the sketch, first half of its exact key, the
    second half of some of them, and for each a row of hashes of what stands around it (of any width, none as well)."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    probe: np.ndarray
    key: np.ndarray
    check: Callable[[np.ndarray], np.ndarray]
    around: np.ndarray


#: batch -> its windows
Cut = Callable[[pa.RecordBatch], Windows]
#: (batch, windows, whether each stands in an earlier document, what stands around that place) -> output batch
Finish = Callable[[pa.RecordBatch, Windows, np.ndarray, np.ndarray], pa.RecordBatch]


def sizes(total_bytes: float, bytes_a_window: float) -> tuple[int, int]:
    """(bytes of a chunk, bits of the shard number).

    With n windows, sqrt(n * A_MESSAGE) in each chunk and each shard make n / A_MESSAGE messages of A_MESSAGE windows. Up to
    0.1 TB of words or 1 TB of lines both stay in their bounds; beyond, chunks keep their size and shards take over, up to
    theirs, which leaves about 40 words a message at 100 TB.
    """
    windows = max(1.0, total_bytes / bytes_a_window)
    side = math.sqrt(windows * A_MESSAGE)
    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, int(side * bytes_a_window)))
    shard = min(MOST_SHARD, max(LEAST_SHARD, windows * A_MESSAGE / (chunk / bytes_a_window) if chunk == MOST_CHUNK else side))
    return chunk, max(0, round(math.log2(windows / shard)))


def plane(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes that are all alike cost next to nothing."""
    v = np.ascontiguousarray(values)
    return zstandard.compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes(), 1)


def unplane(body: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unframed(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def sorted_up(values: np.ndarray) -> bytes:
    return plane(np.diff(values, prepend=values.dtype.type(0)))


def pack(df: DataFrame, text: str, chunk_bytes: int, total_bytes: float) -> DataFrame:
    """df as chunks of whole rows, at least one row each, all columns kept; in buckets of chunk_id, so that answers come to the
    chunks and not the other way round."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, held, held_bytes = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal serial, held, held_bytes
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4))) as w:
                w.write_table(table)
            row = pa.record_batch([pa.array([serial], pa.int64()), pa.array([held_bytes], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk_id", "n_bytes", "blob"])
            serial, held, held_bytes = serial + 1, [], 0
            return row

        for batch in batches:
            sizes = np.frombuffer(batch.column(at).cast(pa.binary()).cast(pa.large_binary()).buffers()[1], np.int64)[: batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int64)
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + chunk_bytes - held_bytes, side="right")) - 1)
                end = min(end, batch.num_rows)
                held.append(batch.slice(start, end - start))
                held_bytes += int(sizes[end] - sizes[start])
                start = end
                if held_bytes >= chunk_bytes or start < batch.num_rows:
                    yield out()
        if held:
            yield out()

    return bucketed(arrow_map(df, run, CHUNK), "chunks", "chunk_id", total_bytes, compression="uncompressed")


def unpack(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)


def ids_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """doc_id as int64 and whether it is there."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def split(sorted_hash: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of sorted values that share their top bits."""
    if bits:
        shard = (sorted_hash >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(shard)], strict=True):
            if b > a:
                yield int(shard[a]), int(a), int(b)
    elif len(sorted_hash):
        yield 0, 0, len(sorted_hash)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], schema=MESSAGE_ARROW)


def bits_of(answers: list[dict] | None, n: int) -> np.ndarray:
    """The answers of all shards in shard order: one bit for each value that was sent."""
    if not answers:
        return np.zeros(n, bool)
    out = [np.unpackbits(np.frombuffer(a["body"][4:], np.uint8), count=int.from_bytes(a["body"][:4], "little")) for a in sorted(answers, key=lambda a: a["shard"])]
    return np.concatenate(out).astype(bool)


def answer(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes()


def placed(w: Windows, ids: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct (key, check) of picked windows, the window at the smallest place of each, and each picked window's entry."""
    check = w.check(picked)
    order = np.lexsort((w.start[picked], ids[w.row[picked]], check, w.key[picked]))
    key, half, at = w.key[picked][order], check[order], picked[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (half[1:] != half[:-1])
    entry = np.full(len(w.row), -1, np.int64)
    entry[at] = np.cumsum(new) - 1
    return key[new], half[new], at[new], entry


def repeated_earlier(df: DataFrame, doc_id: str, text: str, cut: Cut, finish: Finish, schema: str, *, bytes_a_window: float, cells_a_window: int = 12) -> DataFrame:
    """finish() of every chunk, told which windows also stand in a document of smaller doc_id, and what is around them there
    (at the smallest doc_id and position).

    A window of a row without doc_id is neither owner nor covered. Rows of equal doc_id don't cover each other.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    windows = max(1.0, total / bytes_a_window)
    chunk_bytes, shard_bits = sizes(total, bytes_a_window)
    chunks = pack(df, text, chunk_bytes, total)
    cell_bits = min(62, max(shard_bits + 8, math.ceil(math.log2(windows * cells_a_window))))
    drop = np.uint64(64 - cell_bits)

    def cells(w: Windows, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted cells of the windows of rows with an id, the cell number of each window (-1: none), windows in each cell."""
        own = known[w.row]
        uniq, inverse, count = np.unique(w.probe[own] >> drop, return_inverse=True, return_counts=True)
        number = np.full(len(own), -1, np.int64)
        number[own] = inverse
        return uniq, number, count

    def exact(batch: pa.RecordBatch, w: Windows, first: list[dict] | None):
        """placed() of the windows estimated repeated, and the ids of the rows."""
        ids, known = ids_of(batch, doc_id)
        uniq, number, count = cells(w, known)
        often = bits_of(first, len(uniq)) | (count > 1)
        picked = np.flatnonzero((number >= 0) & often[number]) if len(often) else np.zeros(0, np.int64)
        return *placed(w, ids, picked), ids

    def ask_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                batch = unpack(blob.as_py())
                w = cut(batch)
                uniq, _, _ = cells(w, ids_of(batch, doc_id)[1])
                shards = split(uniq << drop, shard_bits)
                yield messages([(s, chunk, sorted_up(uniq[i:j])) for s, i, j in shards])

    def tell_sketch(pdf):
        import pandas as pd

        shard = int(pdf["shard"].iloc[0])
        width = cell_bits - shard_bits
        low = np.uint64(shard << width)
        counts = np.zeros(1 << width, np.uint8)
        for body in pdf["body"]:
            at = np.cumsum(unplane(body, np.uint64), dtype=np.uint64) - low
            counts[at] = np.minimum(counts[at] + 1, 2)
        said = [answer(counts[np.cumsum(unplane(body, np.uint64), dtype=np.uint64) - low] > 1) for body in pdf["body"]]
        return pd.DataFrame({"shard": pdf["shard"], "chunk_id": pdf["chunk_id"], "body": said})

    def ask_exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, first in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                batch = unpack(blob.as_py())
                w = cut(batch)
                key, check, at, _, ids = exact(batch, w, first.as_py())
                parts = lambda i, j: [sorted_up(key[i:j]), plane(check[i:j]), plane(ids[w.row[at[i:j]]]), plane(w.start[at[i:j]].astype(np.int64)), plane(w.around[at[i:j]].ravel())]  # noqa: E731, B023
                yield messages([(s, chunk, framed(*parts(i, j))) for s, i, j in split(key, shard_bits)])

    def tell_exact(pdf):
        import pandas as pd

        parts = [unframed(b) for b in pdf["body"]]
        keys = [np.cumsum(unplane(p[0], np.uint64), dtype=np.uint64) for p in parts]
        ends = np.cumsum([len(x) for x in keys])
        gather = lambda i, kind: np.concatenate([unplane(p[i], kind) for p in parts])
        key, check, owner, start = np.concatenate(keys), gather(1, np.uint32), gather(2, np.int64), gather(3, np.int64)
        around = gather(4, np.uint64).reshape(len(key), -1) if len(key) else np.zeros((0, 0), np.uint64)
        order = np.lexsort((start, owner, check, key))
        k, c = key[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        least = np.empty(len(order), np.int64)
        least[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the entry of the smallest place
        earlier = owner[least] < owner
        said = [framed(answer(x), plane(around[of].ravel())) for x, of in zip(np.split(earlier, ends[:-1]), np.split(least, ends[:-1]), strict=True)]
        return pd.DataFrame({"shard": pdf["shard"], "chunk_id": pdf["chunk_id"], "body": said})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, first, second in zip(b.column(1), b.column(2), b.column(3), strict=True):
                batch = unpack(blob.as_py())
                w = cut(batch)
                key, _, at, entry, ids = exact(batch, w, first.as_py())
                said = [(a["shard"], unframed(a["body"])) for a in sorted(second.as_py() or [], key=lambda a: a["shard"])]
                earlier = bits_of([{"shard": n, "body": p[0]} for n, p in said], len(key))
                around = w.around[at]
                if around.shape[1] and len(key):  # of the smallest place of all
                    around = np.concatenate([unplane(p[1], np.uint64) for _, p in said]).reshape(-1, around.shape[1])
                has = np.flatnonzero(entry >= 0)
                covered, found = np.zeros(len(entry), bool), np.zeros_like(w.around)
                covered[has] = earlier[entry[has]] | (ids[w.row[at[entry[has]]]] < ids[w.row[has]])
                found[has] = around[entry[has]]
                yield finish(batch, w, covered, found)

    def answers(asked: DataFrame, tell, name: str) -> DataFrame:
        told = asked.groupBy("shard").applyInPandas(tell, MESSAGE)
        return told.groupBy("chunk_id").agg(F.collect_list(F.struct("shard", "body")).alias(name))

    plain = chunks.select("chunk_id", "blob")
    first = materialise(answers(arrow_map(plain, ask_sketch, MESSAGE), tell_sketch, "first"), "sketch-answers")
    both = plain.join(first.hint("shuffle_hash"), "chunk_id", "left")
    second = materialise(answers(arrow_map(both, ask_exact, MESSAGE), tell_exact, "second"), "exact-answers")
    replies = first.join(second, "chunk_id", "full")
    told = plain.join(replies.hint("shuffle_hash"), "chunk_id", "left").select("chunk_id", "blob", "first", "second")
    return arrow_map(told, last, schema)
