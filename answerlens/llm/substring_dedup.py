"""Substring dedup: words covered by a window that an earlier document also has are removed.

A count-min sketch, merged from the partial sketches of all chunks, overestimates how often each window occurs; a second
pass groups exactly the windows it estimates repeated, so none is lost. The sketch has one row: doubling its width costs
each message one bit a window, a second row would cost a whole message. See exchange.py for the data flow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from answerlens.llm.exchange import Windows, repeated_earlier
from answerlens.llm.shared import HashCache, as_bytes, cover, extended, free_name, mix, rolling, second_half

WINDOW = 13


def words_cut(text: str, window: int):
    """Windows of `window` consecutive words (maximal runs without ASCII white space); null has none."""
    cache, second = HashCache(), HashCache(again=True)

    def cut(batch: pa.RecordBatch) -> Windows:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        hashes = []
        for t in texts:
            words = t.split() if t else ()
            hashes.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        n = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        rows = np.repeat(np.arange(len(n)), n)
        end = np.repeat(np.cumsum(n), n)
        whole = np.flatnonzero(np.arange(len(flat)) + window <= end)
        key = rolling(flat, window, 0x9E3779B97F4A7C55)[whole]

        def check(picked: np.ndarray) -> np.ndarray:
            return second_half(lambda i: texts[i].split(), n, whole[picked], np.full(len(picked), window), second)

        return Windows(rows[whole], whole - (end - n[rows])[whole], np.full(len(whole), window), mix(key), key, check, np.zeros((len(whole), 0), np.uint64))

    return cut


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: its columns, then n_words, n_removed, kept_text (names get underscores if taken).

    A word goes if a window of `window` words around it starts in a document with a smaller doc_id too; windows are
    judged on the input. kept_text joins the words left by one space. Null text: no words, kept_text empty. Null doc_id:
    nothing is removed from the row and nothing is removed because of it. Rows of equal doc_id don't affect each other,
    and repeats within one document stay. Empty table: empty result.
    """
    names = []
    for wanted in ("n_words", "n_removed", "kept_text"):
        names.append(free_name(wanted, df.columns + names))

    def finish(batch: pa.RecordBatch, w: Windows, covered: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        bounds = np.searchsorted(w.row, np.arange(len(texts) + 1))
        n_words, n_removed, kept = [], [], []
        for i, t in enumerate(texts):
            words = t.split() if t else []
            a, b = bounds[i], bounds[i + 1]
            gone = cover(w.start[a:b][covered[a:b]], window, len(words))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join(words if not n_removed[-1] else [x for x, g in zip(words, gone.tolist(), strict=True) if not g]))
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = extended(df, *zip(names, ("long", "long", "string"), strict=True))
    return repeated_earlier(df, doc_id, text, words_cut(text, window), finish, schema, bytes_a_window=6.0)


def substring_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of substring_dedup()."""
    from pyspark.sql import functions as F

    out = substring_dedup(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), window=window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
