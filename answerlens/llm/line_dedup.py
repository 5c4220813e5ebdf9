"""Line dedup by winnowing: later copies of runs of lines are deleted.

A window is the shortest stretch of lines from a line on that makes a run: `run_words` words or `run_lines` lines. It selects
its smallest line hash, so two copies of a run always select the same line: a guaranteed fingerprint. Windows whose
fingerprint occurs twice or more (counted in an exchange between chunks and hash shards, see exchange.py) are joined to the
smallest place, doc_id and line, that holds the same lines. From there a match is extended line by line to both sides, as
far as a run may go on without another window in it: the lines around the earlier place come with the answer. Matched
stretches are deleted. No pairs of occurrences are formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from answerlens.llm.exchange import Windows, placed, repeated_earlier
from answerlens.llm.shared import HashCache, as_bytes, cover, extended, free_name, mix, second_half

RUN_LINES, RUN_WORDS = 4, 13


def ahead(values: np.ndarray, j: int) -> np.ndarray:
    """The value j places on (zero beyond the end)."""
    return np.concatenate([values[j:], np.zeros(min(j, len(values)), values.dtype)])


def lines_cut(text: str, run_lines: int, run_words: int | None):
    cache, second = HashCache(seed=7), HashCache(again=True)

    def cut(batch: pa.RecordBatch) -> Windows:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        lines = [t.split(b"\n") if t is not None else [] for t in texts]
        n = np.array([len(x) for x in lines], np.int64)
        total, ends = int(n.sum()), np.cumsum(n)
        h = np.fromiter((cache[x] for own in lines for x in own), np.uint64, total)
        h[h == 0] = 1  # zero stands for no line
        words = np.fromiter((len(x.split(None, run_words)) for own in lines for x in own), np.int64, total) if run_words else np.zeros(total, np.int64)
        rows = np.repeat(np.arange(len(n)), n)
        begin, end = (ends - n)[rows], ends[rows]
        at = np.arange(total)
        length, seen, least, key = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, np.iinfo(np.uint64).max), np.zeros(total, np.uint64)
        for j in range(run_lines):
            still = length == 0
            unit = ahead(h, j)
            seen += ahead(words, j)
            least = np.where(still, np.minimum(least, unit), least)
            key = np.where(still, key * np.uint64(0x9E3779B97F4A7C55) + unit, key)
            length[still & ((j + 1 == run_lines) | (run_words is not None and seen >= (run_words or 0)))] = j + 1
        whole = np.flatnonzero(at + length <= end)
        before = [np.where(at - j >= begin, h[np.maximum(at - j, 0)], 0) for j in range(1, run_lines)] if total else []
        after = [np.where(at + length + j < end, h[np.minimum(at + length + j, total - 1)], 0) for j in range(run_lines - 1)] if total else []
        around = np.stack([*before, *after], axis=1).astype(np.uint64)[whole] if before else np.zeros((len(whole), 0), np.uint64)

        def check(picked: np.ndarray) -> np.ndarray:
            return second_half(lines.__getitem__, n, whole[picked], length[whole[picked]], second)

        return Windows(rows[whole], (at - begin)[whole], length[whole], mix(least[whole]), mix(key + length.astype(np.uint64))[whole], check, around)

    return cut


def alike(own: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many of the columns, from the first on, hold the same line."""
    return np.cumprod((own == there) & (own != 0), axis=1).sum(axis=1).astype(np.int64)


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run_lines: int = RUN_LINES, run_words: int | None = RUN_WORDS) -> DataFrame:
    """One row per input row: its columns, then n_lines, n_removed_lines, kept_text (names get underscores if taken).

    Lines are the parts of the text between \\n, compared byte for byte. From each line on, the shortest stretch of
    `run_words` words or of `run_lines` lines (null run_words: of lines alone) is looked up in all texts. If its smallest
    place (doc_id, then line) is in a document with a smaller doc_id, or else earlier in the same text, the stretch goes,
    and so do up to run_lines - 1 equal lines on either side of both. All is judged on the input. kept_text joins the lines
    left by \\n (null stays null; empty text is one empty line). Null doc_id: only repeats inside the text go. Rows of
    equal doc_id don't affect each other. Empty table: empty result.
    """
    names = []
    for wanted in ("n_lines", "n_removed_lines", "kept_text"):
        names.append(free_name(wanted, df.columns + names))

    def finish(batch: pa.RecordBatch, w: Windows, covered: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        inside = repeats_inside(w)
        own = np.flatnonzero(~covered & (inside >= 0))
        around[own] = w.around[inside[own]]
        hit = covered | (inside >= 0)
        half = run_lines - 1
        back, on = alike(w.around[:, :half], around[:, :half]), alike(w.around[:, half:], around[:, half:])
        first, width = w.start - back, w.length + back + on
        bounds = np.searchsorted(w.row, np.arange(len(texts) + 1))
        n_lines, n_removed, kept = [], [], []
        for i, t in enumerate(texts):
            lines = t.split(b"\n") if t is not None else []
            a, b = bounds[i], bounds[i + 1]
            go = hit[a:b]
            gone = cover(first[a:b][go], width[a:b][go], len(lines)) if go.any() else ()
            n_lines.append(len(lines))
            n_removed.append(int(np.sum(gone)))
            kept.append(None if t is None else b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g) if n_removed[-1] else t)
        new = [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = extended(df, *zip(names, ("long", "long", "string"), strict=True))
    return repeated_earlier(df, doc_id, text, lines_cut(text, run_lines, run_words), finish, schema, bytes_a_window=60.0)


def repeats_inside(w: Windows) -> np.ndarray:
    """For each window the first equal one of the same row; -1 where it is the first itself."""
    order = np.lexsort((w.start, w.key, w.row))
    row, key = w.row[order], w.key[order]
    same = np.zeros(len(order), bool)
    same[1:] = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
    picked = order[same | np.append(same[1:], False)]  # only windows that may be equal get the second half of their key
    out = np.full(len(w.row), -1, np.int64)
    if len(picked):
        _, _, at, entry = placed(Windows(w.row, w.start, w.length, w.probe, mix(w.key ^ mix(w.row.astype(np.uint64))), w.check, w.around), np.arange(int(w.row[-1]) + 1), picked)
        later = picked[at[entry[picked]] != picked]
        out[later] = at[entry[later]]
    return out
