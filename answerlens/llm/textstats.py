"""Statistics of whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.shared import HashCache, arrow_map, as_bytes, cover, extended, free_name, rolling

REPEAT_WINDOW = 8
#: Columns of stats(); the first five are counts, the rest shares of them.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "symbols_a_word", "dup_line_share", "repeat_share", "word_length", "distinct_words", "top_word", "short_words", "upper_share", "capital_words", "marks_a_word", "stops_a_word", "bangs_a_word", "digit_share", "words_a_line", "longest_word", "non_ascii_share", "vowel_share")

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC0)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_VOWEL = np.isin(_BYTES, list(b"aeiouyAEIOUY"))
_FOLLOWS = (_BYTES >= 0x80) & (_BYTES < 0xC0)
_MARK = np.isin(_BYTES, list(b".,;:!?-'\"()"))
_KINDS = np.array([_SPACE, _SYMBOL, _UPPER, _LETTER, _DIGIT, _VOWEL, _FOLLOWS, _MARK], np.int64)


def stats(text: bytes | None, cache: HashCache) -> tuple[float, ...]:
    """The values of NAMES for one text (null: that of an empty one)."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space, symbols, upper, letters, digits, vowels, follows, marks = (_KINDS @ counts).tolist()
    points = len(text) - follows
    chars = points - space
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    _, number, often = np.unique(h, return_inverse=True, return_counts=True)
    repeat = 0
    if n > REPEAT_WINDOW:
        windows = rolling(h, REPEAT_WINDOW, 0x9E3779B97F4A7C55)
        _, which, many = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(many[which] > 1)
        repeat = int(cover(twice, REPEAT_WINDOW, n).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    lengths = np.fromiter(map(len, words), np.int64, n)
    capital = sum(w[0] < 91 and 65 <= w[0] for w in words)
    return (float(n), float(chars), float(symbols), float(dup), float(repeat), symbols / n, dup / len(lines), repeat / n, chars / n, len(often) / n, int(often.max()) / n, float((lengths <= 3).mean()), upper / max(1, letters), capital / n, marks / n, (counts[46] + counts[63]) / n, counts[33] / n, digits / chars, n / len(lines), float(lengths.max()), 1 - (int(counts[:128].sum()) / len(text)), vowels / max(1, letters))


#: Texts whose results a task holds at a time.
SLICE = 1000


def stats_map(df: DataFrame, text: str, keep: tuple[str, ...] | None, fields: list[tuple[str, str]], results: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """df (or its columns `keep`), then results() of the values of NAMES as `fields`; names that are taken get underscores."""
    kept = df.columns if keep is None else list(keep)
    names: list[str] = []
    for wanted, _ in fields:
        names.append(free_name(wanted, kept + names))
    source = df.select(*kept, F.col(text).alias(free_name("whole_text", kept))) if keep is not None else df
    at = len(kept) if keep is not None else df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                values = np.array([stats(t, cache) for t in as_bytes(part.column(at))], np.float64).reshape(part.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *results(values)], names=[*part.schema.names[: len(kept)], *names])

    return arrow_map(source, run, extended(df.select(*kept), *zip(names, (k for _, k in fields), strict=True)))


def with_stats(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> tuple[DataFrame, str]:
    """df (or its columns `keep`) with an array of the values of NAMES behind, and that column's name."""
    lists = lambda x: [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))]
    out = stats_map(df, text, keep, [("stats", "array<double>")], lists)
    return out, out.columns[-1]


def taught(column: str):
    """Rows whose labels may be learnt: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(column).cast("string")) % 3 != 1


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, labels) of at most `bound` labelled documents, first in the order of a hash of the id.

    Only ids that taught() allows; an id labelled twice counts with its larger label; an id with several texts counts
    with the least.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & taught("doc_id")).groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found, name = with_stats(texts, keep=("doc_id", "y"))
    rows = found.orderBy("doc_id").toPandas()
    return np.array(rows[name].tolist(), np.float64).reshape(len(rows), len(NAMES)), rows["y"].to_numpy(np.float64)


def matrix(found: DataFrame) -> np.ndarray:
    """The values of a column of statistics, of a bounded number of rows."""
    values = found.toArrow().column(0)
    return values.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)) if len(values) else np.zeros((0, len(NAMES)))
