"""SentencePiece encoding and decoding.

Encoding is relational. Words fall into stretches where no piece holds two neighbouring characters, which no segmentation
crosses. All distinct stretches of the corpus are exploded into their substrings of bounded length, joined by equality to the
piece table, the edges are grouped by stretch, and each lattice is folded by Spark's higher-order aggregate. The fold depends
on the model:

* "viterbi": the best sum of scores, for unigram models;
* "merges": pieces in order of score, each joining two neighbours that make it up, for BPE models. Their scores are merge
  ranks, and the best sum of ranks is another segmentation than the model's (see README for figures).

The ids go back to the texts in two ways: those of the most frequent stretches (`most_words` at most) are broadcast, the
others are sent to the chunks of texts that ask for them. The lattice of a stretch of more than `longest` characters, which
only runs of letters or signs without a space have, would not fit a row; it is folded by the same rule in the task.

White space: each space becomes U+2581 and one is put in front; other characters without a piece become byte pieces.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.exchange import pack, unpack
from answerlens.llm.shared import arrow_map, extended, free_name
from answerlens.storage import discard, materialise

SPACE = "▁"
MOST_WORDS, LONGEST, CHUNK_BYTES = 200_000, 256, 4 << 20
SLICE = 400  # texts that a task works on at a time
A_TASK = 40_000  # stretches whose edges a task groups in memory
#: Bits of the rank, of each end and of the id of an edge of a "merges" lattice.
RANK_BITS, PLACE_BITS, ID_BITS = 19, 12, 20


class Pieces:
    """The piece table of a model."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], unknown: int, fold: str):
        self.pieces, self.byte_ids, self.unknown, self.fold = pieces, byte_ids, unknown, fold
        self.width = max((len(p) for p, _, _ in pieces), default=1)
        self.by_text = {p: (i, s) for p, i, s in pieces}
        #: Every beginning of a piece: its rank (smaller for a better score) if it is a piece itself, else None.
        self.heads: dict[str, float | None] = {p[:n]: None for p in self.by_text for n in range(1, len(p) + 1)}
        self.heads |= {p: -s for p, (_, s) in self.by_text.items()}

    @staticmethod
    def load(path: str | None = None) -> Pieces:
        """From a SentencePiece model file; by default the public BPE model that the tokenizer package offers."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = pb.ModelProto.SentencePiece
        pieces = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        bad = [p for p, _, _ in pieces if "\n" in p or SPACE in p.lstrip(SPACE)]
        if bad:
            raise ValueError(f"pieces that cross word bounds: {bad[:3]}")
        return Pieces(pieces, [i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE], model.trainer_spec.unk_id, "merges" if model.trainer_spec.model_type == pb.TrainerSpec.BPE else "viterbi")

    def surfaces(self) -> list[bytes]:
        """By id: the bytes of a piece."""
        out = [b""] * (1 + max([self.unknown, *self.byte_ids, *(i for _, i, _ in self.pieces)]))
        out[self.unknown] = " ⁇ ".encode()
        for p, i, _ in self.pieces:
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out

    def of_char(self, c: str) -> list[int]:
        if c in self.by_text:
            return [self.by_text[c][0]]
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, by the fold of this model over all edges of its lattice."""
        n, known, heads = len(word), self.by_text, self.heads.get
        edges = []
        for s in range(n - 1):
            for e in range(s + 2, n + 1):
                rank = heads(word[s:e], False)
                if rank is False:
                    break
                if rank is not None:
                    edges.append((rank, s, e))
        after = list(range(1, n + 2))
        if self.fold == "merges":
            edges.sort()
            joined: set[int] = set()
            for _, s, e in edges:
                m = after[s]
                if m < e and after[m] == e and s not in joined:
                    after[s] = e
                    joined.add(m)
        else:
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for _, s, e in edges:
                ends[e].append((s, known[word[s:e]][1]))
            floor = self.unknown_score()
            for e in range(1, n + 1):
                c = known.get(word[e - 1])
                for s, score in sorted([*ends[e], (e - 1, c[1] if c else floor)]):
                    if best[s] + score > best[e]:
                        best[e], back[e] = best[s] + score, s
            e = n
            while e:
                after[back[e]] = e
                e = back[e]
        out, s = [], 0
        while s < n:
            e = after[s]
            out += [known[word[s:e]][0]] if e - s > 1 else self.of_char(word[s])
            s = e
        return out

    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - 10.0


class Cutter:
    """Cuts texts where no piece holds two neighbouring characters."""

    def __init__(self, pieces: Pieces):
        pairs = {p[n : n + 2] for p in pieces.by_text for n in range(len(p) - 1)}
        alphabet = sorted({c for pair in pairs for c in pair})
        number = {c: i + 1 for i, c in enumerate(alphabet)}
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.joined = np.zeros((len(alphabet) + 1,) * 2, bool)
        for a, b in pairs:
            self.joined[number[a], number[b]] = True

    def cut(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts, and the number of the first one of each text (and of the end)."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        bound = np.ones(len(points) + 1, bool)
        if len(points):
            bound[1:-1] = ~self.joined.ravel()[kind[:-1] * np.int32(len(self.joined)) + kind[1:]]
        places = np.cumsum([0, *map(len, marked)])
        bound[places] = True
        size = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.flatnonzero(bound)
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[at]
        big = offsets[-1] >= 1 << 31
        kinds = (pa.LargeStringArray, np.int64) if big else (pa.StringArray, np.int32)
        stretches = kinds[0].from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(kinds[1])), pa.py_buffer(whole.encode()))
        return stretches, np.searchsorted(at, places)


class Decoder:
    def __init__(self, pieces: Pieces):
        surfaces = pieces.surfaces()
        self.bytes = np.frombuffer(b"".join(surfaces), np.uint8)
        self.size = np.array([len(x) for x in surfaces])
        self.start = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of so many ids each, without the space put in front; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        raw = self.bytes[ragged(self.start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each (start, size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class StretchIds:
    """stretch -> ids as int32 bytes: of the broadcast ones, of those that came for a chunk, and of longer ones."""

    def __init__(self, pieces: Pieces, longest: int, frequent: dict[str, bytes]):
        self.pieces, self.longest, self.frequent, self.rare = pieces, longest, frequent, {}

    def of(self, stretch: str) -> bytes:
        ids = self.frequent.get(stretch) or self.rare.get(stretch)
        if ids is None:
            if len(stretch) <= self.longest:
                raise KeyError(f"no ids came for {stretch!r}")
            ids = array("i", self.pieces.encode_word(stretch)).tobytes()
        return ids

    def encode(self, stretches: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if not len(stretches):
            return np.zeros(0, np.int32), np.zeros(len(first) - 1, np.int64)
        coded = stretches.dictionary_encode()
        each = list(map(self.of, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        which = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(each), np.int32)[ragged((np.cumsum(size) - size)[which], size[which])]
        ends = np.concatenate([[0], np.cumsum(size[which])])
        return ids, np.diff(ends[first])


def texts_of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for start in range(0, batch.num_rows, SLICE):
        part = batch.slice(start, SLICE)
        yield part, part.column(at).to_pylist()


def counted(batch: pa.RecordBatch, at: int, cutter: Cutter, longest: int) -> pa.Table:
    """(word, n): how often each stretch of `longest` characters or fewer occurs in a batch."""
    tables = []
    for _, texts in texts_of(batch, at):
        coded = cutter.cut(texts)[0].dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        tables.append(pa.table({"word": coded.dictionary.cast(pa.large_string()), "n": pa.array(n, pa.int64())}))
    if not tables:
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    out = pa.concat_tables(tables)
    out = out.filter(pc.less_equal(pc.utf8_length(out["word"]), longest)).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": out["word"].cast(pa.string()), "n": out["n_sum"]})


def stretch_counts(chunks: DataFrame, at: int, pieces: Pieces, longest: int) -> DataFrame:
    """(word, n): the distinct stretches of all texts, each counted in its chunk first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pieces)
        for batch in batches:
            for blob in batch.column(0):
                yield from counted(unpack(blob.as_py()), at, cutter, longest).to_batches()

    return arrow_map(chunks.select("blob"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """A count that `most` words reach at most."""
    grade = F.floor(F.log2("n") * 8)
    left, least = most, None
    for row in counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("grade")).collect():  # a few hundred grades at most
        if row["words"] > left:
            break
        left, least = left - row["words"], row["least"]
    return least if least is not None else 1 << 62


def lattice(words: DataFrame, spark: SparkSession, pieces: Pieces) -> DataFrame:
    """words with edges of all substrings that are pieces, in order of rank (better scores first).

    An edge is a struct (s, e, score, id), 0-based, or for "merges" a long of its rank, ends and id, from the top down. The
    empty substring at the start joins a row of its own, so that no word is lost.
    """
    rest = [c for c in words.columns if c != "word"]
    ranks = {x: i for i, x in enumerate(sorted({-score for _, _, score in pieces.pieces}))}
    rows = [(p, i, score, ranks[-score]) for p, i, score in pieces.pieces] + [("", -1, 0.0, 0)]
    table = spark.createDataFrame(rows, "piece string, id int, score double, rank long")  # as long as the vocabulary
    tasks = max(1, math.ceil(words.count() / A_TASK))
    starts = words.repartition(tasks, "word").select("word", *rest, F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    first = F.when(F.col("s") == 0, 0).otherwise(F.col("s") + 1)
    ends = starts.select("word", *rest, "s", F.explode(F.sequence(first, F.least(F.col("s") + pieces.width, F.length("word")))).alias("e"))
    parts = ends.withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
    if pieces.fold == "merges":
        if len(ranks) >= 1 << RANK_BITS or max((i for _, i, _ in pieces.pieces), default=0) >= 1 << ID_BITS:
            raise ValueError("more ranks or ids than an edge can hold")
        value = F.expr(f"shiftleft(shiftleft(shiftleft(rank, {PLACE_BITS}) + s, {PLACE_BITS}) + e, {ID_BITS}) + id")
    else:
        value = F.struct("s", "e", "score", "id")
    edge = F.when(F.col("e") > F.col("s"), value)
    return parts.join(F.broadcast(table), "piece").groupBy("word", *rest).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


START, END = (f"cast(shiftright(x, {ID_BITS + shift}) & {(1 << PLACE_BITS) - 1} as int)" for shift in (PLACE_BITS, 0))


def merge_bounds() -> Column:
    """Bounds of the segments of `word`: edges in order of score join two neighbouring segments each."""
    return F.expr(f"""
      aggregate(
        edges,
        sequence(0, length(word)),
        (bounds, x) -> CASE
          WHEN get(bounds, cast(array_position(bounds, {START}) as int) + 1) = {END} AND array_contains(bounds, {START})
          THEN array_remove(bounds, get(bounds, cast(array_position(bounds, {START}) as int)))
          ELSE bounds END)""")


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The columns of distinct words (word and any others), then ids, by the relational lattice."""
    cells = lattice(words, words.sparkSession, pieces)
    byte_ids = f"array({', '.join(map(str, pieces.byte_ids))})" if pieces.byte_ids else None
    last = f"transform(sequence(0, octet_length(c) - 1), k -> {byte_ids}[cast(conv(substring(hex(c), 2 * k + 1, 2), 16, 10) as int)])" if byte_ids else f"array({pieces.unknown})"
    if pieces.fold == "merges":
        places = F.expr(f"transform(edges, x -> shiftright(x, {ID_BITS}) & {(1 << 2 * PLACE_BITS) - 1})")
        cells = cells.withColumn("bounds", merge_bounds()).withColumn("places", places)
        known = f"transform(filter(array(array_position(places, cast(bounds[i] as bigint) * {1 << PLACE_BITS} + bounds[i + 1])), p -> p > 0), p -> array(cast(edges[cast(p as int) - 1] & {(1 << ID_BITS) - 1} as int)))"
    else:
        cells = cells.withColumn("best", viterbi_best(pieces.unknown_score())).withColumn("bounds", back_track())
        known = "transform(filter(edges, x -> x.s = bounds[i] AND x.e = bounds[i + 1]), x -> array(x.id))"
    segment = f"transform(sequence(0, size(bounds) - 2), i -> coalesce(get({known}, 0), get(transform(array(substring(word, bounds[i] + 1, 1)), c -> {last}), 0)))"
    return cells.select(*words.columns, F.expr(f"flatten({segment})").alias("ids"))


def viterbi_best(floor: float) -> Column:
    """For each end 0..n: the best sum (v) and the start of its last edge (b); of equal sums the smaller start."""
    return F.expr(f"""
      aggregate(
        sequence(1, length(word)),
        array(named_struct('v', 0D, 'b', 0)),
        (best, e) -> concat(best, array(aggregate(
          array_sort(concat(
            transform(filter(edges, x -> x.e = e), x -> named_struct('s', x.s, 'score', x.score)),
            CASE WHEN exists(edges, x -> x.e = e AND x.s = e - 1) THEN cast(array() as array<struct<s:int,score:double>>)
                 ELSE array(named_struct('s', e - 1, 'score', {floor!r}D)) END)),
          named_struct('v', cast('-Infinity' as double), 'b', 0),
          (top, x) -> CASE WHEN best[x.s].v + x.score > top.v THEN named_struct('v', best[x.s].v + x.score, 'b', x.s) ELSE top END))))""")


def back_track() -> Column:
    return F.expr("aggregate(sequence(1, length(word)), array(length(word)), (path, i) -> CASE WHEN path[0] = 0 THEN path ELSE concat(array(best[path[0]].b), path) END)")


def encode(df: DataFrame, pieces: Pieces | None = None, text: str = "text", most_words: int = MOST_WORDS, longest: int = LONGEST, decoded: bool = False) -> DataFrame:
    """One row per input row: its columns, then ids (array<int>), n_tokens and, if wanted, decoded: the text of the ids,
    made by the same pass; names that are taken get underscores.

    Null text: null ids, no tokens. Empty text: empty ids. Texts of any length are encoded whole. Equal texts have equal
    ids. Empty table: empty result.
    """
    if longest >= 1 << PLACE_BITS:
        raise ValueError(f"longest must be below {1 << PLACE_BITS}")
    pieces = pieces or Pieces.load()
    at = df.columns.index(text)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = pack(df, text, CHUNK_BYTES, total).select("chunk_id", "blob")
    counts = materialise(stretch_counts(chunks, at, pieces, longest), "stretches")
    known = materialise(encode_words(counts, pieces), "stretch-ids")
    least = frequent_from(counts, most_words)
    discard(counts)
    found = known.filter(F.col("n") >= least).select("word", "ids").toArrow()
    shared = df.sparkSession.sparkContext.broadcast(StretchIds(pieces, longest, ids_by_word(found["word"], found["ids"])))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, frequent = Cutter(shared.value.pieces), shared.value.frequent
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rare = [w for w in counted(unpack(blob.as_py()), at, cutter, longest)["word"].to_pylist() if w not in frequent]
                yield pa.record_batch([pa.array([chunk] * len(rare), pa.int64()), pa.array(rare, pa.string())], names=["chunk_id", "word"])

    told = arrow_map(chunks, ask, "chunk_id long, word string").join(known.filter(F.col("n") < least).select("word", "ids"), "word")
    replies = told.groupBy("chunk_id").agg(F.collect_list(F.struct("word", "ids")).alias("told"))
    ids_name = free_name("ids", df.columns)
    n_name = free_name("n_tokens", [*df.columns, ids_name])
    new = [(ids_name, "array<int>"), (n_name, "long")] + [(free_name("decoded", [*df.columns, ids_name, n_name]), "string")] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        cutter, decoder = Cutter(ids_of.pieces), Decoder(ids_of.pieces)
        for asked in batches:
            for blob, told in zip(asked.column(0), asked.column(1), strict=True):
                ids_of.rare = rare_ids(told)
                for part, texts in texts_of(unpack(blob.as_py()), at):
                    ids, n = ids_of.encode(*cutter.cut(texts))
                    null = np.array([t is None for t in texts])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32(), mask=np.append(null, False))
                    back = [pa.array([None if x else t for x, t in zip(null.tolist(), decoder.texts(ids, n), strict=True)], pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(n), *back], names=[*part.schema.names, *(c for c, _ in new)])
                pa.default_memory_pool().release_unused()

    met = chunks.join(replies.hint("shuffle_hash"), "chunk_id", "left").select("blob", "told")
    return arrow_map(met, run, extended(df, *new))


def ids_by_word(words: pa.ChunkedArray, ids: pa.ChunkedArray) -> dict[str, bytes]:
    """stretch -> ids as int32 bytes."""
    raw = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy(zero_copy_only=False) for c in ids.chunks)]).astype(np.int32).tobytes()
    ends = (np.cumsum(np.concatenate([np.zeros(0, np.int64), *(c.value_lengths().to_numpy() for c in ids.chunks)])) * 4).astype(np.int64).tolist()
    return {w: raw[a:b] for w, a, b in zip(words.to_pylist(), [0, *ends], ends, strict=False)}


def rare_ids(told: pa.ListScalar) -> dict[str, bytes]:
    """The answers to one chunk."""
    return ids_by_word(*(pa.chunked_array([told.values.field(i)]) for i in (0, 1))) if told.is_valid else {}


def decode(df: DataFrame, pieces: Pieces | None = None, ids: str = "ids") -> DataFrame:
    """One row per input row: its columns, then decoded (underscores if taken): the text of the ids; null stays null.

    The space put in front is taken off; ids out of range and null ids raise; bytes that are no UTF-8 become U+FFFD.
    """
    decoder = Decoder(pieces or Pieces.load())
    at = df.columns.index(ids)
    name = free_name("decoded", df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(at).value_lengths().fill_null(0).to_numpy()
            texts = decoder.texts(batch.column(at).flatten().to_numpy(zero_copy_only=False), n)
            out = [t if there else None for t, there in zip(texts, batch.column(at).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return arrow_map(df, run, extended(df, (name, "string")))


def token_digest(df: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decodes): ids joined by commas; whether decoding gives the text back."""
    pieces = pieces or Pieces.load()
    out = encode(df.select("doc_id", "text"), pieces, decoded=True)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("decodes"))
