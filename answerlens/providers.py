"""Model calls behind one seam. The providers here are offline stand-ins: they let every dataflow run and be tested, and
say nothing about answer quality."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlens.functions.text import NO_ANSWER

T = TypeVar("T")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        """(index, vector) of each text, in any order."""


class Generator(Protocol):
    def generate(self, system: str, user: str) -> tuple[list[str], int, int]:
        """Text in parts, and tokens of prompt and answer."""


class Judge(Protocol):
    def ask(self, answer: str, sources: str, checks: list[tuple[str, str, str]]) -> tuple[dict[str, float | dict[str, float]], int]:
        """Probability (or one for each choice) by check id, and tokens."""


class WordEmbedder:
    """Hashed bag of words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        out = []
        for i, t in enumerate(texts):
            v = np.zeros(self.dim)
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1 if h >> 16 & 1 else -1
            out.append((i, (v / max(1e-9, np.sqrt((v * v).sum()))).tolist()))
        return out


class FirstSourceGenerator:
    """The first sentence of the first source, cited; the no-answer mark without sources."""

    def generate(self, system: str, user: str) -> tuple[list[str], int, int]:
        m = re.search(r"\[1\] [^\n]*\n(.+)", user)
        said = f"{re.split(r'(?<=[.?!])\s', m[1])[0]} [1]" if m else NO_ANSWER
        return [said[i : i + 12] for i in range(0, len(said), 12)], len(user) // 4, len(said) // 4


class WordJudge:
    """Share of a target's words that the answer (or the sources, for support) has."""

    def ask(self, answer: str, sources: str, checks: list[tuple[str, str, str]]) -> tuple[dict[str, float | dict[str, float]], int]:
        words = lambda t: set(re.findall(r"\w+", t.lower()))
        out: dict[str, float | dict[str, float]] = {}
        for check_id, kind, target in checks:
            if kind == "grade":
                out[check_id] = {"2": 0.6, "1": 0.3, "0": 0.1}
            else:
                want, have = words(target), words(sources if kind == "support" else answer)
                out[check_id] = len(want & have) / max(1, len(want))
        return out, sum(len(t) for _, _, t in checks) // 4


def retried(call: Callable[[], T], attempts: int = 4, wait: float = 1.0, of: tuple[type[Exception], ...] = (OSError, ValueError), sleep: Callable[[float], None] = time.sleep) -> T:
    """call(), again after 1, 2, 4 ... times `wait` seconds when it fails in a way that may pass; the last failure raises."""
    for n in range(attempts):
        try:
            return call()
        except of:
            if n == attempts - 1:
                raise
            sleep(wait * 2**n)
    raise AssertionError


def said(error: Exception, most: int) -> str:
    """What a table says of an error: its kind and its words, `most` characters at most."""
    return f"{type(error).__name__}: {error}"[:most]


def embedded(df: DataFrame, text: str, embedder: Embedder, batch: int = 64, name: str = "embedding", failure: str = "") -> DataFrame:
    """df with a vector of each text. Calls hold `batch` texts; answers are put in order and checked for number and size.

    An error raises. With a column name in `failure` it goes there instead, beside a null vector: a batch that fails is
    asked again text by text, so that a bad text costs no other its vector.
    """
    added = f"`{name}` array<float>" + (f", `{failure}` string" if failure else "")
    schema = StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
    at = df.columns.index(text)

    def ask(texts: list[str]) -> list[list[float]]:
        found = dict(retried(lambda: embedder.embed(texts)))
        vectors = [found.get(i) for i in range(len(texts))]
        if len(found) != len(texts) or any(v is None or len(v) != embedder.dim for v in vectors):
            raise ValueError("the embedder's answer has another number or size of vectors")
        return vectors

    def ask_each(texts: list[str]) -> Iterator[tuple[list[float] | None, str | None]]:
        for t in texts:
            try:
                yield ask([t])[0], None
            except Exception as e:
                yield None, said(e, 120)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                try:
                    vectors, errors = ask(texts), [None] * len(texts)
                except Exception:
                    if not failure:
                        raise
                    vectors, errors = map(list, zip(*ask_each(texts), strict=True))
                new = [pa.array(vectors, pa.list_(pa.float32()))] + [pa.array(errors, pa.string())] * bool(failure)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, name] + [failure] * bool(failure))

    return df.mapInArrow(run, schema)


def generated(prompts: DataFrame, generator: Generator) -> DataFrame:
    """(request_id, seq, text, prompt_tokens, completion_tokens, latency_ms, error): deltas of each prompt (request_id, system,
    user). The last row of a prompt has the numbers and no text; where the call failed it is the only one and has the error."""
    kinds = {"request_id": pa.string(), "seq": pa.int64(), "text": pa.string(), "prompt_tokens": pa.int64(), "completion_tokens": pa.int64(), "latency_ms": pa.int64(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                began, parts, used, made, error = time.monotonic(), [], None, None, None
                try:
                    parts, used, made = retried(lambda r=r: generator.generate(r["system"], r["user"]))
                except Exception as e:
                    error = said(e, 300)
                took = max(1, round((time.monotonic() - began) * 1000))
                rows += [(r["request_id"], i, p, None, None, None, None) for i, p in enumerate(parts)] + [(r["request_id"], len(parts), None, used, made, took, error)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))

    schema = "request_id string, seq long, text string, prompt_tokens long, completion_tokens long, latency_ms long, error string"
    return prompts.select(F.col("request_id").cast("string").alias("request_id"), "system", "user").mapInArrow(run, schema)


def judged(requests: DataFrame, judge: Judge, repeats: int = 2) -> DataFrame:
    """Votes (id, repeat, check_id, kind, target, vote, p, probabilities, tokens) on requests
    (id, repeat, answer, sources, checks of (check_id, kind, target))."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.int64())
    names = ["id", "repeat", "check_id", "kind", "target", "vote", "p", "probabilities", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                asked = [(c["check_id"], c["kind"], c["target"]) for c in r["checks"]]
                for n in range(repeats):
                    votes, tokens = retried(lambda r=r, asked=asked: judge.ask(r["answer"], r["sources"], asked), attempts=3)
                    for i, (check_id, kind, target) in enumerate(asked):
                        v = votes[check_id]
                        grade = list(v.items()) if isinstance(v, dict) else None
                        rows.append((r["id"], r["repeat"], check_id, kind, target, n, None if grade else float(v), grade, 0 if i else tokens))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return requests.select("id", "repeat", "answer", "sources", "checks").mapInArrow(run, "id string, repeat int, check_id string, kind string, target string, vote int, p double, probabilities map<string,double>, tokens long")


class Drafter(Protocol):
    def draft(self, kind: str, text: str) -> dict[str, object]:
        """For 'quant': question_literal, question_user, answer, quote; for 'trap': question; for 'qual': question and
        must_include of (point, quote); or skip with a reason."""


class SentenceDrafter:
    """Questions about a sentence with a number in it, by a fixed pattern."""

    def draft(self, kind: str, text: str) -> dict[str, object]:
        parts = [s.strip() for s in re.split(r"(?<=[.?!])\s+", text) if len(s.split()) > 3]
        if kind == "trap":
            return {"question": f"Is it right that it is {text}?"}
        if kind == "qual":
            return {"question": "What does the passage say?", "must_include": [{"point": s, "quote": s} for s in parts[:3]]} if len(parts) > 1 else {"skip": "too short"}
        for s in parts:
            if m := re.search(r"\d[\d,.]*\d|\d", s):
                topic = " ".join(re.findall(r"[^\W\d]+", s)[:4])
                return {"question_literal": f"What number belongs to: {topic}?", "question_user": f"How many, about {topic}?", "answer": m[0], "quote": s}
        return {"skip": "no number"}


DRAFT = "skip string, question string, question_literal string, question_user string, answer string, quote string, must_include array<struct<point:string,quote:string>>"


def drafted(df: DataFrame, drafter: Drafter, kind: str, text: str) -> DataFrame:
    """df with the columns of DRAFT: what the drafter makes of each text; fields it doesn't give are null."""
    fields = StructType.fromDDL(DRAFT)
    at = df.columns.index(text)
    kinds = {"must_include": pa.list_(pa.struct([("point", pa.string()), ("quote", pa.string())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [retried(lambda t=t: drafter.draft(kind, t or ""), attempts=3) for t in b.column(at).to_pylist()]
            new = [pa.array([m.get(f.name) for m in made], kinds.get(f.name, pa.string())) for f in fields]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *fields.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *fields.fields]))
