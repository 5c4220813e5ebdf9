"""Evidence: which hits cover which evidence, ranks of the first, and retrieval curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even
from answerlens.functions.text import item_group, squeezed


def covers(hit: Column, evidence: Column, content: str = "content") -> Column:
    """Same document, and the page inside the hit's pages; only where either page is unknown, the quote in its content."""
    pages = evidence["page"].isNotNull() & hit["page_start"].isNotNull()
    inside = evidence["page"].between(hit["page_start"], F.coalesce(hit["page_end"], hit["page_start"]))
    quote = (F.coalesce(evidence["quote"], F.lit("")) != "") & squeezed(hit[content]).contains(squeezed(evidence["quote"]))
    return (hit["document_id"] == evidence["document_id"]) & F.coalesce(F.when(pages, inside).otherwise(quote), F.lit(False))


def retrieved_any(hits: Column, evidence: Column) -> Column:
    return F.exists(evidence, lambda e: F.exists(hits, lambda h: covers(h, e)))


def first_rank(hits: Column, evidence: Column) -> Column:
    """Position from 1 of the first hit that covers any of the evidence, else null."""
    at = F.array_position(F.transform(hits, lambda h: F.exists(evidence, lambda e: covers(h, e))), True)
    return F.when(at > 0, at.cast("int"))


def item_evidence(item: dict[str, Column] | None = None) -> Column:
    """All evidence of an item: that of its points for qualitative ones."""
    c = item or {n: F.col(n) for n in ("type", "must_include", "evidence")}
    none = F.array().cast("array<struct<document_id:string,page:int,quote:string>>")
    return F.when(c["type"] == "qual", F.flatten(F.transform(F.coalesce(c["must_include"], F.array().cast("array<struct<point:string,facts:array<string>,evidence:array<struct<document_id:string,page:int,quote:string>>>>")), lambda p: F.coalesce(p["evidence"], none)))).otherwise(F.coalesce(c["evidence"], none))


def units(items: DataFrame) -> DataFrame:
    """(id, group, unit, evidence): any evidence of a unit is enough; points are the units of qualitative items."""
    qual = items.filter("type = 'qual'").select("id", item_group(F.col("type")).alias("group"), F.posexplode("must_include").alias("unit", "point")).select("id", "group", "unit", F.col("point.evidence").alias("evidence"))
    rest = items.filter("type <> 'qual' AND size(coalesce(evidence, array())) > 0").select("id", item_group(F.col("type")).alias("group"), F.lit(0).alias("unit"), "evidence")
    return qual.unionByName(rest)


def unit_ranks(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, group, unit, rank): the first ref whose hit covers the unit, null if none does. hits: a row per (id, ref)."""
    asked = units(items)
    flat = asked.select("id", "unit", F.explode("evidence").alias("e")).withColumn("document_id", F.col("e.document_id"))
    found = flat.join(hits, ["id", "document_id"])  # equal keys; the rest of the test is a filter
    hit = F.struct(F.col("document_id"), F.col("page_start"), F.col("page_end"), F.col("content"))
    ranks = found.filter(covers(hit, F.col("e"))).groupBy("id", "unit").agg(F.min("ref").alias("rank"))
    return asked.select("id", "group", "unit").join(ranks, ["id", "unit"], "left").select("id", "group", "unit", "rank")


def curve(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """(group, k, items, units, hit, recall) from (id, group, unit, rank) at the largest k, for each group and 'total'.

    hit: share of items of which a unit ranks k or better; recall: share of units. Groups without items have no rows.
    """
    at = ranks.select("id", "group", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    by_item = at.groupBy("id", "group", "k").agg(F.count("*").alias("units"), F.count_if(F.col("rank") <= F.col("k")).alias("found"))
    both = by_item.groupingSets([["group", "k"], ["k"]], "group", "k").agg(
        F.count("*").alias("items"), F.sum("units").alias("units"),
        half_even(F.avg((F.col("found") > 0).cast("double"))).alias("hit"), half_even(F.sum("found") / F.sum("units")).alias("recall"),
    )
    return both.select(F.coalesce("group", F.lit("total")).alias("group"), "k", "items", "units", "hit", "recall")


def missing(ranks: DataFrame) -> DataFrame:
    """Units that no hit covers."""
    return ranks.filter("rank IS NULL").select("id", "unit")


def reciprocal_rank(ranks: DataFrame, k: int, by: str = "group") -> DataFrame:
    """(by, n, hit, mrr) over the first rank of each item, ranks beyond k counted as none."""
    first = ranks.groupBy("id", by).agg(F.min("rank").alias("rank"))
    got = F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)
    return first.groupBy(by).agg(F.count("*").alias("n"), half_even(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))).alias("hit"), half_even(F.avg(got)).alias("mrr"))


def quote_hits(documents: DataFrame, quotes: DataFrame, doc_id: str, text: str, quote_id: str, quote: str, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, quote_id) where a document holds a quote, white space aside.

    All quotes of a block are looked for in one pass over a text (Aho-Corasick), so the cost of a text doesn't grow with
    the number of quotes. The bytes of the quotes are summed first; more than a block's worth takes several passes.
    """
    wanted = quotes.select(F.col(quote_id).cast("long").alias("q"), squeezed(F.col(quote)).alias("t")).filter("t <> ''")
    total = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    rows = documents.select(F.col(doc_id).cast("long").alias("d"), squeezed(F.col(text)).alias("t"))
    out = None
    for block in range(blocks):
        part = [(r.q, r.t) for r in wanted.filter(F.pmod(F.xxhash64("q", "t"), F.lit(blocks)) == block).collect()]
        found = rows.mapInArrow(_quote_finder(part), "d long, q long")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("d").alias(doc_id), F.col("q").alias(quote_id))


def _quote_finder(quotes: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list[int]] = {}
        for q, t in quotes:
            of.setdefault(t, []).append(q)
        automaton = ahocorasick.Automaton()
        for t, ids in of.items():
            automaton.add_word(t, ids)
        automaton.make_automaton()
        for batch in batches:
            docs, found = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = sorted({q for _, ids in automaton.iter(t) for q in ids}) if t and of else []
                docs += [d] * len(hits)
                found += hits
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["d", "q"])

    return run
