"""Answers: prompts, citation checks, and the event protocol of an answer stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.metrics import half_even
from answerlens.functions.text import NO_ANSWER, hit_label, strip

#: Own wording; what matters is the rule set of each version.
PROMPTS = {
    "v1": f"Answer from the sources alone. Put the number of its source behind every claim, like [1]. If the sources can't answer, write only {NO_ANSWER}.",
    "v2": f"Answer from the sources alone. Put the number of its source behind every claim, like [1]. Apply conditions to the asker's case, correct false premises, answer the part that can be answered and name the rest. Only if nothing in the sources bears on the question, write only {NO_ANSWER}.",
    "v3": f"Answer from the sources alone. Put the number of its source behind every claim, like [1]. Apply conditions to the asker's case, and say so if a rule isn't in force at that time; correct false premises, answer the part that can be answered and name the rest. Only if nothing in the sources bears on the question, write only {NO_ANSWER}.",
}


def source_block(hits: Column) -> Column:
    """Numbered sources in order of ref, a blank line between them."""
    one = lambda h: F.concat(F.lit("["), h["ref"].cast("string"), F.lit("] "), hit_label(h["title"], h["page_start"], h["printed_page"], h["heading"]), F.lit("\n"), h["content"])
    return F.array_join(F.transform(hits, one), "\n\n")


def messages(question: Column, hits: Column, version: str = "v1") -> Column:
    """(system, user) of a model call."""
    return F.struct(F.lit(PROMPTS[version]).alias("system"), F.concat(F.lit("[Sources]\n"), source_block(hits), F.lit("\n\n[Question]\n"), question).alias("user"))


def cited_numbers(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))


def check_citations(answer: Column, hits: Column) -> Column:
    """(answer, refs, invalid, citations, warnings).

    refs: distinct valid numbers in order of first appearance; invalid ones are taken out of the text and named in a
    warning; an answer without valid numbers gets another.
    """
    all_refs = F.array_distinct(cited_numbers(answer))
    known = F.transform(hits, lambda h: h["ref"])
    refs, invalid = F.filter(all_refs, lambda n: F.array_contains(known, n)), F.sort_array(F.filter(all_refs, lambda n: ~F.array_contains(known, n)))
    text = strip(F.aggregate(invalid, answer, lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit(""))))
    citation = lambda h: F.struct(*[h[n].alias(n) for n in ("ref", "document_id", "title", "page_start", "page_end", "printed_page", "heading")], h["content"].substr(1, 200).alias("snippet"), half_even(h["score"]).alias("score"))
    cited = F.transform(refs, lambda n: citation(F.get(F.filter(hits, lambda h: h["ref"] == n), F.lit(0))))
    unknown = F.when(F.size(invalid) > 0, F.concat(F.lit("unknown source numbers removed: ["), F.array_join(F.transform(invalid, lambda n: n.cast("string")), ", "), F.lit("]")))
    warnings = F.filter(F.array(unknown, F.when(F.size(refs) == 0, "answer without citations")), lambda w: w.isNotNull())
    return F.struct(text.alias("answer"), refs.alias("refs"), invalid.alias("invalid"), cited.alias("citations"), warnings.alias("warnings"))


def shown_deltas(deltas: DataFrame, request: str = "request_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """What a reader of the stream sees: (request_id, seq, shown), shown null where nothing is emitted.

    While the text so far may still become the no-answer mark nothing goes out; with the first character that differs
    the whole buffer does, and every later delta as it is. Empty deltas emit nothing.
    """
    order = Window.partitionBy(request).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.concat_ws("", F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(order))
    held = F.lit(NO_ANSWER).startswith(strip(F.col("__so_far")))
    before = F.coalesce(F.lag("__held").over(Window.partitionBy(request).orderBy(seq)), F.lit(True))
    rows = deltas.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("__so_far", so_far).withColumn("__held", held)
    shown = F.when(~F.col("__held"), F.when(before, F.col("__so_far")).otherwise(F.col(text)))
    return rows.select(request, seq, shown.alias("shown"))


def final_status(deltas: DataFrame, request: str = "request_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """(request_id, answer, status): insufficient_context if the mark stands anywhere in the whole text."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), "")
    done = deltas.groupBy(request).agg(whole.alias("answer"))
    return done.withColumn("status", F.when(F.col("answer").contains(NO_ANSWER), "insufficient_context").otherwise("answered"))
