"""Text functions as Column expressions; all but `nfc` and `strip_explanation` run in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and labels of the source documents that results depend on.
BULLETS = ("•", "-", "Q.", "*", "※", "☞", "#", "①", "②", "③", "④", "⑤", "⑥", "⑦", "⑧", "⑨", "⑩")
SENTENCE_ENDS = (".", "?", "!", ")", "]", "다", "요")
SECTION_LABELS = "추진배경|주요내용|기대효과|시 ?행 ?일"
NO_ANSWER = "[[NO_ANSWER]]"
EFFECTIVE_DATE = r"시행일:?\s*([^\n]+)"
OFFICES = "부|처|청|위원회|본부"
CHAPTER = r"제\s*(\d+)\s*장\.\s*(\S[^\n]*)"

MAGIC_PDF = "255044462D"


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no function for it, so this one runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return run(text)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column, normalise: bool = False) -> Column:
    """Control, format and private characters, doubled bullets, spare white space and empty lines are taken out."""
    t = nfc(text) if normalise else text
    t = F.regexp_replace(t, r"[\p{Cc}\p{Cf}\p{Co}&&[^\n\t]]", "")
    t = F.regexp_replace(t, "•+", "•")
    t = F.regexp_replace(t, r"(?Umd)^\s*-\s*-\s*", "- ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def sniff(content: Column, name: Column) -> Column:
    """'pdf' by its first bytes, 'text' for valid UTF-8 in .md and .txt files, else null."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    pdf = F.hex(F.substring(content, 1, 5)) == MAGIC_PDF
    return F.when(pdf, "pdf").when(suffix.isin(".md", ".txt") & F.is_valid_utf8(content.cast("string")), "text")


def mime_type(kind: Column, name: Column) -> Column:
    return F.when(kind == "pdf", "application/pdf").when(F.lower(name).endswith(".md"), "text/markdown").otherwise("text/plain")


def decode_text(content: Column) -> Column:
    """UTF-8 text without a byte order mark."""
    return F.regexp_replace(content.cast("string"), "^﻿", "")


def join_lines(lines: Column) -> Column:
    """One text of an array of (line, y0): cells of a row, sentences and broken words are told apart."""
    starts = lambda s: F.exists(F.array(*map(F.lit, BULLETS)), lambda b: s.startswith(b))
    ends = lambda s: F.exists(F.array(*map(F.lit, SENTENCE_ENDS)), lambda b: s.endswith(b))

    def step(state: Column, x: Column) -> Column:
        out, line = state["out"], x["line"]
        last = F.element_at(F.split(out, "\n"), -1)
        left = F.regexp_replace(out, r"(?U)\s+$", "")
        right = F.regexp_replace(line, r"(?U)^\s+", "")
        word = F.regexp_replace(last, r"(?U)\W", "")
        gap = F.when((F.length(word) <= 1) | word.rlike(f"^({SECTION_LABELS})"), " ").otherwise(" | ")
        same_row = state["y"].isNotNull() & (F.abs(x["y0"] - state["y"]) < 2)
        new_line = starts(right) | ends(left) | F.regexp_replace(last, r"(?U)^\s+", "").startswith("#")
        joined = F.when(out == "", line).when(same_row, F.concat(left, gap, right)).when(out.endswith(" "), F.concat(out, line)).when(new_line, F.concat(out, F.lit("\n"), line)).otherwise(F.concat(out, line))
        return F.struct(joined.alias("out"), x["y0"].cast("double").alias("y"))

    return F.aggregate(lines, F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("y")), step, lambda s: s["out"])


def label_lines(text: Column) -> Column:
    """Section labels in one spelling, each at the start of a line and followed by ': '."""
    plain, dated = SECTION_LABELS.rsplit("|", 1)
    t = F.regexp_replace(text, rf"(?U)\s*({plain})\s*\|\s*", "\n$1: ")
    t = F.regexp_replace(t, rf"(?U)\s*{dated}\s*\|\s*", "\n시행일: ")
    t = F.regexp_replace(t, rf"(?Umd)^({plain})\s*:?\s*", "$1: ")
    return F.regexp_replace(t, rf"(?Umd)^{dated}\s*:?\s*", "시행일: ")


def effective_date(text: Column) -> Column:
    found = F.regexp_extract(text, rf"(?U){EFFECTIVE_DATE}", 1)
    return F.when(found != "", strip(found))


def hashtags(text: Column) -> Column:
    """Tags of the first line of them, each cut before the name of an office; null without such a line."""
    line = F.regexp_extract(text, r"(?md)^#\s*[^\n]+$", 0)
    tags = F.transform(F.split(line, "[#,]"), lambda t: strip(F.split(t, rf"(?U)\s+(?=\S+(?:{OFFICES})\s)")[0]))
    return F.when(line != "", F.filter(tags, lambda t: t != ""))


def page_number(line: Column) -> Column:
    """Number at the start of a footer line, or after a bullet at its end."""
    first, last = (F.nullif(F.regexp_extract(line, r"^(\d+)(?:\s|$)|•\s*(\d+)$", g), F.lit("")) for g in (1, 2))
    return F.coalesce(first, last).cast("int")


def token_count(text: Column) -> Column:
    """Size measure: words and single marks. Any Column function of a text can take its place."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def hit_label(title: Column, page_start: Column, printed_page: Column, heading: Column) -> Column:
    """'title p.N (heading)'; page and heading only where there are any."""
    page = F.coalesce(printed_page.cast("string"), page_start.cast("string"))
    return F.concat(title, F.coalesce(F.concat(F.lit(" p."), page), F.lit("")), F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" ("), heading, F.lit(")"))).otherwise(""))


def sentences(answer: Column, least: int = 6) -> Column:
    """Sentences of at least `least` characters, without citation marks, bold marks and list bullets."""
    t = F.replace(F.regexp_replace(answer, r"(?U)\s*\[\d+\]", ""), F.lit("**"), F.lit(""))
    lines = F.transform(F.split(t, r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"), lambda x: strip(F.regexp_replace(x, r"(?U)^\s*(?:[-*•]|\d+\.)\s*", "")))
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"(?U)(?<=[.?!])\s+(?=\S)"), strip)))
    return F.filter(parts, lambda s: F.length(s) >= least)


def strip_explanation(text: Column) -> Column:
    """Without the balanced brackets at the end, however many; needs a walk from the right, so it runs in Arrow batches."""

    def one(t: str | None) -> str | None:
        while t and t.endswith(")"):
            depth = 0
            for i in range(len(t) - 1, -1, -1):
                depth += (t[i] == ")") - (t[i] == "(")
                if depth == 0:
                    break
            if depth:
                break
            t = t[:i].rstrip()
        return t

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(text)


def strip_reference(point: Column) -> Column:
    """Without the '(PDF p.N ...)' at the end, which may hold brackets one level deep."""
    return strip(F.regexp_replace(point, r"(?U)\s*\(PDF p\.[^()]*(?:\([^()]*\)[^()]*)*\)\s*$", ""))


def squeezed(text: Column, quotes: bool = False) -> Column:
    """For comparison: without white space; quotes: curly ones become straight."""
    t = F.regexp_replace(text, "[‘’“”]", "'") if quotes else text
    return F.regexp_replace(t, r"(?U)\s+", "")


def holds(text: Column, quote: Column, quotes: bool = False) -> Column:
    return squeezed(text, quotes).contains(squeezed(quote, quotes))


def find_page(pages: Column, quote: Column) -> Column:
    """Page of the first of (page, text) that holds the quote, else null."""
    return F.get(F.filter(pages, lambda p: holds(p["text"], quote)), F.lit(0))["page"]


def bigram_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct pairs of neighbouring word characters that the text has; 0 without pairs."""
    q, t = (F.regexp_replace(x, r"[^\p{L}\p{N}_]", "") for x in (question, text))
    grams = F.when(F.length(q) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(q) - 1), lambda i: q.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return share_of(grams, lambda g: t.contains(g))


def word_overlap(title: Column, question: Column) -> Column:
    """Share of the title's words of two characters or more that stand in the question; 0 without words."""
    words = F.filter(F.regexp_extract_all(title, F.lit(r"([\p{L}\p{N}_·]+)"), F.lit(1)), lambda w: F.length(w) >= 2)
    return share_of(words, lambda w: question.contains(w))


def share_of(values: Column, test) -> Column:
    return F.when(F.size(values) > 0, F.size(F.filter(values, test)) / F.size(values)).otherwise(0.0)


def cell(text: Column) -> Column:
    """One table cell: white space to single spaces, bars escaped."""
    return F.replace(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))


def quoted(text: Column) -> Column:
    """Lines behind '> '."""
    return F.array_join(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.when(strip(x) == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")


def escaped(text: Column) -> Column:
    """For HTML blocks in Markdown tables."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("|", "&#124;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def percent(value: Column) -> Column:
    """'12.3%', or '-' for null."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.format_string("%.1f", value * 100), F.lit("%")))


def percent_range(low: Column, high: Column) -> Column:
    """' (a–b%)', empty for null or equal ends."""
    return F.when(low.isNull() | (low == high), "").otherwise(F.concat(F.lit(" ("), F.format_string("%.0f", low * 100), F.lit("–"), F.format_string("%.0f", high * 100), F.lit("%)")))


def item_group(kind: Column) -> Column:
    return F.when(kind.isin("quant", "qual"), kind).otherwise("negative")


def check_kind(check_id: Column) -> Column:
    first = check_id.substr(1, 1)
    return F.when(check_id.isin("value", "grade"), check_id).when(first == "f", "fact").when(first == "m", "must_not").when(first == "s", "support")


def vote(answer: Column, criteria: Column | None = None) -> Column:
    """Probability of yes (1 or 0); with criteria (an array of choices) a map of choice to 1 or 0. Null if it is neither."""
    said = F.lower(strip(answer))
    if criteria is None:
        return F.when(said.isin("예", "yes", "true"), 1.0).when(said.isin("아니오", "아니요", "no", "false"), 0.0)
    return F.when(F.array_contains(criteria, said), F.map_from_arrays(criteria, F.transform(criteria, lambda c: (c == said).cast("double"))))


def tokens_cost(prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    """Price of a call, prices per million tokens."""
    return (prompt * price_in + completion * price_out) / 1e6
