"""Sources: files as rows, pages from files, page layouts, JSON lines, runs and label sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.functions.text import CHAPTER, clean, decode_text, effective_date, hashtags, join_lines, label_lines, mime_type, nfc, page_number, sniff, strip
from answerlens.schemas import CHECKS, ITEMS, RECORDS

# What marks a page of the template, and its margins in points.
DETAIL_MARKER = "추진배경"
FOOTER_POINTS, HEADER_POINTS = 40, 35


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(document_id, path, kind, mime_type, content_hash, content) of all files below the paths, hidden names left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    named = raw.select(nfc(F.url_decode(name)).alias("document_id"), "path", "content").filter(~F.col("document_id").startswith("."))
    kind = sniff(F.col("content"), F.col("document_id"))
    return named.withColumns({"kind": kind, "content_hash": F.sha2("content", 256)}).withColumn("mime_type", mime_type(F.col("kind"), F.col("document_id"))).select("document_id", "path", "kind", "mime_type", "content_hash", "content")


def text_pages(files: DataFrame) -> DataFrame:
    """(document_id, title, page, text): one page without number for each text file; files without text are left out."""
    title = F.regexp_replace("document_id", r"\.[^.]*$", "")
    pages = files.filter("kind = 'text'").select("document_id", title.alias("title"), F.lit(None).cast("int").alias("page"), clean(decode_text(F.col("content")), normalise=True).alias("text"))
    return pages.filter("text <> ''")


def extract(files: DataFrame, extractor: str = "generic") -> DataFrame:
    """Pages of files; a file of no known kind, or a template extractor on one that isn't a PDF, raises.

    PDF bytes need a reader that isn't part of this library: give its lines to layout_pages().
    """
    if extractor == "generic":
        bad = files.filter("kind IS NULL OR kind = 'pdf'").select(F.raise_error(F.concat(F.lit("unsupported: "), "document_id")).alias("e"))
        return text_pages(files).unionByName(bad.select(F.col("e").cast("string").alias("document_id"), F.lit("").alias("title"), F.lit(None).cast("int").alias("page"), F.lit("").alias("text")))
    raise ValueError(f"{extractor} works on layouts: use layout_pages()")


def layout_text(layout: DataFrame) -> DataFrame:
    """(document_id, title, page, text): the lines of each page of layout rows in order, cleaned; pages without text stay."""
    title = F.regexp_replace("document_id", r"\.[^.]*$", "")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n")
    return layout.groupBy("document_id", "page").agg(clean(lines, normalise=True).alias("text")).select("document_id", title.alias("title"), "page", "text")


def layout_pages(layout: DataFrame, strict: bool = True) -> DataFrame:
    """Pages of the policy template from layout rows (document_id, page, height, block, line, y0, text).

    Pages with the marker are kept; the chapter is carried forward over all pages; single lines at the top give the
    ministry, those between dashes the title, the foot gives the printed number. A page without one of these raises, or, if not strict,
    says so in another column, problem.
    """
    by_page = layout.groupBy("document_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n").alias("raw"), F.max("height").alias("height"))
    number, name = (F.regexp_extract("raw", CHAPTER, g) for g in (1, 2))
    chapter = F.when(number != "", F.concat(F.lit("제"), number, F.lit("장 "), strip(name)))
    carried = F.coalesce(F.last(chapter, ignorenulls=True).over(Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)), F.lit(""))
    pages = by_page.withColumn("chapter", carried).filter(F.col("raw").contains(DETAIL_MARKER)).select("document_id", "page", "height", "chapter")
    blocks = layout.groupBy("document_id", "page", "block").agg(F.sort_array(F.collect_list(F.struct("line", F.col("text").alias("t"), "y0"))).alias("lines"))
    blocks = blocks.filter(F.exists("lines", lambda x: strip(x["t"]) != "")).select("document_id", "page", "block", F.transform("lines", lambda x: F.struct(x["t"].alias("line"), x["y0"].cast("double").alias("y0"))).alias("lines"))
    rows = blocks.join(pages, ["document_id", "page"]).withColumn("y0", F.col("lines")[0]["y0"])
    single = F.when(F.size("lines") == 1, clean(F.col("lines")[0]["line"]))
    foot = F.col("y0") > F.col("height") - FOOTER_POINTS
    head = ~foot & (F.col("y0") < HEADER_POINTS) & (F.coalesce(single, F.lit("")) != "")
    rows = rows.withColumns({"single": single, "foot": foot, "head": head})
    first_head = F.min(F.when(F.col("head"), F.col("block"))).over(Window.partitionBy("document_id", "page"))
    rows = rows.withColumn("is_ministry", F.coalesce(F.col("block") == first_head, F.lit(False)))
    title = F.nullif(F.regexp_extract("single", r"^-\s*(.+?)\s*-$", 1), F.lit(""))
    printed = F.filter(F.transform("lines", lambda x: page_number(strip(x["line"]))), lambda n: n.isNotNull())
    body = ~F.col("foot") & ~F.col("is_ministry")
    out = rows.groupBy("document_id", "page", "chapter").agg(
        F.max_by(F.element_at(printed, -1), F.when(F.col("foot") & (F.size(printed) > 0), F.col("block"))).alias("printed_page"),
        F.max(F.when(F.col("is_ministry"), F.col("single"))).alias("ministry"),
        F.min_by(title, F.when(body & title.isNotNull(), F.col("block"))).alias("title"),
        F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.when(body, F.struct("block", clean(join_lines(F.col("lines"))).alias("t"))))), lambda x: x["t"]), lambda t: t != ""), "\n").alias("joined"),
    )
    text = label_lines(F.col("joined"))
    failed = F.col("printed_page").isNull() | F.col("ministry").isNull() | F.col("title").isNull()
    problem = F.when(failed, F.format_string("page %d: no printed number, ministry or title", "page"))
    out = out.withColumn("text", F.when(failed, F.raise_error(problem)).otherwise(text)) if strict else out.withColumns({"text": text, "problem": problem})
    return out.drop("joined").withColumns({"effective": effective_date(F.col("text")), "tags": hashtags(F.col("text"))})


def items(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """Gold items of the JSON-lines files that a manifest names; blank lines are skipped."""
    return spark.read.schema(ITEMS).option("mode", "PERMISSIVE").json([f"{folder}/{f}" for f in files]).filter("id IS NOT NULL OR type IS NOT NULL OR question IS NOT NULL")


def run_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, checks) of a saved run."""
    return spark.read.schema(RECORDS).parquet(f"{folder}/records"), spark.read.schema(CHECKS).parquet(f"{folder}/checks")


def label_sheet(lines: DataFrame, text: str = "value") -> DataFrame:
    """(id, check_id, verdict, memo) from the rows '| id#check | ... | verdict | memo |' of a label sheet.

    Bars behind a backslash are text. Verdicts are O, X, ?, 0, 1 or 2, in any case; an empty one is left out, any other
    raises.
    """
    cells = F.transform(F.split(F.col(text), r"(?<!\\)\|", -1), strip)
    key, at = F.get("c", F.lit(1)), lambda n: F.get("c", F.size("c") - n)
    rows = lines.select(cells.alias("c")).filter((F.size("c") >= 6) & key.rlike(r"^[^#\s]+#[A-Za-z0-9_]+$"))
    verdict = F.upper(at(3))
    known = F.when(verdict.isin("O", "X", "?", "0", "1", "2"), verdict).otherwise(F.raise_error(F.concat(F.lit("verdict out of place: "), key, F.lit(" "), verdict)))
    rows = rows.filter(verdict != "")
    of_key = lambda i: F.get(F.split(key, "#"), F.lit(i))
    return rows.select(of_key(0).alias("id"), of_key(1).alias("check_id"), known.alias("verdict"), F.replace(at(2), F.lit("\\|"), F.lit("|")).alias("memo"))
