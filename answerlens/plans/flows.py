"""The dataflows end to end: ingest, answer, evaluate, generate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from answerlens.operators import answer as A
from answerlens.operators import checks as C
from answerlens.operators import chunking, ingest
from answerlens.operators import goldgen as G
from answerlens.operators.evidence import curve, unit_ranks
from answerlens.operators.goldset import approved, document_problems
from answerlens.operators.scoring import score
from answerlens.operators.vectors import gate, hit_list, retrieve
from answerlens.providers import Drafter, Embedder, Generator, Judge, drafted, embedded, generated, judged
from answerlens.schemas import CHUNKS, DOCUMENTS, RECORDS
from answerlens.settings import Settings
from answerlens.sources.files import layout_pages, layout_text, scan, text_pages
from answerlens.storage import materialise


def extracted(files: DataFrame, layouts: DataFrame | None, settings: Settings) -> DataFrame:
    """(document_id, title, page, text, ..., problem): the pages of files, as the settings' extractor and chunker need them.

    PDF files get their pages from layouts, rows of sources.files.layout_pages(). problem says why a page can't be used: a
    file without a layout, or a template asked of a file that has none, has one page with a problem and no text.
    """
    empty = lambda df, why: df.select("document_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page"), F.lit("").alias("text"), F.lit(why).alias("problem"))
    plain, pdf = files.filter("kind = 'text'"), files.filter("kind = 'pdf'")
    known = pdf.join(layouts.select("document_id").distinct(), "document_id", "left_semi") if layouts is not None else pdf.limit(0)
    unread = empty(pdf.join(known.select("document_id"), "document_id", "left_anti"), "no layout for this PDF")
    if settings.extractor == "policy_book":
        pages = empty(plain, "the policy template needs a PDF")
        if layouts is not None:
            pages = layout_pages(layouts.join(known.select("document_id"), "document_id", "left_semi"), strict=False).unionByName(pages, allowMissingColumns=True)
    else:
        pages = text_pages(files).withColumn("problem", F.lit(None).cast("string"))
        if layouts is not None:
            pages = pages.unionByName(layout_text(layouts.join(known.select("document_id"), "document_id", "left_semi")), allowMissingColumns=True)
    pages = pages.unionByName(unread, allowMissingColumns=True)
    if settings.chunker == "policy":
        templated = F.lit("chapter" in pages.columns) & (F.col("text") != "")
        why = F.when(templated, chunking.policy_problem()).otherwise("policy chunks need pages of the policy template")
        return pages.withColumn("problem", F.coalesce("problem", why))
    return pages.withColumn("title", F.regexp_replace("document_id", r"\.[^.]*$", ""))


def ingest_files(spark: SparkSession, paths: list[str], catalog: ingest.Catalog, embedder: Embedder, settings: Settings, force: bool = False, dry_run: bool = False, layouts: DataFrame | None = None) -> DataFrame:
    """Files below the paths into the catalog; returns (document_id, status, pages, chunks, tokens, note), one row a file.

    A file whose pages can't be read, chunked or embedded is failed, with the first reason in its note (120 characters); it
    changes nothing in the catalog, and others go on. PDF files need layouts (see extracted()) and are unsupported without.
    Nothing is written in a dry run, and nothing embedded.
    """
    version = settings.index_version
    kinds = ["text"] if layouts is None else ["text", "pdf"]
    files = scan(spark, paths).withColumn("kind", F.when(F.col("kind").isin(kinds), F.col("kind")))
    old_documents, old_chunks = catalog.documents(), catalog.chunks()
    planned = materialise(ingest.plan(files.select("document_id", "kind", "mime_type", "content_hash", "path"), old_documents, old_chunks, version, force), "ingest-plan")
    todo = planned.filter(F.col("status").isin("ingested", "replaced")).select("document_id")
    pages = materialise(extracted(files.join(todo, "document_id", "left_semi"), layouts, settings), "pages")
    read = pages.groupBy("document_id").agg(F.countDistinct("page").alias("pages"), F.min("problem").alias("unread"))
    whole = pages.join(read.filter("unread IS NULL").select("document_id"), "document_id", "left_semi")
    policy = settings.chunker == "policy" and "chapter" in pages.columns
    cut = chunking.chunk(whole, settings.chunker, settings.chunk_tokens, settings.chunk_overlap) if policy or settings.chunker != "policy" else chunking.split_chunks(whole.limit(0))
    made = materialise(cut, "chunks")
    vectors = made if dry_run else materialise(embedded(made, "embed_text", embedder, failure="failure"), "vectors")
    lost = vectors.groupBy("document_id").agg(F.min("failure").alias("lost")) if not dry_run else read.select("document_id", F.lit(None).cast("string").alias("lost"))
    counts = made.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.median("token_count").alias("p50"), F.max("token_count").alias("most"))
    done = planned.join(read, "document_id", "left").join(lost, "document_id", "left").join(counts, "document_id", "left")
    work, why = F.col("status").isin("ingested", "replaced"), F.substring(F.coalesce("unread", "lost"), 1, 120)
    status = F.when(work & why.isNotNull(), "failed").when(work & F.lit(dry_run), "dry-run").otherwise(F.col("status"))
    note = F.when(work, F.coalesce(why, F.format_string("p50 %.0f max %d", F.col("p50"), F.col("most")), F.lit("no text")))
    count = lambda c: F.when(why.isNull(), F.col(c))
    result = materialise(done.select("document_id", status.alias("status"), *[F.coalesce(count(c), F.lit(0)).alias(c) for c in ("pages", "chunks", "tokens")], note.alias("note")), "ingest-result")
    if not dry_run:
        good = planned.join(result.filter("status IN ('ingested', 'replaced')").select("document_id"), "document_id", "left_semi")
        catalog.commit(*committed(old_documents, old_chunks, good, vectors, whole, read, version))
    return result


def committed(old_documents: DataFrame, old_chunks: DataFrame, good: DataFrame, vectors: DataFrame, pages: DataFrame, read: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """The catalog's documents and chunks after the planned files that went well."""
    meta = StructType.fromDDL(CHUNKS)["meta"].dataType
    of_page = [f.name for f in meta.fields if f.name not in ("heading", "token_count") and f.name in pages.columns and "chapter" in pages.columns]
    rows = vectors.drop("title").join(good.select("document_id"), "document_id", "left_semi")
    if of_page and "heading" in vectors.columns:
        rows = rows.join(pages.select("document_id", F.col("page").alias("page_start"), *of_page), ["document_id", "page_start"], "left")
    fields = [(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in meta.fields]
    rows = rows.select("document_id", F.lit(version).alias("index_version"), "ord", "content", "embed_text", "page_start", "page_end", F.struct(*fields).alias("meta"), "embedding")
    counted = F.when(F.col("kind") == "pdf", F.col("pages"))
    new = good.join(read, "document_id", "left").select(F.col("document_id").alias("id"), F.regexp_replace("document_id", r"\.[^.]*$", "").alias("title"), F.col("path").alias("source"), "mime_type", "content_hash", counted.alias("page_count"), F.current_timestamp().alias("created_at"))
    to = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema).fields])
    return to(ingest.upserted(old_documents, new), DOCUMENTS), to(ingest.merged_chunks(old_chunks, good, to(rows, CHUNKS), version), CHUNKS)


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with a chunk_id that their key gives."""
    return chunks.withColumn("chunk_id", F.xxhash64("document_id", "index_version", "ord"))


def answer(questions: DataFrame, catalog: ingest.Catalog, embedder: Embedder, generator: Generator, settings: Settings, top_k: int = 0) -> DataFrame:
    """(question_id, question, status, answer, citations, retrieved, warnings, usage, top_score, latency_ms, error) of questions
    (question_id, question).

    Questions without a hit of the least score never reach the generator. top_k 0 means the default. A question whose
    embedding or generation fails has the status error, and others go on. latency_ms is the generator's time: search is done
    for all questions together and has no time of its own.
    """
    k = top_k or settings.top_k
    asked = materialise(embedded(questions.select("question_id", "question"), "question", embedder, failure="failure"), "questions")
    hits = materialise(retrieve(asked, with_chunk_ids(catalog.chunks()), catalog.documents(), settings.index_version, k), "hits")
    gates = gate(asked, hits, settings.min_score)
    lists = asked.select("question_id", "question", "failure").join(hit_list(hits), "question_id", "left").join(gates, "question_id")
    prompts = lists.filter("status = 'open'").select(F.col("question_id").alias("request_id"), A.messages(F.col("question"), F.col("retrieved"), settings.prompt_version).alias("m")).select("request_id", "m.*")
    deltas = materialise(generated(prompts, generator), "deltas")
    done = A.final_status(deltas).join(deltas.groupBy("request_id").agg(F.max("prompt_tokens").alias("prompt_tokens"), F.max("completion_tokens").alias("completion_tokens"), F.max("latency_ms").alias("latency_ms"), F.max("error").alias("error")), "request_id")
    rows = lists.join(done.withColumnsRenamed({"request_id": "question_id", "answer": "said", "status": "said_status"}).withColumn("question_id", F.col("question_id").cast(questions.schema["question_id"].dataType)), "question_id", "left")
    error = F.coalesce("error", "failure")
    status = F.when(error.isNotNull(), "error").otherwise(F.coalesce("said_status", F.lit("insufficient_context")))
    checked = A.check_citations(F.coalesce("said", F.lit("")), F.coalesce("retrieved", F.array().cast(StructType.fromDDL(RECORDS)["retrieved"].dataType)))
    ok = status == "answered"
    rows = rows.withColumn("checked", checked)
    return rows.select("question_id", "question", status.alias("status"), F.when(ok, F.col("checked.answer")).otherwise("").alias("answer"), F.when(ok, F.col("checked.citations")).otherwise(F.array()).alias("citations"), "retrieved", F.when(ok, F.col("checked.warnings")).otherwise(F.array()).alias("warnings"), F.struct("prompt_tokens", "completion_tokens").alias("usage"), "top_score", "latency_ms", error.alias("error"))


def evaluate(items: DataFrame, catalog: ingest.Catalog, embedder: Embedder, generator: Generator, judge: Judge, settings: Settings, repeats: int = 1, wanted: DataFrame | None = None, first: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, checks, scored) of the approved items, each asked `repeats` times. Problems with gold documents raise.

    With `first`, only that many items, by id. An index version without chunks is filled from settings.corpus_dir first.
    """
    spark = items.sparkSession
    if not catalog.count(settings.index_version):
        filled = ingest_files(spark, [settings.corpus_dir], catalog, embedder, settings)
        if failed := filled.filter("status = 'failed'").limit(20).collect():
            raise ValueError(f"ingest of {settings.corpus_dir}: {failed}")
    if wanted is not None and (problems := document_problems(wanted, catalog.documents()).limit(20).collect()):
        raise ValueError(f"gold documents: {problems}")
    gold = approved(items)
    gold = materialise(gold.orderBy("id").limit(first), "first-items") if first else gold
    asked = gold.select("id", "question", "type").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("question_id", F.xxhash64("id", "repeat"))
    answered = answer(asked, catalog, embedder, generator, settings)
    records = asked.join(answered.drop("question"), "question_id").withColumn("group", F.when(F.col("type").isin("quant", "qual"), F.col("type")).otherwise("negative"))
    records = materialise(records.select("id", "group", "type", F.col("repeat").cast("int").alias("repeat"), "question", "status", "answer", "retrieved", "citations", "warnings", "usage", "latency_ms", "error", F.lit(0).cast("long").alias("judge_tokens")), "records")
    checks = rejudge(gold, records, judge, settings)
    return records, checks, score(gold, records, checks, settings)


def rejudge(items: DataFrame, records: DataFrame, judge: Judge, settings: Settings) -> DataFrame:
    """Checks of stored answers by a judge."""
    expanded = C.requests(C.expand(items, records))
    sources = records.select("id", "repeat", "answer", F.array_join(F.transform("retrieved", lambda h: h["content"]), "\n").alias("sources"))
    calls = expanded.groupBy("id", "repeat", "request").agg(F.sort_array(F.collect_list(F.struct("check_id", "kind", "target"))).alias("checks")).join(sources, ["id", "repeat"])
    return materialise(C.votes_mean(judged(calls, judge, settings.judge_repeats)), "checks")


def retrieval_curve(items: DataFrame, catalog: ingest.Catalog, embedder: Embedder, settings: Settings, ks: list[int]) -> DataFrame:
    """Hit rate and recall at each k; ranks are computed once, at the largest."""
    gold = approved(items)
    questions = gold.select(F.xxhash64("id").alias("question_id"), "id", "question")
    vectors = embedded(questions, "question", embedder)
    hits = retrieve(vectors, with_chunk_ids(catalog.chunks()), catalog.documents(), settings.index_version, max(ks)).join(questions.select("question_id", "id"), "question_id")
    return curve(unit_ranks(gold, hits), ks)


def draft_gold(pages: DataFrame, drafter: Drafter, n_quant: int, n_qual: int, n_traps: int, seed: int = 0, window_tokens: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(items, rejects): draft gold items from pages (document_id, title, page, text), all mechanically checked.

    Windows are picked evenly over the corpus, drafted, and checked against their own text; traps are accepted answers
    made wrong. Every item is a draft for a person to approve.
    """
    made = materialise(chunking.split_chunks(pages, window_tokens, 0), "windows")
    windows = made.select(F.concat_ws(":", "document_id", F.lpad(F.col("ord").cast("string"), 8, "0")).alias("window"), "document_id", F.when(F.col("page_start") == F.col("page_end"), F.col("page_start")).alias("page"), F.col("content").alias("text"))

    def picked(n: int, turn: int) -> DataFrame:
        """Candidates in the order they are tried: eight times as many as wanted."""
        return materialise(G.stratified(windows, n, "window", "window", seed + turn).filter(F.col("pick") <= n * 8), "picked")

    def accepted(checked: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        done = materialise(checked, "drafts")
        return G.first_passing(done, "pick", F.col("reason").isNull(), n), done.filter("reason IS NOT NULL").select("window", "reason")

    evidence = lambda quote: F.array(F.struct("document_id", F.col("page").cast("int").alias("page"), quote.alias("quote")))
    quant, no_quant = accepted(G.check_quant(drafted(picked(n_quant, 0), drafter, "quant", "text")), n_quant)
    quant = materialise(quant, "quant")
    literal, user = (quant.select(F.concat("window", F.lit(f"-{v}")).alias("id"), F.lit("quant").alias("type"), F.lit(v).alias("variant"), F.col(f"question_{v}").alias("question"), "answer", evidence(F.col("quote")).alias("evidence")) for v in ("literal", "user"))
    traps = G.with_traps(quant).select("window", "pick", "wrong", "token", "answer")
    asked = drafted(traps.drop("answer"), drafter, "trap", "wrong").select("window", "pick", "token", "question").join(traps.select("window", "answer"), "window")
    checked, no_trap = accepted(G.check_trap(asked), n_traps)
    trap = checked.select(F.concat("window", F.lit("-trap")).alias("id"), F.lit("false_premise").alias("type"), "question", F.lit("answered").alias("expected_status"), F.create_map(*[F.lit(x) for x in ("2", "corrects the premise", "1", "declines", "0", "accepts the premise")]).alias("scoring"))
    qual, no_qual = accepted(G.check_qual(drafted(picked(n_qual, 1), drafter, "qual", "text")), n_qual)
    points = F.transform("must_include", lambda p: F.struct(p["point"].alias("point"), F.array(p["point"]).alias("facts"), F.array(F.struct(F.col("document_id"), F.col("page").cast("int").alias("page"), p["quote"].alias("quote"))).alias("evidence")))
    qual = qual.select(F.concat("window", F.lit("-qual")).alias("id"), F.lit("qual").alias("type"), "question", points.alias("must_include"))
    items = literal.unionByName(user).unionByName(trap, allowMissingColumns=True).unionByName(qual, allowMissingColumns=True)
    rejects = no_quant.unionByName(no_trap).unionByName(no_qual)
    return materialise(items.withColumns({"status": F.lit("draft"), "provenance": F.lit("generated")}), "gold-drafts"), rejects
