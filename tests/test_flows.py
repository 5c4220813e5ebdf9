import datetime

import pytest
from pyspark.sql import functions as F

from answerlens.operators.ingest import Catalog
from answerlens.operators.metrics import headline
from answerlens.plans.flows import answer, evaluate, ingest_files, retrieval_curve
from answerlens.providers import FirstSourceGenerator, WordEmbedder, WordJudge, embedded, retried
from answerlens.settings import Settings
from answerlens.sources import files as S
from answerlens.sources import sinks as K
from answerlens.streaming.answers import hold_back, sessions, windowed
from test_operators import gold, rows, scored_run
from answerlens.operators.scoring import score
from answerlens.schemas import ITEMS

SETTINGS = Settings(embed_dim=64, chunk_tokens=30, chunk_overlap=5, top_k=3)


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("The ferry leaves at nine. It costs twenty coins.\n\nDogs travel free of charge on weekdays.")
    (tmp_path / "in/b.txt").write_text("Solar panels need cleaning twice a year. " * 20)
    (tmp_path / "in/c.png").write_bytes(b"\x89PNG\xff")
    (tmp_path / "in/.hidden.md").write_text("no")
    return tmp_path


def test_ingest_and_answer(spark, corpus):
    catalog = Catalog(spark, str(corpus / "store"))
    load = lambda s=SETTINGS, **k: {r.document_id: (r.status, r.chunks) for r in ingest_files(spark, [str(corpus / "in")], catalog, WordEmbedder(), s, **k).collect()}
    dry = load(dry_run=True)
    assert dry["a.md"][0] == "dry-run" and dry["c.png"][0] == "unsupported" and len(dry) == 3 and catalog.documents().count() == 0
    first = load()
    assert first["a.md"] == ("ingested", 1) and first["b.txt"][1] > 1
    assert load()["a.md"][0] == "skipped" and load(force=True)["a.md"][0] == "ingested"
    other = SETTINGS.replaced({"chunk_tokens": "20"})
    assert load(other)["a.md"][0] == "ingested"
    assert catalog.chunks().select("index_version").distinct().count() == 2
    (corpus / "in/a.md").write_text("The ferry leaves at ten. It costs thirty coins.")
    assert load()["a.md"][0] == "replaced"
    assert catalog.chunks().filter("document_id = 'a.md'").select("index_version").distinct().count() == 1
    assert catalog.count(SETTINGS.index_version) > 1

    q = spark.createDataFrame([(1, "When does the ferry leave?"), (2, "How often do solar panels need cleaning?")], "question_id long, question string")
    got = {r.question_id: r for r in answer(q, catalog, WordEmbedder(), FirstSourceGenerator(), SETTINGS).collect()}
    assert got[1].status == "answered" and "ferry" in got[1].answer and got[1].citations[0].document_id == "a.md"
    shut = answer(q, catalog, WordEmbedder(), FirstSourceGenerator(), SETTINGS.replaced({"min_score": "0.99"})).collect()
    assert {r.status for r in shut} == {"insufficient_context"} and {r.usage.prompt_tokens for r in shut} == {None}

    items = rows(spark, ITEMS, [
        dict(id="f", type="quant", question="When does the ferry leave?", status="approved", provenance="p", answer="ten", evidence=[dict(document_id="a.md", page=None, quote="leaves at ten")]),
        dict(id="n", type="unanswerable", question="Zzz?", status="approved", provenance="p", expected_status="insufficient_context", scoring={"2": "a", "0": "b"}),
        dict(id="d", type="quant", question="draft", status="draft", provenance="p", answer="x"),
    ])
    records, checks, scored = evaluate(items, catalog, WordEmbedder(), FirstSourceGenerator(), WordJudge(), SETTINGS, repeats=2)
    assert records.count() == 4 and scored.filter("id = 'f' AND score = 2").count() == 2
    h = {r["group"]: r.n for r in headline(scored).collect()}
    assert h == {"quant": 2, "qual": 0, "negative": 2, "total": 4}
    folder = K.save_run(str(corpus / "runs"), "test", records, checks, scored, K.provenance(SETTINGS, name="test"), datetime.datetime(2030, 1, 2, 3, 4, 5))
    assert folder.endswith("/20300102-030405_test")
    again = score(items, *S.run_tables(spark, folder), SETTINGS)
    assert headline(again).filter("`group` = 'quant'").first().usefulness == 1.0
    assert "| quant | 2 |" in "\n".join(r.value for r in spark.read.text(f"{folder}/report").collect())
    c = {(r["group"], r.k): r.hit for r in retrieval_curve(items, catalog, WordEmbedder(), SETTINGS, [1, 3]).collect()}
    assert c["quant", 3] == 1.0
    with pytest.raises(ValueError, match="gold documents"):
        evaluate(items, catalog, WordEmbedder(), FirstSourceGenerator(), WordJudge(), SETTINGS, wanted=spark.createDataFrame([("zz", "1")], "id string, sha256 string"))


def test_embedding_batches(spark):
    class Shuffled(WordEmbedder):
        def embed(self, texts):
            assert len(texts) <= 64
            return super().embed(texts)[::-1]

    df = spark.range(150).select("id", F.concat(F.lit("text number "), "id").alias("t")).coalesce(1)
    got = {r.id: r.embedding for r in embedded(df, "t", Shuffled()).collect()}
    want = dict(WordEmbedder().embed([f"text number {i}" for i in range(150)]))
    assert all(abs(a - b) < 1e-6 for i in got for a, b in zip(got[i], want[i]))

    class Short(WordEmbedder):
        def embed(self, texts):
            return [(i, v[:3]) for i, v in super().embed(texts)]

    with pytest.raises(Exception, match="size of vectors"):
        embedded(df, "t", Short()).collect()
    tries = []
    with pytest.raises(OSError):
        retried(lambda: tries.append(1) or (_ for _ in ()).throw(OSError()), 3, sleep=lambda s: tries.append(s))
    assert tries == [1, 1.0, 1, 2.0, 1]


def test_layout_pages(spark):
    def page(n, lines):
        return [("d", n, 800.0, b, i, y, t) for b, (y, texts) in enumerate(lines) for i, t in enumerate(texts)]

    data = page(1, [(100.0, ["제 1 장. 경제"])]) + page(2, [(20.0, ["기획부"]), (60.0, ["- 새 정책 -"]), (90.0, ["추진배경", "이유가 있다."]), (120.0, ["시행일: 2026.7.1."]), (150.0, ["#태그, 둘"]), (780.0, ["57 안내"])])
    df = spark.createDataFrame(data, "document_id string, page int, height double, block int, line int, y0 double, text string")
    r = S.layout_pages(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.page, r.chapter, r.ministry, r.title, r.printed_page, r.effective, r.tags) == (2, "제1장 경제", "기획부", "새 정책", 57, "2026.7.1.", ["태그", "둘"])
    assert r.text.split("\n")[1].startswith("추진배경: ")
    with pytest.raises(Exception, match="no printed number"):
        S.layout_pages(df.filter("y0 < 700")).collect()


def test_label_sheet(spark):
    lines = ["# title", "| key | kind | what | verdict | memo |", "|---|---|---|---|---|", "| i1#f0_0 | fact | a \\| b | o | note |", "| i1#grade | grade | x | 2 |  |", "| i2#s0 | support | y |  |  |", "text"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in S.label_sheet(df).collect()] == [("i1", "f0_0", "O", "note"), ("i1", "grade", "2", "")]
    with pytest.raises(Exception, match="out of place"):
        S.label_sheet(spark.createDataFrame([("| a#s0 | k | t | maybe | |",)], "value string")).collect()


def test_sheets_reports_and_gold(spark, tmp_path):
    items, records, checks = scored_run(spark)
    sheet = K.sheet_rows(records, checks)
    assert {r.section: r.n for r in K.section_counts(sheet).collect()} == {2: 2, 4: 2}
    assert all("0.9" not in r.line for r in sheet.collect())
    assert "<details>" in K.sheet_block(records.filter("id = 'q'")).first().block
    scored = score(items, records, checks)
    text = K.report(scored, {"name": "x"})
    assert text.index("error n") < text.index("0 q (repeat 1)")
    from answerlens.operators.compare import changes, group_changes

    a, b = scored.filter("repeat = 0"), scored.filter("repeat = 1")
    assert "-100.0 pp" in K.comparison(a, b, group_changes(a, b), changes(a, b), False)
    K.save_gold(gold(spark), str(tmp_path / "g"), {"files": ["items"]})
    with pytest.raises(Exception, match="already exists|EXISTS"):
        K.save_gold(gold(spark), str(tmp_path / "g"), {"files": ["items"]})
    assert "## q (quant)" in K.review(gold(spark))
    (tmp_path / "i.jsonl").write_text('{"id":"a","type":"quant","question":"?"}\n\n')
    assert S.items(spark, str(tmp_path), ["i.jsonl"]).count() == 1
    e = spark.createDataFrame([("r", 0, "delta", '"é"')], "request_id string, seq long, event string, payload string")
    assert K.event_frames(e).first().frame == 'event: delta\ndata: "é"\n\n'


def test_hold_back_stream(spark, tmp_path):
    schema = "request_id string, seq long, text string, prompt_tokens long, completion_tokens long, ended boolean"
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1, "ok", None, None, False), ("b", 0, "[[NO_", None, None, False), ("c", 0, "[", None, None, False)], schema).write.json(src)
    spark.createDataFrame([("a", 0, "[", None, None, False), ("a", 2, " end", None, None, False), ("a", 3, None, 5, 2, True), ("b", 1, "ANSWER]]", None, None, True), ("c", 1, None, None, None, True)], schema).write.mode("append").json(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    query = hold_back(stream).writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.request_id, r.seq, r.event, r.payload) for r in spark.table("held").collect())
    assert [(r, e) for r, _, e, _ in got] == [("a", "delta"), ("a", "delta"), ("a", "done"), ("b", "done"), ("c", "done")]
    assert got[0][3] == "[ok" and got[1][3] == " end" and '"answered"' in got[2][3] and "insufficient" in got[3][3] and '"answered"' in got[4][3]


def test_windows(spark):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    df = spark.createDataFrame([(t(1), "a", 1.0), (t(3), "a", 3.0), (t(12), "a", 5.0)], "ts timestamp, k string, v double")
    assert sorted(r.n for r in windowed(df, "ts", "v", ["k"], "10 minutes").collect()) == [1, 2]
    assert windowed(df, "ts", "v", ["k"], "10 minutes", "5 minutes").count() == 4
    assert sorted(r.n for r in sessions(df, "ts", ["k"], "5 minutes").collect()) == [1, 2]


def test_draft_gold(spark):
    from answerlens.operators.goldset import validate
    from answerlens.plans.flows import draft_gold
    from answerlens.providers import SentenceDrafter

    text = "The office opens at {} on weekdays. Visitors need a pass from the front desk. Bags are checked twice."
    pages = spark.createDataFrame([(f"d{i}", "T", None, text.format(10 + i) if i % 4 else "No digits in this one at all.") for i in range(12)], "document_id string, title string, page int, text string")
    items, rejects = draft_gold(pages, SentenceDrafter(), 3, 2, 2, seed=1, window_tokens=60)
    kinds = {r.type: r["count"] for r in items.groupBy("type").count().collect()}
    assert kinds == {"quant": 6, "false_premise": 2, "qual": 2}
    assert items.filter("status <> 'draft'").count() == 0 and rejects.filter("reason = 'skipped'").count() > 0
    full = items.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("must_not", "array<string>"), ("keywords", "array<string>")) if c not in items.columns])
    assert validate(full).filter("size(errors) > 0").count() == 0
    again, _ = draft_gold(pages, SentenceDrafter(), 3, 2, 2, seed=1, window_tokens=60)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in items.collect())


def test_failures_stay_with_their_file_and_question(spark, corpus):
    class Refusing(WordEmbedder):
        """Refuses texts that hold a word."""

        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("refused " + "x" * 200)
            return super().embed(texts)

    class Failing(FirstSourceGenerator):
        def generate(self, system, user):
            if "ferry" in user.rsplit("[Question]", 1)[1]:
                raise RuntimeError("no answer today")
            return super().generate(system, user)

    (corpus / "in/bad.txt").write_text("This text has poison in it.")
    catalog = Catalog(spark, str(corpus / "store"))
    load = lambda s=SETTINGS, e=None, **k: {r.document_id: r for r in ingest_files(spark, [str(corpus / "in")], catalog, e or Refusing(), s, **k).collect()}
    first = load()
    assert {d: r.status for d, r in first.items()} == {"a.md": "ingested", "b.txt": "ingested", "bad.txt": "failed", "c.png": "unsupported"}
    assert first["bad.txt"].note.startswith("RuntimeError: refused") and len(first["bad.txt"].note) == 120 and first["bad.txt"].chunks == 0
    assert {r.id for r in catalog.documents().collect()} == {"a.md", "b.txt"} and catalog.chunks().filter("embedding IS NULL").count() == 0
    assert load()["bad.txt"].status == "failed"  # tried again
    (corpus / "in/a.md").write_text("Now with poison.")
    assert load()["a.md"].status == "failed" and catalog.chunks().filter("document_id = 'a.md' AND content LIKE '%ferry%'").count() == 1
    (corpus / "in/a.md").write_text("The ferry leaves at nine. It costs twenty coins.")

    policy = load(SETTINGS.replaced({"chunker": "policy"}))
    assert {r.status for d, r in policy.items() if d != "c.png"} == {"failed"} and "policy template" in policy["b.txt"].note

    items = rows(spark, ITEMS, [
        dict(id="f", type="quant", question="When does the ferry leave?", status="approved", provenance="p", answer="nine", evidence=[dict(document_id="a.md", page=None, quote="leaves at nine")]),
        dict(id="p", type="quant", question="Is there poison?", status="approved", provenance="p", answer="no", evidence=[dict(document_id="a.md", page=None, quote="x")]),
        dict(id="s", type="quant", question="How often do solar panels need cleaning?", status="approved", provenance="p", answer="twice", evidence=[dict(document_id="b.txt", page=None, quote="twice a year")]),
    ])
    records, _, scored = evaluate(items, catalog, Refusing(), Failing(), WordJudge(), SETTINGS)
    got = {r.id: r for r in records.collect()}
    assert {i: r.status for i, r in got.items()} == {"f": "error", "p": "error", "s": "answered"}
    assert got["f"].error == "RuntimeError: no answer today" and got["p"].error.startswith("RuntimeError: refused") and len(got["p"].error) <= 300
    assert got["s"].latency_ms >= 1 and got["s"].error is None and got["p"].latency_ms is None
    assert {r.id: (r.score, r.cause) for r in scored.filter("status = 'error'").collect()} == {"f": (None, "execution_error"), "p": (None, "execution_error")}
    assert evaluate(items, catalog, WordEmbedder(), FirstSourceGenerator(), WordJudge(), SETTINGS, first=2)[0].select("id").distinct().count() == 2


def test_ingest_of_layouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/book.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in/odd.pdf").write_bytes(b"%PDF-1.7 y")
    (tmp_path / "in/plain.txt").write_text("Some words of text.")
    lines = [(1, 0, 20.0, "기획부"), (1, 1, 60.0, "- 새 정책 -"), (1, 2, 90.0, "추진배경"), (1, 3, 100.0, "이유가 있다."), (1, 4, 780.0, "57 안내")]
    layouts = spark.createDataFrame([("book.pdf", p, 800.0, b, 0, y, t) for p, b, y, t in lines], "document_id string, page int, height double, block int, line int, y0 double, text string")
    catalog = Catalog(spark, str(tmp_path / "store"))
    load = lambda s: {r.document_id: r for r in ingest_files(spark, [str(tmp_path / "in")], catalog, WordEmbedder(), s, layouts=layouts).collect()}
    book = load(SETTINGS.replaced({"extractor": "policy_book", "chunker": "policy"}))
    assert {d: r.status for d, r in book.items()} == {"book.pdf": "ingested", "odd.pdf": "failed", "plain.txt": "failed"}
    assert "no layout" in book["odd.pdf"].note and "needs a PDF" in book["plain.txt"].note
    chunk = catalog.chunks().first()
    assert (chunk.document_id, chunk.page_start, chunk.meta.title, chunk.meta.ministry, chunk.meta.printed_page) == ("book.pdf", 1, "새 정책", "기획부", 57)
    assert catalog.documents().first().page_count == 1
    plain = load(SETTINGS)
    assert {d: r.status for d, r in plain.items()} == {"book.pdf": "ingested", "odd.pdf": "failed", "plain.txt": "ingested"}
    assert "이유가 있다." in catalog.chunks().filter("document_id = 'book.pdf' AND meta.title IS NULL").first().content


def test_best_of_a_task():
    import numpy as np

    from answerlens.operators.vectors import _keep_best

    rng = np.random.default_rng(1)
    scores, ids = np.round(rng.random((7, 90)), 1), rng.permutation(90)
    best, who = np.full((7, 5), -np.inf), np.full((7, 5), np.iinfo(np.int64).max)
    for start in range(0, 90, 13):
        _keep_best(best, who, scores[:, start : start + 13], ids[start : start + 13])
    for q in range(7):
        want = sorted(zip(-scores[q], ids))[:5]
        assert [(-s, int(c)) for s, c in want] == list(zip(best[q], who[q].tolist()))


def test_command_line(spark, corpus, capsys):
    import json

    from answerlens.cli import main

    root, at = str(corpus), ["--set", "embed_dim=64"]
    for n in range(12):
        (corpus / f"in/n{n}.txt").write_text(f"The office number {n} opens at {10 + n} on weekdays. Visitors need a pass from the front desk. Bags are checked twice.")
    assert main([*at, "ingest", f"{root}/store", f"{root}/in"]) == 0
    gold = [
        dict(id="f", type="quant", question="When does the ferry leave?", status="approved", provenance="p", answer="nine", evidence=[dict(document_id="a.md", page=None, quote="leaves at nine")]),
        dict(id="g", type="quant", question="How often do solar panels need cleaning?", status="approved", provenance="p", answer="twice", evidence=[dict(document_id="b.txt", page=None, quote="twice a year")]),
    ]
    (corpus / "gold.jsonl").write_text("\n".join(json.dumps(g) for g in gold))
    runs = ["--runs", f"{root}/runs"]
    assert main([*at, "run", f"{root}/store", root, "gold.jsonl", *runs, "--name", "one", "--repeats", "2"]) == 0
    assert main([*at, "run", f"{root}/store", root, "gold.jsonl", *runs, "--name", "few", "--limit", "1"]) == 0
    one, few = (next((corpus / "runs").glob(f"*_{n}")) for n in ("one", "few"))
    assert [S.run_tables(spark, str(x))[0].count() for x in (one, few)] == [4, 1]
    assert main([*at, "rejudge", str(one), root, "gold.jsonl", *runs]) == 0
    again = next((corpus / "runs").glob("*_rejudge"))
    assert S.run_tables(spark, str(again))[1].count() == S.run_tables(spark, str(one))[1].count()
    assert main([*at, "compare", str(one), str(again), root, "gold.jsonl", "--out", f"{root}/compared"]) == 0
    assert main([*at, "rescore", str(one), root, "gold.jsonl"]) == 0
    assert main([*at, "label-sheet", str(one), f"{root}/sheet"]) == 0
    lines = [r.value for r in spark.read.text(f"{root}/sheet").collect()]
    assert any(x.startswith("## 2. Values (2)") for x in lines) and sum(x.startswith("| f#value |") for x in lines) == 1
    filled = [x.replace(" |  |  |", " | O |  |") if "#value |" in x else x for x in lines]
    (corpus / "filled.md").write_text("\n".join(filled))
    capsys.readouterr()
    assert main([*at, "calibrate", str(one), f"{root}/filled.md"]) == 0
    assert "value" in capsys.readouterr().out
    assert main([*at, "generate", f"{root}/drafts", f"{root}/in", "--quant", "2", "--qual", "1", "--traps", "1"]) == 0
    assert spark.read.json(f"{root}/drafts/items").filter("status <> 'draft'").count() == 0
    with pytest.raises(Exception, match="already exists|EXISTS"):
        main([*at, "generate", f"{root}/drafts", f"{root}/in", "--quant", "2"])
    with pytest.raises(KeyError, match="unknown setting"):
        main(["--set", "nothing=1", "ingest", f"{root}/store", f"{root}/in"])
