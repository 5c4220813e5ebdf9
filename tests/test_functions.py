import pytest
from pyspark.sql import functions as F

from answerlens.functions import numbers as N
from answerlens.functions import text as X
from answerlens.functions.metrics import half_even, index_percentile


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_clean(spark):
    c = lambda t: one(spark, t, lambda x: X.clean(x, normalise=True))
    assert c("a​b\x07\r\n\n  ••• c\t d ") == "ab\n• c d"
    assert c(" - - x\n---\né") == "- x\n- -\né"
    assert c("") == "" and c(None) is None
    assert c("x ") == "x"


def test_sniff(spark):
    rows = [(b"%PDF-1.7", "a.txt"), (b"ok", "a.TXT"), (b"\xff\xfe", "b.md"), (b"PK\x03", "c.zip"), ("é".encode(), "d.md"), (b"x", "md")]
    df = spark.createDataFrame(rows, "content binary, name string").select(X.sniff(F.col("content"), F.col("name")).alias("k"))
    assert [r.k for r in df.collect()] == ["pdf", "text", None, None, "text", None]
    assert one(spark, b"\xef\xbb\xbfhi", X.decode_text, "binary") == "hi"


def test_join_lines(spark):
    j = lambda rows: one(spark, rows, X.join_lines, "array<struct<line:string,y0:double>>")
    assert j([("cell one", 10.0), ("cell two", 10.5)]) == "cell one | cell two"
    assert j([("주요내용", 10.0), ("text", 10.0)]) == "주요내용 text"
    assert j([("•", 1.0), ("point", 1.0)]) == "• point"
    assert j([("word with ", 1.0), ("space", 20.0)]) == "word with space"
    assert j([("bro", 1.0), ("ken", 20.0)]) == "broken"
    assert j([("End.", 1.0), ("Next", 20.0)]) == "End.\nNext"
    assert j([("text", 1.0), ("- item", 20.0)]) == "text\n- item"
    assert j([("#tag", 1.0), ("more", 20.0)]) == "#tag\nmore"
    assert j([]) == ""


def test_labels_and_meta(spark):
    assert one(spark, "x 시 행 일 | 2026.7.1.\n주요내용  text", X.label_lines) == "x\n시행일: 2026.7.1.\n주요내용: text"
    assert one(spark, "a\n시행일: 2026.7.1. \nb", X.effective_date) == "2026.7.1."
    assert one(spark, "a\n#one, two #three 국토교통부 담당\nb", X.hashtags) == ["one", "two", "three"]
    assert one(spark, "none", X.hashtags) is None
    assert [one(spark, t, X.page_number) for t in ("12 title", "title • 7", "x", "12a")] == [12, 7, None, None]


def test_sentences(spark):
    s = lambda t: one(spark, t, X.sentences)
    assert s("**Bold** claim one. Second claim here! [1][2]\n- Bullet line [3].\n1. Numbered line.\nshort") == ["Bold claim one.", "Second claim here!", "Bullet line.", "Numbered line."]
    assert s("3.5 percent") == ["5 percent"]
    assert s("") == []


def test_brackets_and_references(spark):
    e = lambda t: one(spark, t, X.strip_explanation)
    assert e("wrong value (right (x) value) (p. 3)") == "wrong value"
    assert e("no close)") == "no close)" and e("plain") == "plain" and e(None) is None and e("(all)") == ""
    assert one(spark, "point (PDF p.3, name (x)) ", X.strip_reference) == "point"


def test_numbers(spark):
    n = lambda t: sorted(one(spark, t, N.numbers))
    assert n("2026.7.1. 1,800만원 0.5%p 2026.7.") == sorted(["2026", "7", "1", "1800", "0.5"])
    v = lambda t: one(spark, t, N.value_count)
    assert v("2026.7.1. 19~34세, 300") == 3 and v("2026년 7월 1일") == 1 and v("none") == 0
    df = spark.createDataFrame([("a 1 and 2", ["a 1", "b 3", "1 2 3"])], "p string, f array<string>")
    r = df.select(N.fact_check(F.col("p"), F.col("f")).alias("c")).first().c
    assert (r.lost, r.added, r.none, r.crowded) == ([], ["3"], False, [2])


@pytest.mark.parametrize(
    ("answer", "source", "wrong"),
    [
        ("월 20만원", "", "월 40만원"), ("1,800만원", "", "3,600만원"), ("2026.7.1.", "", "2026.7.8."), ("19~34세", "", "19~39세"),
        ("12월", "", "11월"), ("2026년", "", "2027년"), ("30%", "", "60%"), ("80%", "", "70%"), ("3명", "3명 4 명", "5명"), ("1.50배", "", "3.00배"),
        ("28일", "", "21일"), ("none", "", None), ("1.2.3", "", "1.2.4"),
    ],
)
def test_perturb(spark, answer, source, wrong):
    r = spark.createDataFrame([(answer, source)], "a string, s string").select(N.perturb(F.col("a"), F.col("s")).alias("p")).first().p
    assert (r and r.wrong) == wrong


def test_scaled_first(spark):
    assert [one(spark, t, N.scaled_first) for t in ("3명 5", "20만", "x")] == ["9명 5", "30만", ""]


def test_overlaps_and_norm(spark):
    df = spark.createDataFrame([("ab cd!", "xabcx"), ("a", "a"), (None, "x")], "q string, t string")
    assert [r.o for r in df.select(X.bigram_overlap(F.col("q"), F.col("t")).alias("o")).collect()][:2] == [2 / 3, 0.0]
    df = spark.createDataFrame([("aa b ccc", "ccc here")], "q string, t string")
    assert df.select(X.word_overlap(F.col("q"), F.col("t")).alias("o")).first().o == 0.5
    assert one(spark, "a  b\n‘c’", lambda x: X.squeezed(x, quotes=True)) == "ab'c'"
    pages = spark.createDataFrame([([(1, "no"), (2, "has the quote"), (3, "the quote")], "the  quote")], "p array<struct<page:int,text:string>>, q string")
    assert pages.select(X.find_page(F.col("p"), F.col("q")).alias("n")).first().n == 2


def test_formats(spark):
    assert one(spark, " a\n|b ", X.cell) == "a \\|b"
    assert one(spark, "a\n \nb", X.quoted) == "> a\n>\n> b"
    assert one(spark, "<a|b&'\">", X.escaped) == "&lt;a&#124;b&amp;&#x27;&quot;&gt;"
    assert one(spark, 0.1234, X.percent, "double") == "12.3%" and one(spark, None, X.percent, "double") == "-"
    df = spark.createDataFrame([("T", 3, None, "H"), ("T", None, None, ""), ("T", 3, 9, None)], "t string, p int, q int, h string")
    assert [r.l for r in df.select(X.hit_label(F.col("t"), F.col("p"), F.col("q"), F.col("h")).alias("l")).collect()] == ["T p.3 (H)", "T", "T p.9"]
    assert [one(spark, t, X.check_kind) for t in ("s0", "f1_2", "m3", "value", "grade")] == ["support", "fact", "must_not", "value", "grade"]
    assert [one(spark, t, X.vote) for t in (" Yes", "아니오", "maybe")] == [1.0, 0.0, None]
    assert one(spark, "2", lambda x: X.vote(x, F.array(F.lit("0"), F.lit("2")))) == {"0": 0.0, "2": 1.0}


def test_index_percentile(spark):
    df = spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)] + [(None,)], "v double")
    assert index_percentile(df, "v", 0.5).first().value == 3.0
    assert index_percentile(df, "v", 0.95, cut=True).first().value == 3.0
    assert one(spark, 0.00005, half_even, "double") == 0.0
    import random

    r = random.Random(1)
    values = [r.choice([r.random(), round(r.random(), 2), 0.5]) for _ in range(30_000)]
    big = spark.createDataFrame([("a", v) for v in values] + [(None, 7.0)], "g string, v double").repartition(5)
    for q, cut in ((0.0, False), (0.5, False), (0.95, True), (1.0, False)):
        got = {x.g: x.value for x in index_percentile(big, "v", q, ["g"], cut=cut).collect()}
        at = q * (len(values) - 1)
        assert got == {"a": sorted(values)[int(at) if cut else round(at)], None: 7.0}
