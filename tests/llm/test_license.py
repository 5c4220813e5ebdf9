import random
from collections import Counter

from answerlens.llm.decontaminate import words_of
from answerlens.llm.license_scan import TEMPLATES, Scanner, license_scan


def brute(text, templates, least):
    w = words_of((text or "").encode())
    out = []
    for name, t in sorted(templates.items()):
        b = words_of(t.encode())
        n = min(len(b), len(w))
        if n < 2:
            continue
        bag = Counter(zip(b, b[1:]))
        best = (-1, 0)
        for i in range(len(w) - n + 1):
            common = sum((Counter(zip(w[i : i + n], w[i + 1 : i + n])) & bag).values())
            if common > best[0]:
                best = (common, i)
        dice = 2 * best[0] / (n - 1 + len(b) - 1)
        if dice >= least - 1e-12:
            out.append((name, dice, best[1], n))
    return len(w), out


def test_matches_brute_force():
    r = random.Random(1)
    templates = {str(i): " ".join(r.choice("abc") for _ in range(r.choice([2, 3, 6, 15]))) for i in range(8)}
    for least in (0.5, 0.8, 1.0):
        scanner = Scanner(templates, least)
        for _ in range(200):
            text = " ".join(r.choice("abcd") for _ in range(r.randrange(40)))
            assert scanner.scan(text.encode()) == brute(text, templates, least)


def test_real_notices(spark):
    mit = TEMPLATES["MIT-text"].replace("Software", "Work", 1).replace(" copies", "\n copies")
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, "x " * 500 + mit + " y" * 500), (3, None), (4, ""), (5, "nothing of the kind"), (None, TEMPLATES["GPL-3.0"]), (5, "nothing of the kind"), (6, "the " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS License")
    out = license_scan(df)
    assert out.columns == ["doc_id", "text", "License", "n_words", "licenses", "license_"]
    got = sorted((str(r.doc_id), str(r["license_"])) for r in out.collect())
    assert got == sorted([("1", "MIT"), ("2", "MIT-text"), ("3", "None"), ("4", "None"), ("5", "None"), ("5", "None"), ("None", "GPL-3.0"), ("6", "None")])
    assert license_scan(df.limit(0)).count() == 0
