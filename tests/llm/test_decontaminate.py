import hashlib
import random

from answerlens.llm.decontaminate import decontaminate, decontamination_digest, words_of


def brute(docs, items, k=13):
    grams = {}
    for i, t in items:
        w = words_of((t or "").encode())
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[a : a + n]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w = words_of((t or "").encode())
        hit, found = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                g = tuple(w[a : a + n])
                if g in grams:
                    hit[a : a + n] = [True] * n
                    found |= grams[g]
        s = sum(hit)
        out.append((d, len(w), s, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), s > 0 and 20 * s >= len(w)))
    return out


def made(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(["Ab", "cd", "é", "x1", "Ö", "ef"]) + r.choice([" ", "-", "\n", ", "]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 5, 13, 14, 30]))) for i in range(25) if i % 7]
    items += [(2, items[0][1]), (None, text(20)), (99, None), (100, "  ...  ")]
    docs = [(i, "".join(r.choice([text(r.randrange(25)), r.choice(items)[1] or ""]) for _ in range(r.randrange(5)))) for i in range(60)]
    return docs + [(None, items[3][1]), (7, None), (8, ""), (8, docs[5][1]), (9, "word " * 30000)], items


def test_matches_brute_force_in_one_and_many_blocks(spark):
    docs, items = made(1)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, brute(docs, items)))
    assert sorted(str(tuple(x)) for x in decontamination_digest(d, b).collect()) == want
    out = decontaminate(d, b, block_bytes=200)
    many = {(r.doc_id, r.text): (r.n_words, r.n_hit, r["items"]) for r in out.collect()}
    one = {(r.doc_id, r.text): (r.n_words, r.n_hit, r["items"]) for r in decontaminate(d, b).collect()}
    assert many == one


def test_spans_go_and_names_stay(spark):
    d = spark.createDataFrame([(1, "Start here: ONE two, three! the end", "x")], "doc_id long, text string, Items string")
    b = spark.createDataFrame([(5, "one two three")], "item_id long, text string")
    row = decontaminate(d, b).first()
    assert row.clean_text == "Start here: ! the end" and row["items_"] == ["5"] and row.n_hit == 3 and row["Items"] == "x"
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(d, empty).first().n_hit == 0
    assert decontaminate(d.limit(0), b).count() == 0
