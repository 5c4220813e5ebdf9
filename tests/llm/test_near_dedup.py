import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as pipeline  # noqa: E402

from answerlens.llm.near_dedup import bands, near_dedup, near_groups  # noqa: E402


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((x or "").encode().lower().split() for x in (a, b)))
    return len(s & t) / len(s | t) if s | t else 1


def brute(rows):
    """doc_id -> the smallest doc_id of its group, for rows of distinct doc_ids."""
    group = {d: d for d, _ in rows}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            if jaccard(t, u) >= 0.8:
                a, b = root(d), root(e)
                group[max(a, b)] = min(a, b)
    return {d: root(d) for d in group}


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(5))
    bases = [[word() for _ in range(r.choice([3, 30, 80, 200]))] for _ in range(20)]
    rows = []
    for i in range(160):
        w = list(r.choice(bases))
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    return rows + [(5, ""), (6, None), (7, "\n \t"), (8, "a b"), (9, "A  B"), (10, "w " * 60000)]


def test_groups_match_brute_force(spark):
    rows = made(1)
    want = brute(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == want
    more = df.union(spark.createDataFrame([(None, rows[0][1]), (None, None), (8, rows[0][1])], df.schema))
    kept = near_dedup(more)
    assert kept.filter("doc_id IS NULL").count() == 2
    assert {r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()} == set(want.values()) - {want[rows[0][0]]}
    assert near_groups(df.limit(0)).count() == 0


def test_stage_links_pairs_that_differ_in_many_bits(spark):
    """Pairs at 0.8 and above lie 8 bits apart at the median."""
    r = random.Random(4)
    rows = []
    for i in range(40):
        w = [f"w{r.randrange(10**6)}" for _ in range(150)]
        other = w[:]
        for at in (40, 80, 120):
            other[at] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        assert jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in pipeline.near_duplicates(spark, df, "").collect()) == list(range(0, 80, 2))


def test_bands_meet_as_often_as_their_similarity_says():
    r = np.random.default_rng(3)
    met = []
    for _ in range(400):
        x = r.integers(0, 2**63, 200, np.uint64)
        met.append((bands(x[:180]) == bands(x[20:])).sum())  # 160 of 200 shared
    assert min(met) > 0 and abs(np.mean(met) / len(bands(x)) - 0.8**5) < 0.02
