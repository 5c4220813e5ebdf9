import os
import random
import sys

import numpy as np
from test_near_dedup import brute, made

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as pipeline  # noqa: E402

from answerlens.llm import near_dedup, simhash_similar as own  # noqa: E402


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def top(root, x):
    while root[x] != x:
        x = root[x]
    return x


def test_stage_finds_pairs_by_simhash_and_covering_tables(spark, monkeypatch):
    """The stage works without MinHash, and finds nothing but copies without the tables of its fingerprints."""

    def none(*_):
        raise AssertionError("MinHash")

    monkeypatch.setattr(near_dedup, "signed", none)
    rows = made(2)
    want = set(brute(rows).values())
    assert {r.doc_id for r in pipeline.near_duplicates(spark, frame(spark, rows), "").collect()} == want
    monkeypatch.setattr(own, "candidates", lambda nodes: spark.createDataFrame([], "a long, b long"))
    assert pipeline.near_duplicates(spark, frame(spark, rows), "").count() > len(want)


def test_groups_match_brute_force(spark):
    rows = made(1)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in own.similar_groups(df).collect()} == want
    more = df.union(spark.createDataFrame([(None, rows[0][1]), (None, None), (8, rows[0][1])], df.schema))
    kept = own.similar_dedup(more)
    assert kept.filter("doc_id IS NULL").count() == 2
    assert {r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()} == set(want.values()) - {want[rows[0][0]]}
    assert own.similar_groups(df.limit(0)).count() == 0


def test_print_is_a_majority_of_bits():
    x = np.random.default_rng(1).integers(0, 2**63, 700, np.uint64)
    h = own.mix(x[:, None] + own.SALTS)
    for n in (0, 1, 4, 255, 256, 700):
        want = b"".join(int(sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in h[:n, j]) > n)).to_bytes(8, "little") for j in range(len(own.SALTS)))
        assert own.wide_print(x[:n]) == want


def test_tables_cover_the_radius():
    """Fingerprints whose words differ in fewer than WORDS * (WORD_RADIUS + 1) bits in all always meet."""
    r = random.Random(5)
    bits = own.WORDS * own.WORD_BITS
    for _ in range(300):
        x = r.getrandbits(own.PRINT_BYTES * 8)
        y = x
        for b in r.sample(range(bits), own.WORDS * (own.WORD_RADIUS + 1) - 1):
            y ^= 1 << b
        keys = own.dealt([v.to_bytes(own.PRINT_BYTES, "little") for v in (x, y)])[0] >> np.uint64(32)
        assert (keys[0] == keys[1]).any()


def test_bits_differ_as_often_as_the_similarity_says():
    r = np.random.default_rng(3)
    far, met = [], []
    for _ in range(400):
        x = r.integers(0, 2**63, 200, np.uint64)
        two = [own.wide_print(s) for s in (x[:180], x[20:])]  # 160 of 200 shared
        far.append(sum((a ^ b).bit_count() for a, b in zip(*two, strict=True)))
        keys = own.dealt(two)[0] >> np.uint64(32)
        met.append((keys[0] == keys[1]).any())
    assert all(met) and abs(np.mean(far) / (own.PRINT_BYTES * 8) - 0.1505) < 0.003


def test_links_of_small_and_large_buckets():
    r = np.random.default_rng(7)
    prints, bucket = [], []
    for b, n in enumerate((1, 2, 31, 32, 33, 400)):
        base = r.integers(0, 2**63, (max(1, n // 3), 3), np.uint64) * np.uint64(2) + np.uint64(1)
        own_prints = base[r.integers(0, len(base), n)]
        for i in range(n):
            for at in r.integers(0, 160, r.integers(0, 30)).tolist():
                own_prints[i, at // 64] ^= np.uint64(1 << at % 64 if at < 128 else 1 << at % 32)
        prints.append(own_prints)
        bucket += [b] * n
    p, bucket = np.concatenate(prints), np.array(bucket, np.uint64)
    cols = [bucket << np.uint64(32) | p[:, 2] & np.uint64(2**32 - 1), p[:, 0].copy(), p[:, 1].copy()]
    dist = own.differ(*(c[:, None] ^ c for c in cols)).astype(int)
    near = (dist <= 49) & (bucket[:, None] == bucket)
    want, got = list(range(len(p))), list(range(len(p)))
    for i, j in zip(*np.nonzero(near)):
        want[max(top(want, i), top(want, j))] = min(top(want, i), top(want, j))
    for i, j in zip(*(x.tolist() for x in own.bucket_links(cols, 49))):
        assert near[i, j]
        got[max(top(got, i), top(got, j))] = min(top(got, i), top(got, j))
    assert [top(want, i) for i in range(len(p))] == [top(got, i) for i in range(len(p))]
    assert 100 < len({top(want, i) for i in range(len(p))}) < 400
    alike = [np.full(20_000, 7, np.uint64)] * 3
    assert len(own.bucket_links(alike, 49)[0]) == 19_999


def near_copies(n, flips):
    """n fingerprints, each with so many of the bits of one flipped."""
    r = random.Random(9)
    base = r.getrandbits(own.PRINT_BYTES * 8)
    for i in range(n):
        x = base
        for b in r.sample(range(own.PRINT_BYTES * 8), flips):
            x ^= 1 << b
        yield i, x.to_bytes(own.PRINT_BYTES, "little")


def linked(links, n):
    root = list(range(n))
    for a, b in links:
        a, b = top(root, a), top(root, b)
        root[max(a, b)] = min(a, b)
    return [top(root, i) for i in range(n)]


def test_a_large_group_has_few_links(spark, monkeypatch):
    """A group of near copies sends on a few links a node, not one a node and table (F1: 651674 rows of a join)."""
    rows = [*near_copies(600, 62), *((600 + i, random.Random(1000 + i).randbytes(own.PRINT_BYTES)) for i in range(100))]
    nodes = spark.createDataFrame(rows, "rep long, print binary").repartition(3)
    together = [tuple(x) for x in own.candidates(nodes).collect()]
    assert linked(together, 700) == [0] * 600 + list(range(600, 700))
    assert len(together) < 5 * 600
    monkeypatch.setattr(own, "HELD_LINKS", 500)
    monkeypatch.setattr(own, "MOST_TOGETHER", 10)  # each table by itself
    assert linked([tuple(x) for x in own.candidates(nodes).collect()], 700) == linked(together, 700)


def test_fewer_rows_than_tables_reach_the_same_links():
    """Three rows a word give the links of its seven tables (F1: the dealt rows were 2.2 times the input)."""
    prints = [p for _, p in near_copies(40, 60)] + [p for _, p in near_copies(40, 90)]
    pairs = []
    for split in (own.TOGETHER, own.ALONE):
        keys, *rest = own.dealt(prints, split)
        assert keys.shape[1] == own.WORDS * len(split)
        cols = [c.ravel() for c in (keys, *(np.repeat(c, keys.shape[1]) for c in rest))]
        of = np.repeat(np.arange(len(prints)), keys.shape[1])
        pairs.append(linked([(int(of[a]), int(of[b])) for x in own.table_links(cols, split, 22) for a, b in zip(*x, strict=True)], len(prints)))
    assert len(own.TOGETHER) == 3 and sorted(t for g in own.TOGETHER for t in g) == [t for g in own.ALONE for t in g]
    assert pairs[0] == pairs[1] and 1 < len(set(pairs[0])) < len(prints)
    for group in own.TOGETHER:
        some, each, every = own.kept(group)
        assert every and all(m & every == every and m | some == some for m in each)


def test_stars_are_the_components():
    r = random.Random(2)
    a, b = (np.array([r.randrange(500) for _ in range(400)], np.int64) for _ in range(2))
    node, root = (x.tolist() for x in own.stars(a, b))
    want = linked(zip(a.tolist(), b.tolist(), strict=True), 500)
    assert dict(zip(node, root, strict=True)) == {i: t for i, t in enumerate(want) if i != t}
    assert [len(x) for x in own.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_texts_outside_clusters_do_not_move(spark, monkeypatch):
    """The clusters are broadcast, whatever Spark makes of their size (F1: all texts were dealt over 0.5 GB)."""
    seen = []
    monkeypatch.setattr(own, "verified", lambda rows, clusters, *_: seen.append(clusters._jdf.queryExecution().logical().toString()) or clusters.selectExpr("node AS a", "root AS b"))
    own.similar_groups(spark.createDataFrame(made(1), "doc_id long, text string"))
    assert "broadcast" in seen[0].lower()
