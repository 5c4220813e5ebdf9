import random

import xxhash
from pyspark.sql import functions as F

from answerlens.llm.simhash import components, fingerprint, forest, masks, simhash_dedup, simhash_digest, simhash_groups


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=4):
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    real = [i for i, r in enumerate(rows) if r[0] is not None]
    for i in real:
        for j in real:
            if j < i and ((prints[i] ^ prints[j]).bit_count() <= radius or rows[i][0] == rows[j][0]):
                group[root(i)] = root(j)
    least = {}
    for i in real:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        same = [j for j in real if prints[j] == prints[i]]
        c = least[root(i)] if d is not None else least[root(same[0])] if same else None
        out.append((d, f"{prints[i]:016x}", c))
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    bases = [[word() for _ in range(r.choice([3, 10, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(bases))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    return rows + [(None, rows[0][1]), (None, "quite alone"), (5, ""), (6, None), (7, "\n \t"), (8, "a b"), (8, " ".join(bases[3])), (9, "A  B"), (10, "w " * 60000)]


def test_matches_brute_force(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(str, (tuple(x) for x in simhash_digest(df).collect()))) == sorted(map(str, brute(rows)))
    kept = simhash_dedup(df)
    firsts = {c for d, _, c in brute(rows) if d is not None}
    assert sorted(x.doc_id for x in kept.filter("doc_id IS NOT NULL").collect()) == sorted(firsts)
    assert kept.filter("doc_id IS NULL").count() == 2
    assert simhash_digest(df.limit(0)).count() == 0


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert fingerprint("Ä b".encode()) == plain("Ä B")


def test_masks_cover_the_radius():
    r = random.Random(5)
    tables = masks(4)
    assert len(tables) == 31
    for _ in range(3000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        assert any((x & (m % 2**64)) == (y & (m % 2**64)) for m in tables)


def test_forest_is_spanning_and_linear():
    import numpy as np

    prints = np.array([r for r in range(16)] + [2**40 + 2**41 + r for r in range(16)], np.uint64)
    edges = [(int(x), int(y)) for a, b in forest(prints, np.arange(32), 1) for x, y in zip(a, b)]
    assert len(edges) == 30


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(x, 100) for x in range(101, 160)}


def test_a_large_bucket_of_unrelated_fingerprints(spark):
    """100,000 fingerprints that agree in the bits of one table: every link is found, in seconds."""
    import time

    import numpy as np

    from answerlens.llm.simhash import forest, masks, stretches

    r = np.random.default_rng(8)
    free = np.uint64(~masks(4)[0] & (2**64 - 1))
    prints = np.unique(r.integers(0, 2**63, 100_000, np.uint64) * np.uint64(2) & free)
    near = prints[:500] ^ np.uint64(sum(1 << i for i in [k for k in range(64) if int(free) >> k & 1][:4]))
    prints = np.concatenate([prints, near])
    began = time.process_time()
    found = {frozenset(x) for g in stretches(prints, 4) for a, b in forest(prints[g], g, 4) for x in zip(a.tolist(), b.tolist())}
    assert time.process_time() - began < 60
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(sorted, found):
        assert int(prints[a] ^ prints[b]).bit_count() <= 4
        root[top(b)] = top(a)
    assert all(top(i) == top(len(prints) - 500 + i) for i in range(500))


def test_clashing_names(spark):
    rows = [(1, "a b c d e", 7, "x"), (2, "a b c d e", 8, "y"), (2, "z y x w", 9, "z"), (None, "a b c d e", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP int, other_ID string")
    assert sorted((r.doc_id or 0, r.FP) for r in simhash_dedup(df).collect()) == [(0, 1), (1, 7)]
    assert simhash_groups(df).columns == ["doc_id", "fp", "component_id"]
