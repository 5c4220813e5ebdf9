import hashlib
from collections import Counter, defaultdict

from answerlens.llm.sharding import shard


def digest(d, t):
    inner = ("" if d is None else str(d)) + ":" + hashlib.md5((t or "").encode()).hexdigest()
    return int(hashlib.md5(inner.encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    hashes = [digest(d, t) for d, t in rows]
    size = [len((t or "").encode()) for _, t in rows]
    sums = defaultdict(int)
    for h, s in zip(hashes, size):
        for d in range(61):
            sums[d, h >> (60 - d)] += s
    out = []
    for h, s in zip(hashes, size):
        d = next((d for d in range(61) if sums[d, h >> (60 - d)] <= limit), 60)
        out.append((s, format(h >> (60 - d), "b").zfill(d) if d else ""))
    return out


def test_matches_brute_force(spark):
    rows = [(i, "é" * (i * 37 % 400)) for i in range(300)] + [(None, "n"), (None, None), (7, None), (1000, "z" * 5000)]
    for limit in (10**9, 4000, 600):
        out = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit).collect()
        assert len(out) == len(rows)
        assert sorted((r.row_bytes, r.shard) for r in out) == sorted(brute(rows, limit))
        total, n = Counter(), Counter()
        for r in out:
            total[r.shard] += r.row_bytes
            n[r.shard] += 1
        assert all((total[r.shard], n[r.shard]) == (r.shard_bytes, r.shard_rows) for r in out)
        assert all(b <= limit or n[s] == 1 for s, b in total.items())


def test_equal_rows_fill_pages(spark):
    rows = [(1, "abcde")] * 1000 + [(i, "xy") for i in range(50)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()
    assert len(out) == 1050
    total = Counter()
    for r in out:
        total[r.shard] += r.row_bytes
    assert max(total.values()) <= 64 and all(total[r.shard] == r.shard_bytes for r in out)
    assert sum("+" in s for s in total) == 84  # 12 copies of 5 bytes a page


def test_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, Shard int, h int, cell int")
    out = shard(df)
    assert out.columns == ["doc_id", "text", "Shard", "h", "cell", "row_bytes", "shard_", "shard_depth", "shard_bytes", "shard_rows"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 5, 6, 7, 1, "", 0, 1, 1)]
    assert shard(df.limit(0)).count() == 0
