import hashlib
import random

from answerlens.llm.line_dedup import line_dedup
from answerlens.llm.substring_dedup import substring_dedup, substring_digest

DOCS = "doc_id long, text string"


def made(seed, n=40):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefghij") + str(r.randrange(9)) for _ in range(r.randrange(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randrange(0, 6)):
            lines.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice("klmnop") + str(r.randrange(99)) for _ in range(r.randrange(0, 30))))
        rows.append((i, r.choice(["\n", " \n", "\n\t"]).join(lines)))
    rows += [(None, passages[0] + "\n" + passages[1]), (n, None), (n + 1, ""), (3, rows[2][1]), (3, rows[2][1]), (n + 2, "x " * 30000), (n + 3, "ü" * 50000)]
    r.shuffle(rows)
    return rows


def brute_words(rows, k):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            if d is not None:
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row[:3]) + tuple(str(x) for x in row[3:])


def test_substring_matches_brute_force(spark):
    rows = made(1)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, DOCS).repartition(parts)
        got = [tuple(r) for r in substring_digest(df).collect()]
        assert sorted(got, key=key) == sorted(brute_words(rows, 13), key=key)


def test_substring_keeps_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, N_words int")
    out = substring_dedup(df)
    assert out.columns == ["doc_id", "text", "N_words", "n_words_", "n_removed", "kept_text"]
    assert [tuple(r) for r in out.collect()] == [(1, "a b", 5, 2, 0, "a b")]
    assert substring_digest(spark.createDataFrame([], DOCS)).count() == 0


def brute_lines(rows, k):
    first = {}
    for d, t in rows:
        if t is None or d is None:
            continue
        x = t.split("\n")
        for i in range(len(x) - k + 1):
            w = tuple(x[i : i + k])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        x = t.split("\n") if t is not None else []
        gone, seen = [False] * len(x), set()
        for i in range(len(x) - k + 1):
            w = tuple(x[i : i + k])
            if w in seen or (d is not None and first[w] < d):
                gone[i : i + k] = [True] * k
            seen.add(w)
        out.append((d, len(x), sum(gone), None if t is None else "\n".join(y for y, g in zip(x, gone) if not g)))
    return out


def test_lines_match_brute_force(spark):
    for seed, k in ((2, 2), (3, 3), (4, 1)):
        r = random.Random(seed)
        rows = [(i, "\n".join(r.choice("abcd") * r.randrange(3) for _ in range(r.randrange(0, 9)))) for i in range(30)]
        rows += [(None, "a\nb\na\nb\na"), (31, None), (31, "a\nb\nc"), (32, ""), (33, "\n\n\n\n")]
        df = spark.createDataFrame(rows, DOCS).repartition(4)
        got = [tuple(x) for x in line_dedup(df, run_lines=k, run_words=None).select("doc_id", "n_lines", "n_removed_lines", "kept_text").collect()]
        assert sorted(got, key=key) == sorted(brute_lines(rows, k), key=key)


def brute_runs(rows, run_lines=4, run_words=13):
    """Runs of lines by their words or lines, extended around the smallest place of each window."""

    def windows(x):
        words = [len(y.encode().split()) for y in x]
        for i in range(len(x)):
            for j in range(i + 1, min(len(x), i + run_lines) + 1):
                if sum(words[i:j]) >= run_words or j - i == run_lines:
                    yield i, j, tuple(x[i:j])
                    break

    first = {}
    for d, t in rows:
        if t is not None and d is not None:
            x = t.split("\n")
            for i, _, w in windows(x):
                if w not in first or (d, i) < first[w][:2]:
                    first[w] = (d, i, x)
    out = []
    for d, t in rows:
        x = t.split("\n") if t is not None else []
        gone, seen = [False] * len(x), {}
        for i, j, w in windows(x):
            place = first[w][1:] if d is not None and first[w][0] < d else (seen[w], x) if w in seen else None
            seen.setdefault(w, i)
            if place:
                a, y = place
                back = next((b for b in range(run_lines - 1) if i - b < 1 or a - b < 1 or x[i - b - 1] != y[a - b - 1]), run_lines - 1)
                c = a + j - i
                on = next((b for b in range(run_lines - 1) if j + b >= len(x) or c + b >= len(y) or x[j + b] != y[c + b]), run_lines - 1)
                gone[i - back : j + on] = [True] * (j + on - i + back)
        out.append((d, len(x), sum(gone), None if t is None else "\n".join(y for y, g in zip(x, gone) if not g)))
    return out


def test_runs_match_brute_force(spark):
    r = random.Random(9)
    pool = [" ".join(r.choice("abcdef") + str(r.randrange(9)) for _ in range(n)) for n in (0, 0, 1, 2, 3, 5, 8, 13, 14, 20, 30)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.8 else f"own {r.random()}" for _ in range(r.randrange(0, 12)))) for i in range(120)]
    block = pool[2:9]
    rows += [(200 + i, "\n".join([f"x{i}", *block[i % 3 :], f"y{i}"])) for i in range(9)]
    rows += [(None, "\n".join(block + block)), (300, None), (301, ""), (302, "\n" * 9), (303, pool[9]), (304, "w " * 40000 + "\n" + pool[10])]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = [tuple(x) for x in line_dedup(df).select("doc_id", "n_lines", "n_removed_lines", "kept_text").collect()]
    assert sorted(got, key=key) == sorted(brute_runs(rows), key=key)
    assert sum(x[2] for x in got) > 200


def test_a_long_line_alone_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(52))
    rows = [(1, f"a\n{long}\nb", 1), (2, long, 2), (3, f"c\n{long[:-1]}", 3), (4, f"d\n{long}", 4)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, KEPT_text int"))
    assert out.columns == ["doc_id", "text", "KEPT_text", "n_lines", "n_removed_lines", "kept_text_"]
    assert {r.doc_id: r.kept_text_ for r in out.collect()} == {1: rows[0][1], 2: "", 3: rows[2][1], 4: "d"}
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_messages_grow_with_the_input_alone():
    from answerlens.llm.exchange import sizes

    for bytes_a_window in (6.0, 60.0):
        rates = []
        for total in (0.5e9, 30e9, 1e12):
            chunk, bits = sizes(total, bytes_a_window)
            rates.append(total / chunk * 2**bits / total)
            assert total / bytes_a_window / 2**bits <= 1 << 26
        assert max(rates) <= 2 * rates[0]
        chunk, bits = sizes(1e14, bytes_a_window)
        assert chunk <= 32 << 20 and 1e14 / bytes_a_window / 2**bits <= 2 << 27
        assert chunk / bytes_a_window / 2**bits > 4
