import random

import pytest
import sentencepiece

from answerlens.llm.sentencepieces import SPACE, Pieces, decode, encode, encode_words, token_digest

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(MODEL)


def made(seed, n):
    r = random.Random(seed)
    alphabet = ["the", "ing", "a", "b", "aa", " ", " ", "  ", "\n", "\t", "é", "ß", "漢", "\U0001f600", "0", "12", ".", ",!", "==", "----", " ", "X"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def test_stretches_match_the_library(library, pieces):
    from answerlens.llm.sentencepieces import Cutter

    texts = [*made(1, 3000), "a" * 5000, "-" * 77, "x" + "e" * 300, "", None, "a\0b \0", "▁ ▁a"]
    stretches, first = Cutter(pieces).cut(texts)
    own = stretches.to_pylist()
    for t, a, b in zip(texts, first, first[1:]):
        assert "".join(own[a:b]) == (SPACE + t.replace(" ", SPACE) if t else "")
        assert [i for w in own[a:b] for i in pieces.encode_word(w)] == library.encode(t or ""), t


def test_corpus_matches_the_library(spark, library, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made(2, 200))] + [(None, "no id"), (7, None), (8, ""), (9, " "), (9, " "), (10, "é" * 30000)], "doc_id long, text string")
    df = docs.union(extra).withColumnRenamed("doc_id", "IDS")
    for most in (10**6, 50):
        out = decode(encode(df, pieces, most_words=most), pieces, "ids_" if "IDS" in df.columns else "ids").collect()
        assert len(out) == df.count()
        for r in out:
            assert r["ids_"] == (None if r.text is None else library.encode(r.text))
            assert r.decoded == r.text and r.n_tokens == len(r["ids_"] or ())
    digest = token_digest(df.withColumnRenamed("IDS", "doc_id"), pieces)
    assert digest.filter("NOT decodes").count() == 0
    assert token_digest(df.withColumnRenamed("IDS", "doc_id").limit(0), pieces).count() == 0


def test_relational_folds(spark, pieces):
    words = sorted({SPACE + w for t in made(3, 300) for w in t.split() if len(w) < 30})
    got = {r.word: r.ids for r in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect()}
    assert got == {w: pieces.encode_word(w) for w in words}

    toy = Pieces([("a", 1, -1.0), ("b", 2, -1.5), ("ab", 3, -2.0), ("aab", 4, -3.5), ("ba", 5, -2.4), (SPACE, 6, -0.5)], [], 0, "viterbi")

    def best(word):
        if not word:
            return 0.0, []
        options = []
        for n in range(1, 4):
            p = word[-n:]
            if len(p) == n and (p in toy.by_text or n == 1):
                i, s = toy.by_text.get(p, (0, toy.unknown_score()))
                head = best(word[:-n])
                options.append((head[0] + s, head[1] + [i]))
        return max(options, key=lambda o: o[0])

    r = random.Random(4)
    words = sorted({SPACE + "".join(r.choice("aabc") for _ in range(r.randrange(1, 9))) for _ in range(80)})
    got = {x.word: x.ids for x in encode_words(spark.createDataFrame([(w,) for w in words], "word string"), toy).collect()}
    value = {0: toy.unknown_score()} | {i: s for _, i, s in toy.pieces}
    for w in words:
        assert got[w] == toy.encode_word(w)
        assert abs(sum(value[i] for i in got[w]) - best(w)[0]) < 1e-9
