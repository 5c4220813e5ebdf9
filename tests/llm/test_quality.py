import numpy as np
import pytest
from pyspark.sql import functions as F

from answerlens.llm.quality_classifier import fit, quality_scores
from answerlens.llm.quality_classifier import train as train_classifier
from answerlens.llm.quality_rules import MONOTONIC, Forest, grow, quality_rules, train
from answerlens.llm.shared import HashCache
from answerlens.llm.textstats import NAMES, stats, taught

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_base_statistics_against_plain_python():
    def plain(t):
        w = t.encode().split()
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = [False] * len(w)
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                hit[i : i + 8] = [True] * 8
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, sum(hit)

    for t in ["", " \n\t", "a b c", "x\nx\n\n \nx ", "ü# é| " * 9, "a b c d e f g h i " * 3, "a b c d e f g a b c d e f g h"]:
        assert tuple(map(int, stats(t.encode(), HashCache())[:5])) == plain(t)
    assert stats(None, HashCache()) == (0.0,) * len(NAMES)


def test_trees_obey_constraints_and_flat_scoring():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.5 * np.sin(3 * x[:, 2]) + r.normal(size=3000) > 0).astype(float)
    model = grow(x, y, trees=25, signs=np.array([1, -1, 0, 0]))
    assert ((model.score(x) > 0.5) == y).mean() > 0.8
    for feature, sign in ((0, 1), (1, -1)):
        grid = np.repeat(r.normal(size=(50, 1, 4)), 30, axis=1)
        grid[:, :, feature] = np.linspace(-3, 3, 30)
        s = model.score(grid.reshape(-1, 4)).reshape(50, 30)
        assert (np.diff(s, axis=1) * sign >= -1e-12).all()

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            n = 0
            while n < len(f):
                n = 2 * n + 1 + int(row[f[n]] > t[n])
            total += leaf[n - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(row) for row in x[:50]], model.score(x[:50]))
    assert set(MONOTONIC) <= set(NAMES)


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_rules_on_held_out_labels(spark, tables):
    docs, labels = tables
    model = train(docs, labels)
    out = quality_rules(docs, model)
    assert out.columns == [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]
    rows = out.join(labels, "doc_id").filter(~taught("doc_id") & (F.col("n_words") >= 20)).select("quality", "kept").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.97
    assert rows[rows.quality == 0].kept.mean() < 0.2


def test_classifier_on_held_out_labels(spark, tables):
    docs, labels = tables
    rows = quality_scores(docs, train_classifier(docs, labels)).join(labels, "doc_id").filter(~taught("doc_id")).select("quality", "score", "predicted").toPandas()
    assert rows.score.between(0, 1).all()
    assert auc(rows.score.to_numpy(), rows.quality.to_numpy()) > 0.95
    assert (rows.predicted == rows.quality).mean() > 0.93


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a " * 40), (None, "a " * 40), (3, "z" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Kept", F.lit(1)).withColumn("stats", F.lit(2))
    out = quality_rules(df, grow(np.zeros((0, len(NAMES))), np.zeros(0)))
    assert "kept_" in out.columns and out.count() == 5 and out.filter("kept_").count() == 0
    assert quality_rules(df.limit(0), Forest(0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)))).count() == 0
    flat = fit(np.zeros((0, len(NAMES))), np.zeros((0, len(NAMES))), 0.8)
    assert {round(r.score, 6) for r in quality_scores(df, flat).collect()} == {0.8}


def test_gradient_and_risk_against_plain_versions():
    from answerlens.llm.quality_classifier import SIZE, Additive, constant, risk, slope, summed

    r = np.random.default_rng(4)
    edges = [np.sort(r.normal(size=15)) for _ in NAMES]
    for prior, shift in ((0.4, 0.0), (0.95, 3.0)):  # the second has a negative risk of negatives
        model = Additive(edges, r.normal(size=SIZE) * 0.3, 0.1)
        p, u = model.cells(r.normal(size=(50, len(NAMES))) + shift), model.cells(r.normal(size=(80, len(NAMES))))
        model.weight[np.unique(p)] += 0.1 * (shift > 0)
        sums = lambda m: (summed(m, p, np.ones(50)), summed(m, u, np.ones(80)))  # noqa: E731, B023
        plain = lambda m: (m.of_cells(p), m.of_cells(u))  # noqa: E731, B023
        sp, su = plain(model)
        clamped = su.mean() - prior * sp.mean() < 0
        assert np.isclose(risk(sp, su, prior), prior * (1 - sp).mean() + max(0, su.mean() - prior * sp.mean()))
        target = (lambda m: prior * plain(m)[0].mean() - plain(m)[1].mean()) if clamped else lambda m: risk(*plain(m), prior)  # noqa: B023
        grad = slope(*sums(model), prior)
        for k in [*r.choice(SIZE, 12, replace=False).tolist(), SIZE]:
            ends = []
            for e in (1e-5, -1e-5):
                w = model.weight.copy()
                w[k : k + 1] += e
                ends.append(target(Additive(edges, w, model.bias + e * (k == SIZE))))
            assert np.isclose((ends[0] - ends[1]) / 2e-5, grad[k], atol=1e-7)
    assert constant(0.8).of_cells(u).round(6).tolist() == [0.8] * 80


def test_prior_of_a_known_mixture():
    from answerlens.llm.quality_classifier import constant, graded, prior_of, summed

    r = np.random.default_rng(5)
    drawn = lambda n, m: r.normal(m, 1.0, size=(n, len(NAMES)))
    for prior in (0.3, 0.6, 0.9):
        x, u = drawn(2000, 0.8), np.concatenate([drawn(int(4000 * prior), 0.8), drawn(4000 - int(4000 * prior), -0.8)])
        shape = constant(0.5)
        shape.edges = [np.unique(np.quantile(u[:, j], np.arange(1, 16) / 16)) for j in range(len(NAMES))]
        p, c, one = shape.cells(x), shape.cells(u), np.ones(len(u))
        assert abs(prior_of(shape.edges, p, lambda m: summed(m, c, one), lambda m: graded(m, c, one)) - prior) < 0.05  # noqa: B023
        assert ((fit(x, u).score(u) >= 0.5) == (np.arange(4000) < int(4000 * prior))).mean() > 0.95


def test_all_unlabelled_rows_count(spark, tables):
    from answerlens.llm.quality_classifier import binned, constant, over, statistics, summed

    docs, _ = tables
    known = statistics(docs)
    model = constant(0.7)
    model.edges = [np.linspace(0, 3, 15)] * len(NAMES)
    x = np.array([r.stats for r in known.collect()])
    sums = over(binned(known.select("stats"), model), model, summed, len(model.weight) + 3)
    assert np.allclose(sums, summed(model, model.cells(x), np.ones(len(x))), atol=1e-4) and sums[-1] == docs.count()


def test_classifier_without_labels_and_clashing_names(spark, tables):
    docs, labels = tables
    some = docs.limit(50)
    for few in (labels.limit(0), labels.filter("quality = 0"), labels.limit(0).selectExpr("doc_id", "cast(null as int) quality")):
        out = quality_scores(some.withColumn("Score", F.lit(1)), train_classifier(some, few))
        assert out.columns[-2:] == ["score_", "predicted"] and {r.score_ for r in out.collect()} == {0.5}
    assert quality_scores(docs.limit(0), train_classifier(docs.limit(0), labels)).count() == 0
