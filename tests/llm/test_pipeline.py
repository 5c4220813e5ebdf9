"""The pipeline against a plain version of its stages, each on the input that the pipeline's own stage had."""

import os
import sys

import sentencepiece
from test_decontaminate import brute as brute_hits
from test_dedup import brute_runs
from test_simhash import brute as brute_groups

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in pipeline.STAGES:
        out[name] = (docs, stage(spark, docs, SF).cache())
        docs = out[name][1]
        if name != "tokens":
            assert docs.columns == columns

    before, after = out["quality"]
    assert set(rows(after)) < set(rows(before)) and all(len(t.split()) >= 20 for _, t in rows(after))
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, t in rows(before) if quality.get(d) == 1 and len(t.split()) >= 20]
    kept = {d for d, _ in rows(after)}
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)

    before, after = out["lines"]
    assert sorted(rows(after)) == sorted((d, t) for d, n, gone, t in brute_runs(rows(before)) if gone < n)

    before, after = out["near_duplicates"]
    groups = brute_groups(rows(before))
    assert sorted(d for d, _ in rows(after)) == sorted({c for _, _, c in groups})
    assert set(rows(after)) <= set(rows(before))

    before, after = out["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits(rows(before), items)
    assert sorted(d for d, _ in rows(after)) == sorted(h[0] for h in hits if not h[5])
    assert all(h[2] == 0 or h[5] or h[0] in dict(rows(after)) for h in hits)

    before, after = out["tokens"]
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows(before))
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == set(texts)
    assert all(r.decodes and r["ids"] == library.encode(texts[d]) for d, r in got.items())


def test_run_and_edge_rows(spark):
    assert pipeline.run(spark, SF).count() > 20
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w" * 100000, None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, odd.limit(0), SF).count() == 0
