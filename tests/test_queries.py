import pytest
from compare import assert_same

from answerlens.plans import eval_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = {**text_queries.QUERIES, **eval_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **eval_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_chunks_of_documents_hold_their_text(spark):
    """Without overlap, chunks put together are the text, white space aside."""
    from pyspark.sql import functions as F

    from answerlens.operators.chunking import split_chunks

    pages = text_queries.pages_of(spark, SF)
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    joined = lambda df, order, text: df.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("t")).select("document_id", squeeze(F.col("t")).alias("t"))
    a, b = joined(pages, "page", "text"), joined(split_chunks(pages, 120, 0), "ord", "content")
    assert a.filter("t <> ''").exceptAll(b).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
