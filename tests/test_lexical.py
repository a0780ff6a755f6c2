"""Searches that score documents where their rows are, against the joins of postings and terms."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexical as L

def fields():
    return {"title": F.col("a"), "question": F.col("b"), "answer": F.col("c")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, n=300):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["ab", "zz"]
    text = lambda m: " ".join(r.choice(words[: r.choice([5, 42])]) for _ in range(r.randrange(m)))
    # exact copies tie in their scores
    docs = [(i, *(("ab w1 w2", "w3", "w4 w4") if i % 7 == 0 else (text(4), text(9), text(30)))) for i in range(n)]
    docs = spark.createDataFrame([(*d, " ".join(d[1:]) if d[0] % 50 else None) for d in docs], "doc_id long, a string, b string, c string, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(12)) for i in range(20)] + [(90, "w1 w1 ab ab"), (91, "nowhere"), (92, None)], "id long, t string")
    return docs, asked


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [L.QUERY_BYTES, 0])
def test_search_is_the_top_of_all_scores(spark, monkeypatch, limit):
    docs, asked = tables(spark)
    monkeypatch.setattr(L, "QUERY_BYTES", limit)
    monkeypatch.setattr(L, "CELLS", 500)  # many slices of documents
    index = L.build(docs, "doc_id", F.col("text"))
    want = L.top(L.scores(index, asked, "id", F.col("t")), 6)
    got = L.search(index, asked, "id", F.col("t"), 6)
    assert rows(got.select(want.columns)) == rows(want) and len(rows(want)) > 100


@pytest.mark.parametrize("limit", [L.QUERY_BYTES, 0])
@pytest.mark.parametrize("by, least, k", [("raw", 0, 4), ("percent", 18, 3), ("percent", 20, None)])
def test_field_search_is_the_top_of_all_weighted(spark, monkeypatch, limit, by, least, k):
    docs, asked = tables(spark)
    monkeypatch.setattr(L, "QUERY_BYTES", limit)
    every = L.weighted_search(L.field_postings(docs, "doc_id", fields()), asked, "id", F.col("t")).where(F.col("percent") >= least)
    every = every.select("query_id", "doc_id", F.col(by).cast("double").alias("score"))
    want = L.top(every, k) if k else every
    got = L.field_search(docs, "doc_id", fields(), asked, "id", F.col("t"), k, least=least, by=by)
    assert rows(got.select(want.columns)) == rows(want) and rows(want)


def test_index_and_scores_shuffle_nothing(spark):
    """Before, every posting and every pair of a query and a document that share a word was shuffled."""
    docs, _ = tables(spark)
    made = spark.createDataFrame([(1, "x y", 1)], "doc_id long, text string, n int")
    index = L.build(made, "doc_id", F.col("text"))
    assert "Exchange" not in plan(index.docs)
    assert {r.doc_id: dict(zip(r.terms, r.tfs)) for r in L.build(spark.createDataFrame([(7, "aa bb aa"), (8, "x"), (9, None)], "doc_id long, text string"), "doc_id", F.col("text")).docs.collect()} == {7: {"aa": 2, "bb": 1}}
    asked = spark.createDataFrame([(1, "ab", 1.0, 0)], "query_id long, term string, weight double, size int")
    found = L.best(L.build(docs, "doc_id", F.col("text")).docs.select("doc_id", "dl", "terms", "tfs"), lambda b: (_ := L._rows_of(b.column(2)), b.column(2).flatten(), b.column(3).flatten().to_numpy(), 1.0 + 0 * _), asked, lambda s, _: s, 2)
    assert plan(found).count("Exchange") == plan(docs).count("Exchange")
    assert found.count() <= 2 * docs.rdd.getNumPartitions()
