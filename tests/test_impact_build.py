"""The impact index is made without shuffling postings; their numbers are known without a search."""

from pyspark.sql import functions as F
from test_impacts import corpus

from quillspark.operators import impacts as I
from quillspark.operators import lexical as L


def test_build_and_work(spark, monkeypatch):
    docs, asked = corpus(spark)
    index = L.build(docs, "doc_id", F.col("text"))
    made, plans = [], []
    monkeypatch.setattr(I, "BLOCK", 7)
    plain = I.written

    def noted(df, name):
        made.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(I, "written", noted)
    built = I.build(index)
    assert "Exchange" not in plans[made.index("blocks")] and "Exchange" not in built.forward._jdf.queryExecution().executedPlan().toString()
    assert built.blocks.agg(F.max(F.size("docs"))).first()[0] == 7
    postings = {(r.term, d) for r in built.blocks.collect() for d in r.docs}
    assert postings == {(r.term, r.doc_id) for r in index.postings.collect()}
    want = index.terms.join(L.term_rows(asked, "q", F.col("text")).distinct(), "term").groupBy("q").agg(F.sum("df").alias("n"))
    made.clear()
    assert {(r.query_id, r.postings) for r in I.work(built, asked, "q", F.col("text")).collect()} == {(r.q, r.n) for r in want.collect()}
    assert made == ["asked", "terms"]  # no blocks are read for it
