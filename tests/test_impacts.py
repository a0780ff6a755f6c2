"""The impact index against scoring every posting."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import impacts as I
from quillspark.operators import lexical as L


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(300 ** rng.random())}"
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(n)]
    docs += [(n + k, "w1 w2 w3") for k in range(n // 2)]  # a third of all rows alike: ties by the hundred
    asked = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(25)] + [(90, "unheard of"), (91, None), (92, "w1"), (93, "w250 w250 w1")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "q long, text string")


def both(spark, docs, asked, k, path):
    plain = L.build(docs, "doc_id", F.col("text"))
    I.save(I.build(plain), path)
    found, work = I.search(I.load(spark, path), asked, "q", F.col("text"), k)
    want = L.top(L.scores(plain, asked, "q", F.col("text")), k)
    return sorted(map(tuple, found.collect())), sorted(map(tuple, want.select(*found.columns).collect())), {r.query_id: r for r in work.collect()}


@pytest.mark.parametrize(("k", "part"), [(1, 0.5), (5, 0.95), (300, 0.5)])
def test_equal_to_scoring_every_posting(spark, tmp_path, monkeypatch, k, part):
    monkeypatch.setattr(I, "UNREAD", part)
    monkeypatch.setattr(I, "POSTINGS_FIRST", 2)
    monkeypatch.setattr(I, "DOCS_FIRST", 1)
    monkeypatch.setattr(I, "BLOCK", 7)
    docs, asked = corpus(spark, seed=k)
    got, want, work = both(spark, docs, asked, k, str(tmp_path / "i"))
    assert got == want and {q for q, *_ in got} == set(work) and 90 not in work and 91 not in work


def test_common_terms_are_not_read(spark, tmp_path):
    """Queries with a rare term that k documents have: the postings of the common one stay unread."""
    rows = [(k, f"common filler{k % 5} " + ("rare rare rare " if k % 300 == 0 else "")) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want, work = both(spark, docs, spark.createDataFrame([(1, "common rare")], "q long, text string"), 3, str(tmp_path / "i"))
    assert got == want and work[1].postings == 6020 and work[1].postings_read < 0.1 * 6020


def test_empty_and_older_form(spark, tmp_path):
    docs, asked = corpus(spark)
    got, want, _ = both(spark, docs.limit(0), asked, 5, str(tmp_path / "i"))
    assert got == want == []
    docs.write.parquet(str(tmp_path / "old" / "blocks"))
    assert I.load(spark, str(tmp_path / "old")) is None and I.load(spark, str(tmp_path / "none")) is None
