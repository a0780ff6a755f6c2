"""The pipeline's stages in order, on a test table and on the awkward rows."""

from collections import Counter

import corpus_pipeline as P
import pytest
from test_operators import awkward, empty

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == NAMES and docs.count() <= before, name
        before = docs.count()
    mixed = P.STAGES[3][1](spark, docs, sf_dir).persist()
    assert mixed.columns == NAMES
    done = P.STAGES[4][1](spark, mixed, sf_dir)
    assert done.count() == mixed.count() and set(done.columns) >= {"doc_id", "shard", "slot"}
    assert P.run(spark, sf_dir).count() == mixed.count()


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("k", range(5))
def test_awkward(spark, sf_dir, k):
    stage = P.STAGES[k][1]
    docs = awkward(spark)
    before = rows_of(docs)
    done = stage(spark, docs, sf_dir).persist()
    if k < 4:
        assert done.columns == docs.columns
        after = rows_of(done)
    if k == 0:  # texts without a letter go; copies are told apart by nothing but their text
        assert not any(t is None or not any(c.isalpha() for c in t) for _, t in after) and all(n == before[x] for x, n in after.items())
    if k == 1:  # one of the four copies, of the rows that repeat, and of the texts without a word
        assert [d for d, t in after if d in (0, 1, 2, 8, 14)] == [0] and set(after.values()) == {1}
        assert [d for d, t in after if not (t or "").split()] == [3]
        assert {t for _, t in after} >= {"one", "two words", "x" * 50000, "no id at all here in this row"}
    if k == 2:  # no row holds an item of the benchmark
        assert after == before
    if k == 3:  # nothing but rows of the input, none above twice its number
        assert set(after) <= set(before) and all(n <= 2 * before[x] for x, n in after.items())
    if k == 4:
        got = done.collect()
        held = Counter(r.shard for r in got)
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect()) and max(held.values()) == 1
        assert all(r.slot == 0 for r in got)
    assert stage(spark, empty(spark), sf_dir).count() == 0
