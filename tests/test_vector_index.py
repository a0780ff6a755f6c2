"""Inverted vector lists against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dense as D
from quillspark.operators import sizes
from quillspark.operators import vector_index as V


def rows(spark, m, null_every=0):
    data = [(k, None if null_every and k % null_every == 0 else [float(x) for x in v]) for k, v in enumerate(m)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>")


def clustered(n, seed, groups=20, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 4
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims))


def test_all_lists_are_the_exact_search(spark):
    v = rows(spark, clustered(600, 1), null_every=50)
    asked = v.where("vec_id % 20 = 1")
    index = V.build(v, lists=12)
    assert index.lists.agg(F.sum("n")).first()[0] == 588
    got, want = (x.collect() for x in (V.search(index, asked, 5, probes=12), D.search(v, asked, 5)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_calibrated_probes_reach_the_recall_with_less_work(spark):
    v = rows(spark, clustered(3000, 2))
    asked = v.where("vec_id % 30 = 7")
    index = V.build(v, lists=40)
    probes = V.calibrated(index, v, 10)
    found = V.recall(V.search(index, asked, 10, probes=probes), D.search(v, asked, 10)).agg(F.avg("recall")).first()[0]
    work = V.work(index, asked, probes=probes).first()
    assert found >= 0.95 and work.compared < 0.35 * work.all_pairs


def test_a_hot_list_is_many_blocks(spark, monkeypatch):
    """A third of all vectors equal: their list is cut into blocks, and all of them are found."""
    monkeypatch.setattr(V, "VECTORS", 50)
    m = clustered(900, 3)
    m[:300] = m[0]
    v = rows(spark, m)
    index = V.build(v, lists=10)
    hot = index.lists.groupBy("list").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).orderBy(F.desc("n")).first()
    assert hot.n >= 300 and hot.blocks >= 6
    got = V.search(index, v.where("vec_id = 5"), 299, probes=1).collect()
    assert len(got) == 299 and all(r.score == 1.0 and r.doc_id < 300 for r in got)


def test_empty_and_null(spark):
    v = rows(spark, np.zeros((0, 4)))
    assert V.search(V.build(v, lists=3), v, 5, probes=2).count() == 0
    nothing = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert V.search(V.build(nothing, lists=3), nothing, 5, probes=2).count() == 0
    zeros = rows(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]))
    got = V.search(V.build(zeros, lists=2), zeros, 2, probes=2).where("query_id = 1").collect()
    assert {(r.doc_id, r.score) for r in got} == {(0, 0.0), (2, 0.0)}


def test_too_many_centroids_are_refused(spark, monkeypatch):
    monkeypatch.setattr(V, "CENTROID_BYTES", 100)
    with pytest.raises(ValueError):
        V.build(rows(spark, clustered(100, 4)), lists=10)


def test_broadcast_only_below_the_limit(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2, 3])] * 10, "t string, a array<int>")
    assert sizes.small(df, 11000) and not sizes.small(df, 10000)
    assert "ResolvedHint" in sizes.checked_broadcast(df)._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in sizes.checked_broadcast(df, 10)._jdf.queryExecution().analyzed().toString()
