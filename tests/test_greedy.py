"""Greedy batches against the loop."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import greedy


def loop(sizes, most, limit):
    out, n, held, total = [], 0, 0, 0
    for s in sizes:
        s = s or 0
        if held and (held == most or total + s > limit):
            n, held, total = n + 1, 0, 0
        out.append(n)
        held, total = held + 1, total + s
    return out


@pytest.mark.parametrize(("n", "most", "limit", "blocks"), [(1, 3, 10, 8), (700, 5, 60, 1), (900, 64, 500, 1), (640, 1, 10, 1), (513, 64, 10**9, 8)])
def test_as_the_loop_cuts(spark, monkeypatch, n, most, limit, blocks):
    monkeypatch.setattr(greedy, "BLOCKS", blocks)
    rng = random.Random(n)
    sizes = [None if rng.random() < 0.02 else rng.choice([0, 1, 3, 8, 20, 70]) for _ in range(n)]
    rows = spark.createDataFrame([(k * 3 - 40, s, "kept") for k, s in enumerate(sizes)], "id long, size long, pos_of string").repartition(5)
    got = greedy.batches(rows, [F.col("id").asc()], "size", most=most, limit=limit).orderBy("id").collect()
    assert [r.batch_id for r in got] == loop(sizes, most, limit) and all(r.pos_of == "kept" for r in got)


def test_empty(spark):
    rows = spark.createDataFrame([], "id long, size long")
    assert greedy.batches(rows, [F.col("id").asc()], "size", most=5, limit=10).count() == 0
