"""Importance resampling against a plain version, its SQL and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from test_operators import awkward, compare, empty, words

from quillspark.llm import entries, importance

RUN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def found(text, lengths):
    w = re.findall(RUN, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in range(lengths[0], lengths[1] + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, lengths, buckets, percent, least):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    own, aim = Counter(), Counter()
    for _, t in rows:
        own.update(map(bucket, found(t, lengths)[1]))
    for t in target:
        aim.update(map(bucket, found(t, lengths)[1]))
    s, t_all = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in own}
    scored = []
    for doc, text in rows:
        w, f = found(text, lengths)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    able = able[: percent * len(able) // 100]
    return Counter(r[:4] for r in scored), [(r[3], r[0]) for r in able]


def check(done, rows, target, lengths=(1, 1), buckets=10000, percent=10, least=20):
    want, drawn = brute(rows, target, lengths, buckets, percent, least)
    done = done.collect()
    assert Counter((r.id, r.n_features, r.weight, r.score) for r in done) == want
    ranked = sorted((r for r in done if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r.score, r.id) for r in ranked] == drawn


def test_agrees_with_sql(spark, sf_dir):
    compare(entries.queries()["op11_importance_resampling"](spark, sf_dir), importance.OP11_SQL, sf_dir)


@pytest.mark.parametrize("lengths", [(1, 1), (1, 2), (2, 3)])
def test_against_a_plain_version(spark, monkeypatch, lengths):
    monkeypatch.setattr(importance, "CELL", 500)  # many salts
    monkeypatch.setattr(importance, "BLOCK", 16)  # blocks cut inside a batch
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("the cat sat on a mat and É ran 42 far".split()) for _ in range(rng.randint(0, 90))) + " " + words(rng, 5)) for k in range(300)]
    target = ["the cat ran far", "a cat and a mat", None, "É É 42"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), lengths=lengths, buckets=97, percent=30, least_words=10)
    check(done, rows, target, lengths, 97, 30, 10)


def test_awkward(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = ["one two words", None]
    check(importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=50, least_words=2), rows, target, percent=50, least=2)
    # no target: the corpus alone decides
    check(importance.resample(docs, empty(spark)), rows, [])


def test_empty(spark):
    assert importance.resample(empty(spark), empty(spark)).collect() == []
