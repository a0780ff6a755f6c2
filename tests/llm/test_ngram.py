"""The n-gram model against a plain one over strings, its arrays, its SQL and awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import awkward, compare, empty, words

from quillspark.llm import entries, ngram
from quillspark.llm import words as W

SPACE = "[^\x20\x09-\x0d]+"


def tokens(text):
    return [*re.findall(SPACE, (text or "").translate({c: c + 32 for c in range(65, 91)})), " end"]


def brute(train, texts, order):
    """(n_tokens, n_known, base, score) of each text, by the definitions."""
    counts = {k: Counter() for k in range(1, order + 1)}
    raw = Counter()
    for t in train:
        seq = [" start"] * (order - 1) + tokens(t)
        raw.update(seq[order - 1 :])
        for i in range(order - 1, len(seq)):
            counts[order][tuple(seq[i - order + 1 : i + 1])] += 1
    for k in range(order, 1, -1):
        for gram in counts[k]:
            counts[k - 1][gram[1:]] += 1
    total, kinds = sum(raw.values()), len(raw)
    off, context = {}, {}
    for k in range(1, order + 1):
        n = [sum(c == x for c in counts[k].values()) for x in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [min(max(x - (x + 1) * y * n[x] / n[x - 1], 0), x) for x in (1, 2, 3)] if all(n[:3]) else [0.5, 1, 1.5]
        off[k] = lambda c, d=d: 0 if c == 0 else d[min(c, 3) - 1]
        context[k] = defaultdict(lambda: [0, 0.0])
        for gram, c in counts[k].items():
            context[k][gram[:-1]][0] += c
            context[k][gram[:-1]][1] += off[k](c)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / (kinds + 1)
        if gram[:-1] not in context[k]:
            return lower
        all_, kept = context[k][gram[:-1]]
        c = counts[k][gram]
        return max(c - off[k](c), 0) / all_ + kept / all_ * lower

    out = []
    for t in texts:
        seq = [" start"] * (order - 1) + tokens(t)
        own = tokens(t)
        score = sum(math.log10(p(tuple(seq[i - order + 1 : i + 1]))) for i in range(order - 1, len(seq)))
        out.append((len(own), sum(raw[w] > 0 for w in own), sum(math.log10((raw[w] + 1) / (total + kinds + 1)) for w in own), score))
    return out


def got(spark, train, texts, order, **how):
    rows = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "k long, text string, score string")
    model = ngram.train(spark.createDataFrame([(t,) for t in train], "text string"), order=order, **how)
    return [(r.n_tokens, r.n_known, r.base_score, r.score) for r in sorted(ngram.scored(rows, model).collect(), key=lambda r: r.k)]


def zipf(rng, n):
    return " ".join(f"w{int(40 / (1 + 39 * rng.random()))}" for _ in range(n))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_a_plain_model(spark, order):
    rng = random.Random(order)
    train = [zipf(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", "Straße É a", words(rng, 300)]
    texts = train[:30] + [zipf(rng, 40), words(rng, 30), None, " \t", "É É É unseen w1 w1", "w1"]
    want = brute(train, texts, order)
    for x, y in zip(got(spark, train, texts, order, bucket=400), want, strict=True):  # several buckets, every word of w1 and w2 hot
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    rng = random.Random(1)
    model = ngram.train(spark.createDataFrame([(zipf(rng, 50),) for _ in range(40)], "text string"), order=2).open()
    names = [f"w{k}" for k in range(1, 41)]
    found = W.words_of(pa.array([" ".join(names)]))
    known = [*found.hash[model.word(found.hash)[0] > 0].tolist(), int(ngram.END)]
    for before in (found.hash[0], ngram.START):
        columns = [np.full(len(known), before, np.uint64), np.array(known, np.uint64)]
        order = np.argsort(W.combine(columns))
        p = model.probability([c[order] for c in columns]).sum()
        unknown = model.probability([np.array([before], np.uint64), np.array([12345], np.uint64)])[0]
        assert p + unknown == pytest.approx(1, abs=1e-9)


def test_agrees_with_sql(spark, sf_dir):
    compare(entries.queries()["op12_lm_scoring"](spark, sf_dir), ngram.OP12_SQL, sf_dir)


def test_held_out_texts_score_better_than_by_single_words(spark, sf_dir):
    rows = entries.queries()["op12_lm_scoring"](spark, sf_dir).where("held_out").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_awkward(spark):
    docs = awkward(spark)
    texts = [r.text for r in docs.collect()]
    model = ngram.train(docs)
    rows = ngram.scored(docs, model).collect()
    assert len(rows) == len(texts)
    want = dict(zip([(t or "") for t in texts], brute(texts, texts, 2)))
    for r in rows:
        y = want[r.text or ""]
        assert (r.n_tokens, r.n_known) == y[:2] and (r.base_score, r.score) == pytest.approx(y[2:], rel=1e-9)


def test_empty(spark):
    model = ngram.train(empty(spark))
    assert ngram.scored(empty(spark), model).count() == 0
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram.scored(spark.createDataFrame([("a b",)], "text string"), model).collect()] == [(3, 0, 0.0, 0.0)]


def test_slices_and_sends_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    train = [zipf(rng, 60) for _ in range(60)]
    want = got(spark, train, train[:9], 3)
    monkeypatch.setattr(W, "SLICE", 500)
    monkeypatch.setattr(ngram, "GATHER", 50)
    for x, y in zip(got(spark, train, train[:9], 3), want, strict=True):
        assert x == pytest.approx(y)


@pytest.mark.parametrize("piece", [8, 64, 1 << 20])
def test_words_of_arrow(monkeypatch, piece):
    """Places and hashes do not depend on how bytes are grouped, nor on what stands around a word."""
    texts = ["Hello  World", None, "", "abc", "abc def\tabc", " x", "É a" * 3, "y" * 100 + " z", "y" * 100, "a b c " + "q" * 70 + " abc"]
    whole = {W.words_of(pa.array([w])).hash[0]: w for t in texts for w in tokens(t)[:-1]}
    monkeypatch.setattr(W, "PIECE", piece)
    column = pa.array(["dropped", *texts]).slice(1)
    got = W.words_of(column)
    want = [(k, w) for k, t in enumerate(texts) for w in tokens(t)[:-1]]
    assert [(int(r), got.data[a:b].tobytes().decode()) for r, a, b in zip(got.row, got.start, got.end)] == want
    assert [whole[h] for h in got.hash] == [w for _, w in want] and len(whole) == len({w for _, w in want})
