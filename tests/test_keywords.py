"""Keyword rules by automaton and by join against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import keywords as K


def plain(texts, rules, whole):
    best = {}
    for p, v, r in rules:
        p = (p or "").strip().lower()
        if p and v is not None:
            best[p] = min(best.get(p, (r or 0, v)), (r or 0, v))
    out = set()
    for i, t in texts:
        t = (t or "").lower()
        for p, (r, v) in best.items():
            at = [m.start() for m in re.finditer((r"(?<!\w)" if whole else "") + f"(?={re.escape(p)}" + (r"(?!\w)" if whole else "") + ")", t)]
            if at:
                out.add((i, p, v, r, len(at), at[0] + 1))
    return out


def data(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "abc", "b", "ca", "é", "x1", "ab_c", "АБ"])
    rules = [(" ".join(word() for _ in range(rng.randint(1, 3))), f"g{rng.randint(0, 5)}", rng.randint(0, 3)) for _ in range(60)] + [("", "none", 0), (None, "none", 0), ("ab", None, 0), ("AB  ", "z", 9)]
    texts = [(k, rng.choice([" ", "-"]).join(word() for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(900, None), (901, "")]
    return texts, rules


@pytest.mark.parametrize("whole", [True, False])
def test_automaton(spark, whole):
    texts, rules = data()
    docs, table = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rules, "pattern string, value string, priority int")
    got = {tuple(r) for r in K.matches(docs, "k", F.col("text"), table, whole_tokens=whole).collect()}
    assert got == plain(texts, rules, whole) and got


def test_too_large_for_an_automaton(spark, monkeypatch):
    texts, rules = data(2)
    texts = [(k, (t or "").replace("-", " ") if t is not None else None) for k, t in texts]
    docs, table = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rules, "pattern string, value string, priority int")
    monkeypatch.setattr(K, "RULE_BYTES", 10)
    got = {(r.id, r.pattern, r.value, r.priority, r["first"]) for r in K.matches(docs, "k", F.col("text"), table).collect()}
    assert got == {x[:4] + x[5:] for x in plain(texts, rules, True)}
    with pytest.raises(ValueError):
        K.matches(docs, "k", F.col("text"), table, whole_tokens=False)


def test_best_and_default(spark):
    rules = [("north", "region", 2), ("north sea", "water", 2), ("old", "age", 1)]
    texts = [(1, "the North Sea"), (2, "an old north"), (3, "nothing"), (4, None)]
    docs, table = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(rules, "pattern string, value string, priority int")
    assert {tuple(r) for r in K.assigned(docs, "k", F.col("text"), table, "other").collect()} == {(1, "water"), (2, "age"), (3, "other"), (4, "other")}
    assert {r.value for r in K.assigned(docs, "k", F.col("text"), table.limit(0), "other").collect()} == {"other"}


def test_thirty_thousand_rules(spark):
    rules = spark.range(30000).select(F.concat(F.lit("term"), "id").alias("pattern"), F.col("id").cast("string").alias("value"), F.lit(0).alias("priority"))
    docs = spark.range(200).select("id", F.concat_ws(" ", F.lit("a"), F.concat(F.lit("term"), F.col("id") * 100), F.lit("b")).alias("text"))
    assert {(r.id, r.value) for r in K.assigned(docs, "id", F.col("text"), rules, "").collect()} == {(k, str(k * 100)) for k in range(200)}
