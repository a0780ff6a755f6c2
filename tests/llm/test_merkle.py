"""The manifest against a plain tree of the whole table, its SQL, and awkward rows."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import awkward, compare, empty

from quillspark.llm import entries, merkle


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        start = i // 8 * 8
        steps.append(("".join(level[start:i]), "".join(level[i + 1 : start + 8])))
        i //= 8
    return steps


def brute(rows, hit):
    groups = {}
    for r in rows:
        low = None if r.text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        own, seen = (leaf((r.doc_id, r.source, r.lang, r.n_chars, t)) for t in (r.text, low if hit(r.doc_id) else r.text))
        groups.setdefault(r.lang, []).append((r.doc_id, own, seen))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in groups[n]]) for n in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, n in enumerate(names):
        for i, (doc, own, seen) in enumerate(groups[n]):
            steps = path(trees[k], i) + path(top, k)
            folded = seen
            for left, right in steps:
                folded = digest(left + folded + right)
            out.append((doc, own, trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return Counter(out)


def tampered(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0


def test_agrees_with_sql(spark, sf_dir):
    compare(entries.queries()["op13_merkle_manifest"](spark, sf_dir), merkle.OP13_SQL, sf_dir)


def test_awkward_against_a_plain_tree(spark):
    docs = awkward(spark)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    got = merkle.manifest(docs, tampered=F.when(hit, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text")))
    assert Counter(map(tuple, got.collect())) == brute(docs.collect(), tampered)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 5000])
def test_sizes(spark, n):
    """Groups that end in a lone node, in one block and in several levels of blocks."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 7 == 0, "b").when(F.col("id") < 3, None).otherwise("a").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("T"), "id").alias("text"))
    got = merkle.manifest(docs)
    assert Counter(map(tuple, got.collect())) == brute(docs.collect(), lambda doc: False)


def test_empty(spark):
    assert merkle.manifest(empty(spark)).collect() == []


def test_a_changed_row_is_found_wherever_it_is(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("n_chars"), F.concat(F.lit("t"), "id").alias("text"))
    got = merkle.manifest(docs, tampered=F.when(F.col("doc_id").isin(0, 7, 511, 512, 699), F.lit("other")).otherwise(F.col("text")))
    assert {r.id for r in got.where("not verified").collect()} == {0, 7, 511, 512, 699}
