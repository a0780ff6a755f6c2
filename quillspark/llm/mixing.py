"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Plan: sizes are summed by source; targets come from one pass over the sorted caps (the closed form
of clamping sources at their cap and resharing the excess by weight until none is above); each
source's target is then met by whole repetitions of all its documents and a seeded fractional
one: documents in hash order until the source's remainder is used up, the last in part. The
running sum is two-level (hash buckets, then rows of the one bucket where the remainder ends),
so a source with a third of all rows is never gathered in one task.

Defined results: null and blank texts have size 0 and are taken 0 words; a null source is a source
of its own, after all others; repeated rows are taken alike up to the seeded order; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Scratch

#: Hash buckets of a source: the running sum is over their totals.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, source_size)``: one row per source.

    Sources by code point, null last, take the weights in turn. With caps ``max_epochs * size``,
    the water level L solves sum(min(cap, L * weight)) = share * sum(size); in order of cap
    / weight it is that of the first source that stays under its cap (later ones give less).
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(in_order) - 1, len(weights)) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = (
        s.withColumn("full", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("whole", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("whole") - F.col("full")) / F.col("open"))
    )
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every)
    return s.withColumn("level", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def order_key(id_col: Column, text: Column, seed: int) -> Column:
    """Rows without an id are told apart by their text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.coalesce(F.md5(text), F.lit(""))))))


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """``(id, source, order, size, source_size, target, taken)`` of every row; ``taken`` counts words, repetitions included.

    Each source's taken words equal its target, rounded; no document exceeds max_epochs (rounded
    up) times its size. Rows of one source follow each other in the md5 of seed and id, so
    reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col), F.col(text_col), seed).alias("order"))
    rows = scratch.write(rows.withColumn("bucket", (F.conv(F.substring("order", 1, 3), 16, 10)).cast("int")), "sizes")
    assert BUCKETS == 16**3 and not isinstance(id_type, T.NullType)
    cells = scratch.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("words", F.round("target").cast("long"))
    # whole repetitions for all, and the words that the fractional one still has to give
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = scratch.write(goal.withColumn("rest", F.col("words") - F.col("times") * F.col("source_size")), "targets")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most BUCKETS rows a source
    placed = cells.withColumn("before", before).join(goal, cells.source.eqNullSafe(goal.source)).select(cells.source, "bucket", "n", "before", "source_size", "target", "times", "rest")
    placed = placed.withColumn("edge", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    same = rows.source.eqNullSafe(placed.source) & (rows.bucket == placed.bucket)
    all_rows = rows.join(placed, same).select("id", rows.source, "order", "size", "source_size", "target", "times", "rest", "before", "edge", rows.bucket)
    inside = all_rows.where(~F.col("edge")).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    running = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = all_rows.where("edge").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - running)).cast("long"))
    out = inside.unionByName(edge)
    return out.select("id", "source", "order", "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("part")).alias("taken"))


def repeat_mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture as rows of docs: each document as often as its taken words fill it, a last part of
    half or more as a whole. A document of no words stays once if its source is taken at all."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    done = mix(docs, **how)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.when(F.col("target") > 0, 1).otherwise(0))
    # Rows that repeat an id: as many rows as there were, and the copies they got together.
    by_id = done.select(F.col("id").alias("__id"), F.col("order").alias("__order"), times.cast("int").alias("__times")).groupBy("__id", "__order").agg(F.sum("__times").alias("__sum"), F.count("*").alias("__rows"))
    own = order_key(F.col(id_col), F.col(text_col), how.get("seed", 42))
    joined = docs.withColumn("__own", own).join(by_id, F.col("__own") == F.col("__order")).drop("__own", "__order")
    each = F.ceil(F.col("__sum") / F.col("__rows")).cast("int")
    return joined.withColumn("__copy", F.explode(F.when(each > 0, F.sequence(F.lit(1), each)).otherwise(F.array().cast("array<int>")))).drop("__id", "__sum", "__rows", "__copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=42)
    return done.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'text ' || coalesce(md5(text), ''))) AS ord
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS f,
             sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o,
             sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS t FROM w),
v AS (SELECT *, max(CASE WHEN (t - f) / o * w <= cap THEN (t - f) / o END) OVER () AS lev FROM l),
g AS (SELECT source, source_size, coalesce(least(cap, lev * w), cap)::DOUBLE AS target FROM v),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS times FROM g),
r AS (SELECT d.doc_id, d.size, h.source_size, h.target, h.times, round(h.target)::BIGINT - h.times * h.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""
