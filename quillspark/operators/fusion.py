"""Fusion of ranked lists, score mixes and ranked deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, EngineConfig


def min_max(rows: DataFrame, score: str = "score", by: str = "query_id", name: str = "norm") -> DataFrame:
    """Scores of each list to 0..1; a list of one value to all ones."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn(name, F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))


def weighted(dense: DataFrame, sparse: DataFrame, question: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, doc_id, d, s, q, score): normalised lists, full outer; the question list is cut to the others' documents first."""
    keys = ["query_id", "doc_id"]
    candidates = dense.select(*keys).union(sparse.select(*keys)).distinct()
    lists = {"d": dense, "s": sparse, "q": question.join(candidates, keys, "left_semi")}
    # one aggregation over the three tagged lists is their full outer join
    tagged = None
    for tag, rows in lists.items():
        part = min_max(rows.select(*keys, "score")).select(*keys, F.lit(tag).alias("tag"), "norm")
        tagged = part if tagged is None else tagged.unionByName(part)
    one = lambda t: F.coalesce(F.max(F.when(F.col("tag") == t, F.col("norm"))), F.lit(0.0)).alias(t)
    merged = tagged.groupBy(*keys).agg(one("d"), one("s"), one("q"))
    bonus = F.when((F.col("d") > 0) & (F.col("s") > 0), cfg.both_bonus).otherwise(0.0)
    return merged.withColumn("score", F.round(cfg.dense_weight * F.col("d") + cfg.sparse_weight * F.col("s") + cfg.question_weight * F.col("q") + bonus, 6))


def reciprocal_rank(lists: list[DataFrame], cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, doc_id, score): sum of 1 / (k + rank) over the lists."""
    rows = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        rows = rows.union(x.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (cfg.rrf_k + F.col("rank"))), 6).alias("score"))


def combine_question(full: DataFrame, question: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, doc_id, score): full-text score plus the boosted question score, either list alone included."""
    keys = ["query_id", "doc_id"]
    both = full.select(*keys, "score").union(question.select(*keys, (F.col("score") * cfg.question_boost).alias("score")))
    return both.groupBy(*keys).agg(F.sum("score").alias("score"))  # at most two addends


def dedupe(rows: DataFrame, key: Column, by: str = "query_id") -> DataFrame:
    """The best row of each key and query; rows of an empty key all stay."""
    w = Window.partitionBy(by, "__key").orderBy(F.desc("score"), "doc_id")
    ranked = rows.withColumn("__key", key).withColumn("__r", F.row_number().over(w))
    return ranked.where((F.col("__r") == 1) | (F.col("__key") == "")).drop("__key", "__r")


def rerank_mix(rows: DataFrame, marks: DataFrame, share: float = 0.30, floor: float = DEFAULT.heavy_rerank_floor) -> DataFrame:
    """Scores mixed with a reranker's marks; unmarked rows are rejected, as are marks under the floor."""
    both = rows.join(marks, ["query_id", "doc_id"]).where(F.col("mark") >= floor)
    return both.withColumn("score", share * F.col("score") + (1 - share) * F.col("mark"))
