"""Relevance gates after ranking: floors, rare anchors, allow-lists, group detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def score_floors(rows: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Rows at the absolute floor and the relative floor of their query; the first stays if it reaches the absolute one."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = (F.col("score") >= cfg.score_floor) & ((F.col("rank") == 1) | (F.col("score") >= cfg.relative_floor * F.col("__best")))
    return rows.withColumn("__best", best).where(kept).drop("__best")


def anchors(hits: DataFrame, texts: DataFrame, queries: DataFrame, query_id: str, query_text: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, term): query terms that some, but under a share, of the query's best documents hold."""
    pool = hits.where(F.col("rank") <= cfg.anchor_pool).join(texts, "doc_id")
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("pool"))
    held = pool.select("query_id", "doc_id", F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(T.tokens(query_text, 2, T.STOP_WORDS))).alias("term"))
    df = held.join(asked, ["query_id", "term"]).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    return df.join(sizes, "query_id").where(F.col("df") < cfg.anchor_share * F.col("pool")).select("query_id", "term")


def anchor_hits(hits: DataFrame, texts: DataFrame, marks: DataFrame, text: Column) -> DataFrame:
    """hits with the number of their query's anchors that a text holds."""
    words = hits.join(texts, "doc_id").select("query_id", "doc_id", F.explode_outer(F.array_distinct(T.tokens(text))).alias("term"))
    n = words.join(marks, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("anchor_hits"))
    return hits.join(n, ["query_id", "doc_id"], "left").withColumn("anchor_hits", F.coalesce("anchor_hits", F.lit(0)).cast("long"))


def anchor_filter(hits: DataFrame, in_question: DataFrame, in_body: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows with an anchor in the question; for queries where none has one, in the body; queries without anchors keep all.

    ``mode`` says which way a query went."""
    keys = ["query_id", "doc_id"]
    asked = marks.groupBy("query_id").agg(F.count("*").alias("n_anchors"))
    both = hits.join(in_question.select(*keys, F.col("anchor_hits").alias("aq")), keys).join(in_body.select(*keys, F.col("anchor_hits").alias("ab")), keys).join(asked, "query_id", "left")
    w = Window.partitionBy("query_id")
    mode = F.when(F.col("n_anchors").isNull(), "no_anchors").when(F.max("aq").over(w) > 0, "question").when(F.max("ab").over(w) > 0, "body_fallback").otherwise("miss")
    keep = (F.col("mode") == "no_anchors") | ((F.col("mode") == "question") & (F.col("aq") > 0)) | ((F.col("mode") == "body_fallback") & (F.col("ab") > 0))
    return both.withColumn("mode", mode).where(keep)


def coverage_floor(rows: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Where a query's best row holds two anchors or more, rows need half as many (rounded up)."""
    best = F.max("aq").over(Window.partitionBy("query_id"))
    return rows.withColumn("__best", best).where((F.col("__best") < 2) | (F.col("aq") >= F.greatest(F.lit(1), F.ceil(F.col("__best") * cfg.coverage_share)))).drop("__best")


def allow(rows: DataFrame, group_of: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose source belongs to the group that their query asks for; queries that ask for none keep all."""
    both = rows.join(group_of, "source", "left").join(wanted, "query_id", "left")
    return both.where(F.col("wanted").isNull() | (F.col("grp") == F.col("wanted")))


def leaks(rows: DataFrame) -> DataFrame:
    """Rows after the allow-list that still lie outside the wanted group: empty if the gate holds."""
    return rows.where(F.col("wanted").isNotNull() & (F.col("grp").isNull() | (F.col("grp") != F.col("wanted"))))


def detect_group(queries: DataFrame, query_id: str, query_text: Column, keywords: list[tuple[str, str]]) -> DataFrame:
    """(query_id, grp): the first group in list order with a keyword in the query: whole words, or anywhere if it has a space or hyphen."""
    t = F.lower(query_text)
    ws = T.tokens(query_text, 1)
    out = F.lit(None).cast("string")
    for grp, word in reversed(keywords):
        hit = F.contains(t, F.lit(word)) if " " in word or "-" in word else F.array_contains(ws, word)
        out = F.when(hit, F.lit(grp)).otherwise(out)
    return queries.select(F.col(query_id).alias("query_id"), out.alias("grp"))
