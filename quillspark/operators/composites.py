"""Whole retrieval paths made of the operators: fast path, dispatch by group, listwise rerank, retrieval-augmented answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from . import context as C
from . import fusion as U
from . import gates as G
from .enrich import dimension
from .lexical import top


def pair_key(text: Column) -> Column:
    """Question and answer heads as one digest."""
    return F.sha1(F.concat_ws("|", F.substring(T.question_of(text), 1, 200), F.substring(T.answer_of(text), 1, 400)))


def reranked(rows: DataFrame, marks: DataFrame, pool: int, k: int, floor: float) -> DataFrame:
    """The k best of each query's first rows by mark, then score; unmarked rows and marks under the floor are rejected."""
    first = rows.where(F.col("rank") <= pool).drop("rank")
    both = first.join(marks, [c for c in ("query_id", "doc_id") if c in marks.columns]).where(F.col("mark") >= floor)
    w = Window.partitionBy("query_id").orderBy(F.desc("mark"), F.desc("score"), "doc_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fast_retrieve(combined: DataFrame, texts: DataFrame, queries: DataFrame, query_id: str, query_text: Column, group_of: DataFrame, wanted: DataFrame, marks: DataFrame, k: int = 6, cfg: EngineConfig = DEFAULT, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """``combined(query_id, doc_id, score)`` through the whole fast path: one row of each question and answer, the asked
    group only, rows with rare anchors, score floors, anchor coverage, order by anchors and score, rerank.

    ``cut`` is given tables that several later steps read: one that writes them saves computing them again.
    Returns the rows, and ``(query_id, reason)``: for every query ok, or the step that left it without rows."""
    combined = cut(combined)
    one = U.dedupe(combined.join(texts, "doc_id"), pair_key(F.col("text")))
    allowed = G.allow(one.select("query_id", "doc_id", "score", "source"), group_of, wanted)
    allowed = cut(allowed.select("query_id", "doc_id", "score"))
    pool = top(allowed, cfg.anchor_pool)
    body = texts.select("doc_id", "text")
    found = cut(G.anchors(pool, body, queries, query_id, query_text, cfg))
    in_q, in_b = (G.anchor_hits(pool, body, found, c) for c in (T.question_of(F.col("text")), F.col("text")))
    anchored = cut(G.anchor_filter(pool, in_q, in_b, found))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    floored = G.score_floors(anchored.drop("rank").withColumn("rank", F.row_number().over(w)), cfg)
    covered = G.coverage_floor(floored, cfg)
    order = Window.partitionBy("query_id").orderBy(F.desc("aq"), F.desc("score"), "doc_id")
    ordered = covered.drop("rank").withColumn("rank", F.row_number().over(order))
    done = reranked(ordered.select("query_id", "doc_id", "score", "mode", "rank"), marks, max(k, 12), k, cfg.rerank_floor)
    steps = {"empty_query": combined, "group_filter_empty": allowed, "rare_anchor_miss": anchored, "top_score_below_floor": floored, "rerank_threshold_miss": done}
    reason = queries.select(F.col(query_id).alias("query_id"))
    for name, rows in steps.items():
        reason = reason.join(rows.select("query_id").distinct().withColumn(name, F.lit(True)), "query_id", "left")
    first = F.coalesce(*[F.when(F.col(n).isNull(), n) for n in steps], F.lit("ok"))
    return done, reason.select("query_id", first.alias("reason"))


def by_group(rows: DataFrame, group_of: DataFrame, k: int) -> DataFrame:
    """(query_id, grp, doc_id, score, rank): the k best of every group, none from outside it."""
    w = Window.partitionBy("query_id", "grp").orderBy(F.desc("score"), "doc_id")
    inside = rows.join(group_of, "doc_id").where(F.col("grp").isNotNull())
    return inside.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "grp", "doc_id", "score", "rank")


def dispatch(rows: DataFrame, group_of: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Queries that name a group get its k best, the others the k best of all."""
    both = rows.join(group_of, "doc_id").join(wanted, "query_id", "left").where(F.col("wanted").isNull() | (F.col("grp") == F.col("wanted")))
    return top(both.select("query_id", "doc_id", "score", "grp", "wanted"), k)


def legacy_rerank(rows: DataFrame, marks: DataFrame, k: int, share: float = 0.45, floor: float = 0.42) -> DataFrame:
    """Scores mixed with marks, those at the floor; where a query has none there, its best rows by score as they were."""
    both = rows.join(marks, "doc_id", "left")
    mixed = F.round(share * F.col("score") + (1 - share) * F.coalesce("mark", F.lit(0.0)), 6)
    judged = both.withColumn("mixed", mixed).withColumn("over", F.coalesce(F.col("mark") >= floor, F.lit(False)))
    any_over = F.max("over").over(Window.partitionBy("query_id"))
    kept = judged.withColumn("any", any_over).where(F.col("over") | ~F.col("any"))
    return top(kept.select("query_id", "doc_id", F.when(F.col("any"), F.col("mixed")).otherwise(F.col("score")).alias("score"), F.col("any").alias("reranked")), k)


def prompts(rows: DataFrame, queries: DataFrame, query_id: str, query_text: Column, budget: int, template: str) -> DataFrame:
    """(query_id, n_sources, prompt): ranked rows up to the budget as numbered blocks in a template with %s for question and context."""
    cut = C.trim_to_budget(rows, T.token_estimate(F.col("text")), budget)
    ctx = C.blocks(cut, T.question_of(F.col("text")), 10)
    n = cut.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    asked = queries.select(F.col(query_id).alias("query_id"), query_text.alias("question"))
    both = asked.join(ctx, "query_id", "left").join(n, "query_id", "left")
    return both.select("query_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.format_string(template, "question", F.coalesce("context", F.lit(""))).alias("prompt"))


def rag(rows: DataFrame, queries: DataFrame, query_id: str, query_text: Column, budget: int, template: str) -> DataFrame:
    """(query_id, n_sources, prompt, answer): the default generator answers with the first source's answer, or the sentinel."""
    from .guards import SENTINEL

    answer = C.extractive(rows, T.answer_of(F.col("text"))).select("query_id", "answer")
    done = prompts(rows, queries, query_id, query_text, budget, template).join(answer, "query_id", "left")
    return done.select("query_id", "n_sources", "prompt", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit(SENTINEL)).alias("answer"))


def filtered_or_all(rows: DataFrame, keep: Column, k: int) -> DataFrame:
    """The k best that are kept; for queries where none is, the k best of all."""
    hit = F.max(keep.cast("int")).over(Window.partitionBy("query_id"))
    return top(rows.withColumn("__keep", keep).withColumn("__hit", hit).where((F.col("__hit") == 0) | F.col("__keep")).drop("__keep", "__hit"), k)


def descend(picks: DataFrame, records: DataFrame, queries: DataFrame, query_id: str, query_text: Column, k: int = 5) -> DataFrame:
    """``picks(query_id, path)`` of leaves and ``records(path, doc_id, title)``: the k records under a query's leaves whose titles hold
    most of its terms, with relevance by rank."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(T.tokens(query_text, 3, T.STOP_WORDS)).alias("terms"))
    leaf = dimension(picks.join(asked, "query_id"))
    scored = records.join(leaf, "path").withColumn("hits", F.size(F.filter("terms", lambda t: F.contains(F.lower("title"), t)))).where("hits > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), "title", "doc_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "doc_id", "path", "hits", "rank", (F.greatest(F.lit(30), 95 - 15 * (F.col("rank") - 1)) + F.least(F.lit(5), F.floor(F.col("hits") / 20))).cast("int").alias("relevance"))
