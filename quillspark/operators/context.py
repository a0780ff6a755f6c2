"""Context windows, prompts, query understanding, extractive answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def trim_to_budget(rows: DataFrame, tokens: Column, budget: int, least: int = 20) -> DataFrame:
    """Ranked rows up to a token budget; the first that overflows stays, cut, if more than ``least`` tokens are left."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("tokens", tokens).withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    left = budget - F.col("before")
    return r.withColumn("used", F.least("tokens", left)).where((F.col("before") + F.col("tokens") <= budget) | (left > least)).where(left > 0)


def blocks(rows: DataFrame, text: Column, most: int = 3) -> DataFrame:
    """(query_id, context): numbered blocks of a query's first rows."""
    line = F.format_string("[%d] %s", F.col("rank").cast("int"), F.substring(text, 1, 80))
    top = rows.where(F.col("rank") <= most).select("query_id", "rank", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "\n")
    return top.groupBy("query_id").agg(joined.alias("context"))


def expand_terms(queries: DataFrame, query_id: str, query_text: Column, groups: list[list[str]], cap: int = 32) -> DataFrame:
    """(query_id, expanded): query words, then the members of every synonym group that one of them belongs to, in group order, once."""
    ws = T.tokens(query_text, 2)
    extra = F.array().cast("array<string>")
    for g in groups:
        extra = F.concat(extra, F.when(F.arrays_overlap(ws, F.array(*[F.lit(w) for w in g if " " not in w])), F.array(*[F.lit(w) for w in g])).otherwise(F.array().cast("array<string>")))
    return queries.select(F.col(query_id).alias("query_id"), F.array_join(F.slice(F.array_distinct(F.concat(ws, extra)), 1, cap), " ").alias("expanded"))


def rule_domain(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose pattern the text holds."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def extractive(rows: DataFrame, answer: Column, most: int = 2500) -> DataFrame:
    """(query_id, doc_id, answer): the first row's answer."""
    return rows.where("rank = 1").select("query_id", "doc_id", F.substring(answer, 1, most).alias("answer"))


def clean_expansion(text: Column, present: Column, least: int, cap: int) -> Column:
    """Terms of an expansion: long enough, no stop words, none already present, each once, at most cap."""
    fresh = F.filter(T.tokens(text, least, T.STOP_WORDS), lambda t: ~F.array_contains(present, t))
    return T.ordered_unique(fresh, cap)
