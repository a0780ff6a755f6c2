"""Dimension lookups, source cards, decays, pool cuts, pruning and small relations over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .sizes import checked_broadcast

def dimension(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its bytes allow it; beyond, the join shuffles."""
    return checked_broadcast(df)


def filled(*cols: Column) -> Column:
    """The first column that holds more than blanks, trimmed; else a blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def display_name(folder: Column, names: Column, suffix: str = "_output") -> Column:
    """A folder's name from the dimension, else the folder without its suffix, in words."""
    bare = F.when(F.endswith(folder, F.lit(suffix)), F.substr(folder, F.lit(1), F.length(folder) - len(suffix))).otherwise(folder)
    return F.coalesce(names, F.initcap(F.replace(bare, F.lit("_"), F.lit(" "))))


def by_substring(path: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """The value of the first rule whose text the lower-cased path holds."""
    out = F.lit(default)
    for part, value in reversed(rules):
        out = F.when(F.contains(F.lower(path), F.lit(part)), F.lit(value)).otherwise(out)
    return out


def path_topic(path: Column) -> tuple[Column, Column]:
    """(category, subtopic): the folder above a file, and the file's stem without its suffix, in words."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\.[A-Za-z0-9]+$", ""), "_output$", "")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.trim(F.regexp_replace(stem, "[_-]+", " "))


def fill_blanks(rows: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with their blank columns filled from the side table; what is there stays, rows without a partner too."""
    other = side.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(dimension(other), key, "left")
    return joined.select(key, *[c for c in rows.columns if c != key and c not in columns], *[filled(F.col(c), F.col(f"__{c}")).alias(c) for c in columns])


def first_filled_by_id(rows: DataFrame, ids: Column, values: dict[str, Column], order: str) -> DataFrame:
    """(id, values): every id that a row's candidates yield, with the first filled value of each field in row order."""
    flat = rows.select(F.explode(F.array_distinct(ids)).alias("id"), F.col(order).alias("__o"), *[F.nullif(F.trim(c), F.lit("")).alias(n) for n, c in values.items()])
    return flat.groupBy("id").agg(*[F.coalesce(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("__o"))), F.lit("")).alias(n) for n in values])


def source_card(url: list[Column], question: Column, answer: Column, score: Column, cut: int = 1500) -> dict[str, Column]:
    """Fields of an answer's source: the first candidate that is a link, the answer cut, the score in 0..1."""
    link = F.coalesce(*[F.when(F.trim(u).rlike("^https?://"), F.trim(u)) for u in url], F.lit(""))
    return {"link": link, "question": F.coalesce(question, F.lit("")), "answer": F.coalesce(F.substring(answer, 1, cut), F.lit("")), "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)}


def decay(start: float, step: float, floor: float, rank: Column, score: Column | None = None) -> Column:
    """A score that falls by a step with every rank, down to a floor."""
    return F.greatest(F.lit(floor), (F.lit(start) if score is None else score) - step * (rank - 1))


def overfetch(rows: DataFrame, k: int, times: int, keep: Column, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of those among the k * times best that are kept: a filter after the pool is cut."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    pool = rows.withColumn("__p", F.row_number().over(w)).where(F.col("__p") <= k * times).where(keep)
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("__p"))).where(F.col("rank") <= k).drop("__p")


def best_or_first(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best with a positive score; if there is none, the best one."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.where((F.col(score) > 0) | (F.col("rank") == 1))


def prune(rows: DataFrame, score: str, share: float = 0.25, survivors: int = 24) -> DataFrame:
    """Rows at a share of their query's best score, if enough survive it; none where the best is not positive."""
    w = Window.partitionBy("query_id")
    best = F.max(score).over(w)
    bar = F.greatest(F.lit(1), F.floor(F.col("__best") * share))
    marked = rows.withColumn("__best", best).where("__best > 0").withColumn("__over", F.col(score) >= bar)
    return marked.withColumn("__n", F.count_if("__over").over(w)).where((F.col("__n") < survivors) | F.col("__over")).drop("__best", "__over", "__n")


def is_permutation(order: Column, n: Column) -> Column:
    """Whether an order names each of 1..n once."""
    return (F.size(order) == n) & (F.array_sort(order) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))


def picked(picks: DataFrame, known: DataFrame, key: str, k: int) -> DataFrame:
    """``picks(query_id, picks)`` -> the first k named keys that exist, each once, in the order named."""
    named = picks.select("query_id", F.posexplode(F.array_distinct("picks")).alias("pos", key))
    real = named.join(dimension(known.select(key).distinct()), key, "left_semi")
    w = Window.partitionBy("query_id").orderBy("pos")
    return real.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", key, "rank")


def relevant_sources(rows: DataFrame, hay: Column, terms: Column, top: int = 3) -> DataFrame:
    """(query_id, relevant): how many of a query's first sources hold any of its terms."""
    hit = F.exists(terms, lambda t: F.contains(F.lower(hay), t))
    return rows.where(F.col("rank") <= top).groupBy("query_id").agg(F.count_if(hit).alias("relevant"))


def sample_by_hash(rows: DataFrame, key: str, seed: int, n: int, by: str) -> DataFrame:
    """n rows of each group in the order of a seeded hash: the same ones in every run."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def expand_by_table(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``terms(query_id, term)`` with the members of every group that a term belongs to; ``groups(grp, member)`` is a table."""
    hit = terms.join(dimension(groups.withColumnRenamed("member", "term")), "term").select("query_id", "grp").distinct()
    more = hit.join(dimension(groups), "grp").select("query_id", F.col("member").alias("term"))
    return terms.select("query_id", "term").union(more).distinct()


def map_by_table(rows: DataFrame, key: str, text: Column, mapping: DataFrame) -> DataFrame:
    """(key, mapped): every token that ``mapping(src, dst)`` knows replaced, in order, the others untouched."""
    toks = rows.select(key, F.posexplode(T.words(text)).alias("pos", "w")).withColumn("src", F.lower("w"))
    done = toks.join(dimension(mapping.select("src", "dst")), "src", "left").withColumn("w", F.coalesce("dst", "w"))
    return done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x.w), " ").alias("mapped"))
