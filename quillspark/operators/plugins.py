"""Embedding, reranking and generation as plug-ins, with deterministic defaults."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def __call__(self, context: DataFrame) -> DataFrame: ...


def hashed_embedding(text: Column, dims: int = 64, seed: int = 7) -> Column:
    """Unit-length signed sums of hashed words: every word is hashed once, then the signs are summed by place; without the signs where all
    of them cancel out."""
    place = lambda w: F.pmod(F.xxhash64(w, F.lit(seed)), F.lit(dims))
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(seed + 1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    hashed = F.transform(T.tokens(text), lambda w: F.struct(place(w).alias("p"), sign(w).alias("s")))
    sums = lambda ws, one=lambda w: w.s: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(ws, lambda w: w.p == k), F.lit(0.0), lambda s, w: s + one(w)))
    signed = lambda ws: F.aggregate(F.array(sums(ws)), F.array().cast("array<double>"), lambda _, v: F.when(F.exists(v, lambda x: x != 0), v).otherwise(sums(ws, lambda w: F.lit(1.0))))
    # an aggregate over one element binds a name, so that hashes and sums are made once
    raw = F.aggregate(F.array(hashed), F.array().cast("array<double>"), lambda _, ws: signed(ws))
    unit = lambda v: F.aggregate(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y))), v, lambda _, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return F.aggregate(F.array(raw), F.array().cast("array<double>"), lambda _, v: unit(v))


def overlap_mark(query: Column, text: Column) -> Column:
    """Relevance in 0..1 by shared words: the default reranker."""
    q, t = F.array_distinct(T.tokens(query)), F.array_distinct(T.tokens(text))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6)).otherwise(0.0)


def embed_unique(docs: DataFrame, text_col: str, embedder: Embedder = hashed_embedding) -> DataFrame:
    """docs with ``embedding``: every distinct text embedded once and joined back by 128 bits of its hash; a null text has none."""
    key = F.unhex(F.md5(F.col(text_col)))
    unique = docs.where(F.col(text_col).isNotNull()).select(key.alias("__k"), F.col(text_col).alias("__t")).groupBy("__k").agg(F.first("__t").alias("__t"))
    unique = unique.select("__k", embedder(F.col("__t")).alias("embedding"))
    return docs.withColumn("__k", key).join(unique, "__k", "left").drop("__k")
