"""A training-data pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage works on all rows that the one before it kept and returns the columns of documents;
the last returns the shard of every remaining row. Nulls in any column, blank and very long
texts, repeated rows, empty tables and extra columns are allowed: see the operators' own
docstrings for what becomes of them. A document repeated by the mixture is sharded as often as
it occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, langid, mixing, sharding, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model accepts go: null texts, texts without a letter, noise."""
    model = langid.train(docs, "text", "lang", "doc_id", F.lit(True))
    done = langid.identify(docs, model, prefix="__lang_")
    return done.where(~F.col("__lang_rejected")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is a benchmark item at similarity 0.8 or more go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped target of their source has them."""
    return mixing.repeat_mixed(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=42)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot."""
    return sharding.assigned(docs)


#: (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Language models, fingerprints and components have no SQL form; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
