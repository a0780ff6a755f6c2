"""Impact index: what each term adds to a document's score, fixed when the index is built, in blocks with their maxima.

Four tables: blocks of postings, one term and one level of impact each; levels of each term with their largest impact and their postings;
terms; documents with all their terms. A search scores a few documents of each query's strongest terms in whole: the k-th of these scores is a
floor. Part of the floor may be left unread: terms are skipped, those first that save most postings for what they could add,
which are the common ones, as long as what all of them could add stays under that part; of the last one its low levels. What was read of a document,
and the most of what was not, bound its score; documents whose bound reaches the floor are scored in whole from their own terms. No
document of the k best is lost, so results equal those of scoring every posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, EngineConfig
from ..sources.sinks import read_or_none, written
from . import lexical as L
from .sizes import checked_broadcast

#: Levels of impacts, and postings of a block at most.
LEVELS, BLOCK = 16, 128
#: Postings read first and documents then scored in whole, for each of the k asked for.
POSTINGS_FIRST, DOCS_FIRST = 400, 8
#: Part of the floor that what is left unread may add.
UNREAD = 0.5
#: Scores are sums of doubles in any order, rounded to 6 digits: a bound this much under the floor may still reach it.
SLACK = 2e-6


@dataclass(frozen=True)
class Impacts:
    """``blocks(term, level, docs, impacts)``, ``levels(term, level, top, n)``, ``terms(term, df, top, idf)``, ``forward(doc_id, terms, impacts)``."""

    blocks: DataFrame
    levels: DataFrame
    terms: DataFrame
    forward: DataFrame


TABLES = {"blocks": {"term", "level", "docs", "impacts"}, "levels": {"term", "level", "top", "n"}, "terms": {"term", "df", "top", "idf"}, "forward": {"doc_id", "terms", "impacts"}}


def _inverted(avg_dl: float | None, cfg: EngineConfig):
    """Blocks of a batch of documents: its postings by term and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2).flatten().dictionary_encode()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            tf, dl = batch.column(3).flatten().to_numpy(), batch.column(1).to_numpy()[row]
            impact = tf / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl / avg_dl))
            key = words.indices.to_numpy().astype(np.int64) * LEVELS + np.minimum(LEVELS - 1, LEVELS * impact).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, row, impact = key[order], row[order], impact[order]
            # a block ends with its term and level, or when it is full
            place = np.arange(len(key)) - np.searchsorted(key, key)
            first = np.flatnonzero(place % BLOCK == 0)
            at = pa.array(np.concatenate([first, [len(key)]]), pa.int32())
            docs, impacts = (pa.ListArray.from_arrays(at, x) for x in (batch.column(0).take(pa.array(row)), pa.array(impact)))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key[first] // LEVELS)), pa.array((key[first] % LEVELS).astype(np.int32)), docs, impacts], names=["term", "level", "docs", "impacts"])

    return run


def build(index: L.Postings, cfg: EngineConfig = DEFAULT) -> Impacts:
    """Impacts of a lexical index's postings, but for their term's weight, which ``terms`` holds once as ``idf``. Blocks are made of documents where they
    are and documents keep their terms, so postings are not shuffled, only the levels' counts and maxima of each task."""
    kind, avg_dl = dict(index.docs.dtypes)["doc_id"], index.stats.first()["avg_dl"]
    rows = index.docs.select("doc_id", "dl", "terms", "tfs")
    blocks = written(rows.mapInArrow(_inverted(avg_dl, cfg), f"term string, level int, docs array<{kind}>, impacts array<double>"), "blocks")
    levels = written(blocks.groupBy("term", "level").agg(F.max(F.array_max("impacts")).alias("top"), F.sum(F.size("docs")).alias("n")), "levels")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = levels.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")).crossJoin(F.broadcast(index.stats))  # one row
    impacts = F.transform("tfs", lambda tf: tf / (tf + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.lit(avg_dl))))
    return Impacts(blocks, levels, terms.select("term", "df", "top", idf.alias("idf")), index.docs.select("doc_id", "terms", impacts.alias("impacts")))


def save(index: Impacts, path: str) -> None:
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Impacts | None:
    """None if a table is missing or of an older form."""
    found = [read_or_none(spark, f"{path}/{t}", columns) for t, columns in TABLES.items()]
    return None if any(f is None for f in found) else Impacts(*found)


def query_terms(index: Impacts, queries: DataFrame, query_id: str, query_text: Column) -> DataFrame:
    """``(query_id, term, qn, df, most)``: terms that the index has, with what an impact counts for the query, and the most that each may add."""
    terms = L.term_rows(queries, query_id, query_text).groupBy(F.col(query_id).alias("query_id"), "term").agg(F.count("*").alias("qn"))
    terms = written(terms, "asked")
    return written(index.terms.join(checked_broadcast(terms), "term").select("query_id", "term", (F.col("qn") * F.col("idf")).alias("qn"), "df", (F.col("qn") * F.col("idf") * F.col("top")).alias("most")), "terms")


def whole_scores(index: Impacts, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score, read)`` of pairs(query_id, doc_id), from the documents' own terms."""
    rows = index.forward.join(checked_broadcast(pairs), "doc_id").select("query_id", "doc_id", F.explode(F.arrays_zip("terms", "impacts")).alias("p"))
    rows = rows.select("query_id", "doc_id", F.col("p.terms").alias("term"), F.col("p.impacts").alias("impact"))
    hit = rows.join(checked_broadcast(terms.select("query_id", "term", "qn")), ["query_id", "term"])
    return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qn") * F.col("impact")), 6).alias("score"), F.count("*").alias("read"))


def read_blocks(index: Impacts, terms: DataFrame) -> DataFrame:
    """``(query_id, doc_id, qn, impact, unread)`` of the blocks above the skipped level of terms(query_id, term, qn, skipped, unread)."""
    hit = index.blocks.join(checked_broadcast(terms.select("query_id", "term", "qn", "skipped", "unread")), "term").where(F.col("level") > F.col("skipped"))
    rows = hit.select("query_id", "qn", "unread", F.explode(F.arrays_zip("docs", "impacts")).alias("p"))
    return rows.select("query_id", F.col("p.docs").alias("doc_id"), "qn", F.col("p.impacts").alias("impact"), "unread")


def skipped_levels(index: Impacts, terms: DataFrame, floor: DataFrame) -> DataFrame:
    """terms with ``skipped``, the level up to which a term is not read (-1: none), and ``unread``, the most that it may add there.

    Terms are skipped whole in the order of postings saved for what they may add, until UNREAD of the floor is spent; of the term that no longer
    fits, the levels that do."""
    saving = Window.partitionBy("query_id").orderBy(F.desc(F.col("df") / F.col("most")), "term")
    t = terms.join(checked_broadcast(floor), "query_id", "left").withColumn("upto", F.sum("most").over(saving))
    t = t.withColumn("left", F.coalesce(F.col("floor") * UNREAD - SLACK - (F.col("upto") - F.col("most")), F.lit(0.0))).where("left > 0")
    fits = index.levels.join(checked_broadcast(t.select("query_id", "term", "qn", "left")), "term").where(F.col("qn") * F.col("top") <= F.col("left"))
    fits = fits.groupBy("query_id", "term").agg(F.max("level").alias("skipped"), F.max("top").alias("unread"))
    return terms.join(checked_broadcast(fits), ["query_id", "term"], "left").select("query_id", "term", "qn", F.coalesce("skipped", F.lit(-1)).alias("skipped"), F.coalesce("unread", F.lit(0.0)).alias("unread"))


def work(index: Impacts, queries: DataFrame, query_id: str, query_text: Column) -> DataFrame:
    """``(query_id, postings)``: all postings of each query's terms, without a search."""
    return query_terms(index, queries, query_id, query_text).groupBy("query_id").agg(F.sum("df").alias("postings"))


def search(index: Impacts, queries: DataFrame, query_id: str, query_text: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """``(query_id, doc_id, score, rank)``, the k best of every query, and ``(query_id, postings, postings_read)``: all postings of its
    terms, and the postings that were read, those of whole documents included."""
    terms = query_terms(index, queries, query_id, query_text)
    strongest = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    first = terms.withColumn("upto", F.sum("df").over(strongest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(strongest))
    first = first.where((F.col("upto") <= POSTINGS_FIRST * k) | (F.col("r") == 1)).select("query_id", "term", "qn", F.lit(-1).alias("skipped"), F.lit(0.0).alias("unread"))
    early = read_blocks(index, written(first, "first")).groupBy("query_id", "doc_id").agg(F.sum(F.col("qn") * F.col("impact")).alias("part"), F.count("*").alias("read"))
    early = written(early, "early")
    best = written(L.top(early, DOCS_FIRST * k, score="part").select("query_id", "doc_id"), "best")
    whole = written(whole_scores(index, terms, best), "whole")
    floor = L.top(whole, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    floor = written(floor, "floor")
    chosen = written(skipped_levels(index, terms, floor), "levels")
    # what was read, and the most of what was not, bound a document's score
    base = chosen.groupBy("query_id").agg(F.sum(F.col("qn") * F.col("unread")).alias("base"))
    met = read_blocks(index, chosen).groupBy("query_id", "doc_id").agg(F.sum(F.col("qn") * (F.col("impact") - F.col("unread"))).alias("more"), F.count("*").alias("read"))
    met = written(met, "met")
    ends = checked_broadcast(written(base.join(floor, "query_id", "left"), "ends"))
    able = met.join(ends, "query_id").where(F.col("floor").isNull() | (F.col("base") + F.col("more") >= F.col("floor") - SLACK)).select("query_id", "doc_id")
    able = written(able.join(checked_broadcast(best.withColumn("seen", F.lit(True))), ["query_id", "doc_id"], "left").where("seen is null").drop("seen"), "able")
    late = written(whole_scores(index, terms, able), "late")
    every = whole.unionByName(late)
    found = L.top(every.where("score > 0").select("query_id", "doc_id", "score"), k)
    read = early.select("query_id", "read").union(met.select("query_id", "read")).union(every.select("query_id", "read")).groupBy("query_id").agg(F.sum("read").alias("postings_read"))
    work = terms.groupBy("query_id").agg(F.sum("df").alias("postings")).join(read, "query_id", "left")
    return found, work.select("query_id", "postings", F.coalesce("postings_read", F.lit(0)).alias("postings_read"))
