"""Records: typed schema, stable ids, projections, filters, batches, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def unified(docs: DataFrame) -> DataFrame:
    """Question/answer records of a document table: first sentence and rest, language as category, source as folder."""
    blank = lambda c: F.when(F.lower(F.trim(c)).isin("nan", "none"), "").otherwise(F.coalesce(F.trim(c), F.lit("")))
    r = docs.select("doc_id", T.question_of(F.col("text")).alias("question"), T.answer_of(F.col("text")).alias("answer"), blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("folder"))
    category = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.col("folder"))
    ident = T.stable_id(F.col("folder"), F.col("doc_id").cast("string"), F.substring("question", 1, 40))
    return r.where("not (question = '' and answer = '')").select(
        ident.alias("id"), "doc_id", "question", "answer", category.alias("category"), "folder",
        F.concat(F.lit("Q: "), "question", F.lit(" A: "), "answer").alias("text"),
    )


def embedding_text(question: Column, answer: Column) -> Column:
    return F.when(question != "", question).otherwise(F.substring(answer, 1, 1500))


def index_text(question: Column, answer: Column) -> Column:
    return F.concat_ws("\n", F.nullif(question, F.lit("")), F.nullif(answer, F.lit("")))


def metadata(records: DataFrame, limit: int = 2000) -> DataFrame:
    """The stored projection: long fields cut, nulls to blanks, defaults filled in."""
    cut = lambda c: F.coalesce(F.substring(c, 1, limit), F.lit(""))
    return records.select("id", cut("question").alias("question"), cut("answer").alias("answer"), F.coalesce(F.nullif("category", F.lit("")), F.lit("GENERAL")).alias("category"), F.coalesce("folder", F.lit("")).alias("folder"))


def batches(records: DataFrame, order: str, size: int) -> DataFrame:
    """A batch number for every row, in order; blocks of the order column are numbered first, so no task sorts all rows."""
    block = F.floor(F.col(order) / 10_000)
    totals = records.groupBy(block.alias("__k")).agg(F.count("*").alias("__n"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__k").orderBy(order))
    numbered = records.withColumn("__k", block).withColumn("__r", own).join(totals, "__k")
    return numbered.withColumn("batch_id", F.floor((F.col("__r") + F.col("__before") - 1) / size).cast("long")).drop("__k", "__r", "__n", "__before")


def pending(records: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Records that a checkpoint does not hold yet."""
    return records.join(done.select(key), key, "left_anti")


def coverage(expected: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """One row: expected, indexed, missing, percentage, and completeness at 99.9."""
    both = expected.select(key).distinct().join(indexed.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    out = both.agg(F.count("*").alias("expected"), F.count("__in").alias("indexed"))
    percent = F.when(F.col("expected") > 0, F.round(100.0 * F.col("indexed") / F.col("expected"), 2)).otherwise(100.0)
    return out.select("expected", "indexed", (F.col("expected") - F.col("indexed")).alias("missing"), percent.alias("percent"), (percent >= 99.9).alias("complete"))


def upsert(new: DataFrame, existing: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row of counters)."""
    rows = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return rows, new.join(existing.select(key).distinct().withColumn("__in", F.lit(1)), key, "left").agg(
        F.countDistinct(F.when(F.col("__in").isNull(), F.col(key))).alias("upserted"), F.count_if(F.col("__in").isNotNull()).alias("skipped"), F.count("*").alias("total")
    )


def keep_first(rows: DataFrame, key: Column, order: list, by: list[str] | None = None) -> DataFrame:
    """The first row of each key in order; rows with an empty key all stay."""
    w = Window.partitionBy(*(by or []), key).orderBy(*order)
    ranked = rows.withColumn("__key", key).withColumn("__rank", F.row_number().over(w))
    return ranked.where((F.col("__rank") == 1) | (F.col("__key") == "")).drop("__key", "__rank")


def target_text(query: Column, question: Column) -> Column:
    """What is embedded: query and question on two lines if both are there and differ, else the one that is."""
    q = F.coalesce(query, F.lit(""))
    return F.when((q == "") | (q == question), question).when(question == "", q).otherwise(F.concat_ws("\n", q, question))


def drop_unknown(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """Mapped columns that the files have: ``mapping(table_name, role, column_name)`` cut to ``headers(table_name, column_name)``."""
    return mapping.join(headers.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_semi")


def resolve_mapping(inferred: DataFrame, given: DataFrame) -> DataFrame:
    """A given column for a table's role wins over the inferred one; ``given`` is keyed by the whole table name."""
    over = given.select("table_name", "role", F.col("column_name").alias("__given"))
    return inferred.join(over, ["table_name", "role"], "left").withColumn("column_name", F.coalesce("__given", "column_name")).drop("__given")
