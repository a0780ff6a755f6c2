"""Schema profiling and role inference over tables of unknown columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Fixed values: (role, pattern of a column's name, weight).
ROLE_NAMES = [
    ("question", "^(question|query|prompt|text)$", 1.0), ("question", "question|query", 0.85), ("question", "title|subject", 0.55),
    ("answer", "^(answer|response|reply|html)$", 1.0), ("answer", "answer|response", 0.85), ("answer", "body|content", 0.55),
    ("category", "^(category|lang|role|topic)$", 1.0), ("category", "categ|topic", 0.85), ("category", "label|source", 0.55),
    ("date", "^(date|ts)$", 1.0), ("date", "date|time", 0.85), ("date", "year", 0.55),
    ("reference", "^(url|link|reference)$", 1.0), ("reference", "url|link", 0.85), ("reference", "_id$|^id$", 0.55),
]
NAME_SHARE, CONTENT_SHARE, ROLE_FLOOR = 0.65, 0.35, 0.25


def melt(df: DataFrame, order: str, name: str) -> DataFrame:
    """(table_name, column_name, ordinal, rank, value) of every cell, values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("ordinal"), F.col(c).cast("string").alias("value")) for k, c in enumerate(df.columns)])
    return df.select(F.lit(name).alias("table_name"), F.col(order).alias("row_key"), F.explode(cells).alias("x")).select("table_name", "row_key", "x.*")


def profile(cells: DataFrame, samples: int = 3) -> DataFrame:
    """Null share, distinct values and the first sample values of each column, by row key.

    Samples come from a bounded minimum over (row, value), not from a collected group."""
    blank = F.col("value").isNull() | (F.trim("value") == "")
    stats = cells.groupBy("table_name", "column_name").agg(F.round(F.avg(F.when(blank, 1.0).otherwise(0.0)), 4).alias("null_ratio"), F.countDistinct(F.when(~blank, F.col("value"))).alias("distinct_values"))
    firsts = cells.where(~blank).groupBy("table_name", "column_name", F.trim("value").alias("value")).agg(F.min("row_key").alias("row_key"))
    w = Window.partitionBy("table_name", "column_name").orderBy("row_key", "value")
    top = firsts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    shown = top.groupBy("table_name", "column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.substring("value", 1, 120).alias("v")))), lambda x: x.v), " | ").alias("samples"))
    return stats.join(shown, ["table_name", "column_name"], "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def sample_values(cells: DataFrame, n: int) -> DataFrame:
    """The first n non-blank values of each column by row key."""
    w = Window.partitionBy("table_name", "column_name").orderBy("row_key", "value")
    return cells.where(F.trim("value") != "").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def column_language(samples: DataFrame) -> DataFrame:
    """Script of a column from the share of its sample values that are mostly Arabic script."""
    own = F.avg(F.when(T.share_of(F.col("value"), T.ARABIC) >= 0.3, 1.0).otherwise(0.0))
    label = F.when(F.col("share") >= 0.7, "urdu").when(F.col("share") >= 0.2, "mixed").otherwise("latin")
    return samples.groupBy("table_name", "column_name").agg(own.alias("share")).select("table_name", "column_name", label.alias("language"))


def name_scores(columns: DataFrame) -> DataFrame:
    """Best weight of a role's name patterns for every column and role."""
    out = []
    for role in dict.fromkeys(r for r, _, _ in ROLE_NAMES):
        hits = [F.when(F.lower(F.trim("column_name")).rlike(p), w).otherwise(0.0) for r, p, w in ROLE_NAMES if r == role]
        out.append(F.struct(F.lit(role).alias("role"), F.greatest(*hits).alias("name_score")))
    return columns.select("*", F.explode(F.array(*out)).alias("x")).select(*columns.columns, "x.role", "x.name_score")


def content_scores(samples: DataFrame) -> DataFrame:
    """Fit of a column's sample values to each role, from script, length, addresses, dates and variety."""
    v, one = F.col("value"), lambda c: F.when(c, 1.0).otherwise(0.0)
    url, ident, date = v.rlike(r"^https?://|^www\."), v.rlike(r"^[A-Za-z0-9_\-./]+$"), v.rlike(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")
    s = samples.groupBy("table_name", "column_name").agg(
        F.avg(T.share_of(v, T.ARABIC)).alias("u"), F.avg(F.length(v)).alias("l"), F.avg(one(v.rlike("[?؟]\\s*$"))).alias("ask"), F.avg(one(url)).alias("url"), F.avg(one(url | ident)).alias("ident"), F.avg(one(date)).alias("date"), F.countDistinct("value").alias("uniq")
    )
    script, length = F.least(F.col("u") / 0.5, F.lit(1.0)), F.col("l")
    score = {
        "question": 0.4 * script + 0.3 * F.when(length.between(30, 400), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(length - 200) / 500)) + 0.3 * F.col("ask"),
        "answer": 0.5 * script + 0.5 * F.when(length >= 100, 1.0).otherwise(length / 100),
        "category": 0.5 * F.when(length <= 30, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (length - 30) / 100)) + 0.5 * F.when(F.col("uniq") <= 20, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("uniq") - 20) / 80)),
        "date": F.col("date") + 0.1,
        "reference": 0.6 * F.col("url") + 0.4 * F.col("ident"),
    }
    made = F.array(*[F.struct(F.lit(r).alias("role"), F.least(F.lit(1.0), c).cast("double").alias("content_score")) for r, c in score.items()])
    return s.select("table_name", "column_name", F.explode(made).alias("x")).select("table_name", "column_name", "x.role", "x.content_score")


def role_mapping(names: DataFrame, contents: DataFrame) -> DataFrame:
    """The best column of each role and table, if its confidence reaches the floor."""
    both = names.join(contents, ["table_name", "column_name", "role"], "left")
    conf = F.round(NAME_SHARE * F.col("name_score") + CONTENT_SHARE * F.coalesce("content_score", F.lit(0.0)), 4)
    w = Window.partitionBy("table_name", "role").orderBy(F.desc("confidence"), "ordinal")
    best = both.withColumn("confidence", conf).withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("table_name", "role", F.when(F.col("confidence") >= ROLE_FLOOR, F.col("column_name")).alias("column_name"), "confidence")


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal) of several tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, c, k) for t, df in tables.items() for k, c in enumerate(df.columns)], "table_name string, column_name string, ordinal int")


def summary(columns: DataFrame) -> DataFrame:
    """How many tables hold each column, whether all do, and how many ways its name is written."""
    n = columns.select("table_name").distinct().count()
    name = F.lower(F.trim("column_name"))
    return columns.groupBy(name.alias("column_key")).agg(F.countDistinct("table_name").alias("tables"), F.countDistinct("column_name").alias("spellings")).select("column_key", "tables", (F.col("tables") == n).alias("common"), (n - F.col("tables")).alias("missing_in"), "spellings")


def union_cells(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def integrity(docs: DataFrame, text: Column) -> DataFrame:
    """Counters of a corpus in one aggregation."""
    n = lambda c: F.count_if(c).alias
    return docs.agg(
        F.count("*").alias("records"), n(F.trim(F.coalesce(text, F.lit(""))) == "")("blank"), n(text.rlike("�"))("replacement_chars"), n(text.rlike("[\\x00-\\x08]"))("control_chars"),
        n(text.rlike(r"Ã.|â€"))("mojibake"), n(F.length(text) < 40)("short"), n(text.rlike("<[a-zA-Z/]"))("markup"), F.round(F.avg(F.size(T.words(text))), 4).alias("avg_words"), F.round(F.avg(T.share_of(text, "[A-Za-z]")), 4).alias("avg_latin"),
    )
