"""Markdown of any size as sections: headings outside fences, each with its body.

Files are read by splits, so a file may be larger than a task. Within a split, lines keep the reader's order; what a split needs of those before it, whether it
starts inside a fence, its first line number and the heading that its first lines belong to, is carried over from one row for each split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import written

HEADING, FENCE = r"^(#{1,6})\s+(.+)$", r"^\s*```"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(id, block, at, text)``: file, split by its first byte, place in the order of reading, line. Written, since the order is the reader's."""
    rows = spark.read.text(path, lineSep="\n")
    return written(rows.select(F.col("_metadata.file_path").alias("id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")), "lines")


def marked(lines: DataFrame) -> DataFrame:
    """lines(id, block, at, text) with ``line`` (from 1), ``level`` and ``title`` of headings (null elsewhere), and ``head``: the line of the last
    heading up to here, null before the first. A heading begins its line with up to six ``#`` and stands outside fences."""
    inside = Window.partitionBy("id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fence = F.when(F.col("text").rlike(FENCE), 1).otherwise(0)
    rows = lines.withColumn("fence", fence).withColumn("fences", F.sum("fence").over(inside)).withColumn("nth", F.row_number().over(Window.partitionBy("id", "block").orderBy("at")))
    # a row for each split
    splits = rows.groupBy("id", "block").agg(F.sum("fence").alias("f"), F.count("*").alias("n"))
    splits = splits.select("id", "block", F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("open"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = rows.join(splits, ["id", "block"]).withColumn("line", F.col("before") + F.col("nth"))
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    head = (F.pmod(F.col("open") + F.col("fences"), F.lit(2)) == 0) & (F.col("fence") == 0) & F.startswith("text", F.lit("#")) & stripped.rlike(HEADING)
    rows = rows.withColumn("level", F.when(head, F.length(F.regexp_extract(stripped, HEADING, 1)))).withColumn("title", F.when(head, F.trim(F.regexp_extract(stripped, HEADING, 2))))
    rows = rows.withColumn("own", F.max(F.when(F.col("level").isNotNull(), F.col("line"))).over(inside))
    last = rows.groupBy("id", "block").agg(F.max("own").alias("last"))
    last = last.select("id", "block", F.max("last").over(earlier).alias("carried"))
    return rows.join(last, ["id", "block"]).select("id", "block", "at", "text", "line", "level", "title", F.coalesce("own", "carried").alias("head"))


def sections(lines: DataFrame) -> DataFrame:
    """``(id, line, level, title, parent, body)`` of every heading: the line of the nearest heading above of a lower level, and its lines up to the next
    heading, its own included, without blanks around. Text before the first heading belongs to none."""
    rows = written(marked(lines), "marked")
    heads = rows.where("level is not null").select("id", "line", "level", "title")
    up = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("parent", F.greatest(*[F.when(F.lit(k) < F.col("level"), F.max(F.when(F.col("level") == k, F.col("line"))).over(up)) for k in range(1, 6)]))
    parts = rows.where("head is not null").groupBy("id", F.col("head").alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("l"), "text"))).alias("p"))  # a section's lines
    body = F.regexp_replace(F.array_join(F.transform("p", lambda x: x.text), "\n"), r"(?U)^\s+|\s+\z", "")
    return heads.join(parts.select("id", "line", body.alias("body")), ["id", "line"])
