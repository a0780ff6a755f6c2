"""Places in one order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import written


def ranked(rows: DataFrame, order: list[Column], within: str | None = None) -> DataFrame:
    """rows with ``pos``, gapless from 0 in the given order (of each value of the non-null column within, if named,
    by which the order must begin), and ``n``, how many rows the value has.

    Rows are range-partitioned, sorted and written with their places in the partitions; the partitions' counts
    give the offsets. End the order with a column that tells equal rows apart where there may be many."""
    parts, group = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [] if within is None else [within]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__part", F.shiftright("__at", 33)), "placed")
    cells = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    every = Window.partitionBy(*group)
    before = F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("__n").over(every))
    done = placed.join(cells, [*group, "__part"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first"))
    return done.drop("__at", "__part", "__first", "__n", "__before")
