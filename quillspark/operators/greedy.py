"""Greedy batches of rows in order, by count and by size, as a loop over all rows would cut them, without one.

Where a batch that starts at a row ends depends on the rows after it only, at most ``most`` of them. Rows are cut into blocks longer than a batch;
a block, with the first rows of the next one, gives every row the place where a batch from it ends. Within a block these pointers are followed to its end, so a
block becomes a small table: from each place where a batch may enter it (the first ``most``) to the place where the next block is entered. Those tables are
joined with themselves, so that pointers reach twice as far each round, and after log2(blocks) rounds every block knows where it is
entered. No task sees more than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import written
from .ranks import ranked

#: Rows of a block, for each of the rows that a batch may have, at least.
BLOCKS = 8


def ends(rows: DataFrame, size_col: str, most: int, limit: int, block: int) -> DataFrame:
    """rows(pos, ...) with ``block`` and ``next``: where the batch that starts at a row ends, at least one row on."""
    own = rows.withColumn("block", F.floor(F.col("pos") / block)).withColumn("halo", F.lit(False))
    # the first rows of a block stand at the end of the one before, too
    ahead = own.where((F.col("pos") % block < most) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1).withColumn("halo", F.lit(True))
    both = own.unionByName(ahead)
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    both = both.withColumn("end", F.sum(size).over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    # rows by where they end and questions by how far they may reach, in one order: the last row before a question fits
    event = lambda at, tag: F.struct(at.alias("at"), F.lit(tag).alias("tag"))
    asked = both.withColumn("e", F.explode(F.array(event(F.col("end"), 0), event(F.col("end") - size + limit, 1))))
    upto = Window.partitionBy("block").orderBy("e.at", "e.tag").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("last", F.max(F.when(F.col("e.tag") == 0, F.col("pos"))).over(upto))
    found = asked.where((F.col("e.tag") == 1) & ~F.col("halo"))
    reach = F.least(F.coalesce("last", F.col("pos")) + 1, F.col("pos") + most)
    return found.withColumn("next", F.greatest(reach, F.col("pos") + 1)).drop("e", "last", "halo", "end")


def entries(pointers: DataFrame, block: int, most: int) -> DataFrame:
    """``(at, to)``: from a place among the first ``most`` of a block to the place where its batches enter the next one."""

    def follow(part: pa.Table) -> pa.Table:
        pos, to = part["pos"].to_numpy(), part["next"].to_numpy()
        order = np.argsort(pos)
        pos, to = pos[order], to[order].copy()
        end = (pos[0] // block + 1) * block
        for k in range(len(pos) - 1, -1, -1):
            if to[k] < end and to[k] - pos[0] < len(pos):
                to[k] = to[to[k] - pos[0]]
        first = pos % block < most
        return pa.table({"at": pos[first], "to": to[first]})

    return pointers.select("block", "pos", "next").groupBy("block").applyInArrow(follow, "at long, to long")


def entered(steps: DataFrame, block: int, n_blocks: int) -> DataFrame:
    """``(block, at)``: where the batches from row 0 on enter every block, by pointers that reach twice as far each round."""
    reached = written(steps.sparkSession.range(1).select(F.lit(0).cast("long").alias("at")), "reached")
    far = 1
    while far < n_blocks:
        more = steps.join(reached, "at").select(F.col("to").alias("at"))
        reached = written(reached.union(more).distinct(), "reached")
        far *= 2
        if far < n_blocks:
            then = steps.select(F.col("at").alias("to"), F.col("to").alias("then"))
            steps = written(steps.join(then, "to").select("at", F.col("then").alias("to")), "steps")
    return reached.select(F.floor(F.col("at") / block).alias("block"), "at")


def batches(rows: DataFrame, order: list[Column], size_col: str, *, most: int, limit: int, out: str = "batch_id") -> DataFrame:
    """rows with ``batch_id`` from 0 in the given order: a batch takes the next row as long as it then has at most ``most`` rows and sizes of at most
    ``limit`` together; a row of more is a batch alone. A null size is 0; rows that are equal in order follow each other as they come."""
    placed = written(ranked(rows, order).drop("n"), "placed")
    total = placed.count()
    if not total:
        return placed.withColumn(out, F.lit(0).cast("long")).drop("pos")
    block = BLOCKS * max(most, 64)
    pointers = written(ends(placed, size_col, most, limit, block), "pointers")
    steps = written(entries(pointers, block, most).where(F.col("to") < total), "steps")  # the last block enters none
    at = entered(steps, block, -(-total // block))

    def cut(key, part: pa.Table, first: pa.Table) -> pa.Table:
        """A mark at every row of the block that starts a batch."""
        order_ = np.argsort(part["pos"].to_numpy())
        pos, to = part["pos"].to_numpy()[order_], part["next"].to_numpy()[order_]
        starts, here = np.zeros(len(pos), np.int64), first["at"].to_numpy()
        k = int(here[0] - pos[0]) if len(here) else len(pos)
        while k < len(pos):
            starts[k] = 1
            k = int(to[k] - pos[0])
        return pa.table({"block": np.full(len(pos), key[0].as_py()), "pos": pos, "nth": np.cumsum(starts), "starts": np.full(len(pos), starts.sum())})

    marked = written(pointers.select("block", "pos", "next").groupBy("block").cogroup(at.groupBy("block")).applyInArrow(cut, "block long, pos long, nth long, starts long"), "marked")
    # a block's first number: blocks' counts are summed in groups of blocks, and those by their own sums
    counts = marked.groupBy("block").agg(F.first("starts").alias("c")).withColumn("g", F.floor(F.col("block") / 4096))
    before = lambda over, by: F.coalesce(F.sum("c").over(over.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("g").agg(F.sum("c").alias("c")).withColumn("gb", before(Window.partitionBy(), "g")).drop("c")
    counts = counts.withColumn("b", before(Window.partitionBy("g"), "block")).join(groups, "g").select("block", (F.col("b") + F.col("gb")).alias("before"))
    numbered = marked.join(counts, "block").select("pos", (F.col("before") + F.col("nth") - 1).alias(out))
    return placed.join(numbered, "pos").drop("pos")
