"""Sharding by balanced label propagation. DataFrame functions only.

Documents with equal texts are linked. Every document starts in a shard given by its id; the
linked ones then move, round by round, towards the shard that most of their neighbours are in,
as far as that shard's quota allows (quota: the rows that every shard gets). All documents of one
text and one starting cell (eight to a shard) share a label, so the rounds work on cells and not on
documents, and a text with a third of all rows is 320 cells, not one. Admission under a quota is
by running sums over hash buckets, never by a sort of all candidates. Documents without links
fill the shards up to counts that are at most one apart; linked ones beyond a shard's count join them.

Defined results: null texts are linked with each other and have size 16 and checksum 0; repeated
rows are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_key

SHARDS = 40
#: Hash buckets for admission; rows in a bucket that are ranked together.
ADMIT, RANKED = 1024, 500
#: Buckets whose totals are summed in one group.
BLOCK = 4096
#: Cells of a text for each shard that it starts in: what moves at once is this much finer than a shard's part of a hot text.
FINE = 8


def _spread(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def _ranked(rows: DataFrame, by: list[str], buckets: int, name: str) -> DataFrame:
    """rows with a gapless rank from 1 within the columns by, ranked in hash buckets and offset by their totals;
    the totals are summed in blocks of buckets, and those by their own totals, so no task sees all buckets."""
    rows = rows.withColumn("__b", F.pmod(_spread("h", "key"), F.lit(buckets)))
    upto = lambda order, *part: F.coalesce(F.sum("__n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n")).withColumn("__c", F.floor(F.col("__b") / BLOCK))
    blocks = totals.groupBy(*by, "__c").agg(F.sum("__n").alias("__n")).withColumn("__p", upto("__c", *by)).drop("__n")
    offsets = totals.withColumn("__o", upto("__b", *by, "__c")).join(blocks, [*by, "__c"]).withColumn("__o", F.col("__o") + F.col("__p")).drop("__n", "__c", "__p")
    own = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("h", "key"))
    return rows.withColumn("__r", own).join(offsets, [*by, "__b"]).withColumn(name, F.col("__r") + F.col("__o")).drop("__b", "__r", "__o")


def propagate(cells: DataFrame, shards: int, quota: int, scratch: Scratch) -> DataFrame:
    """``cells(key, s0, n)`` of linked documents -> ``(key, s0, n, cur)`` when no cell moves any more.

    A cell moves only to a shard that holds as much of its text or more, so the sum of the squares of what
    texts have in shards grows with every move, and the rounds end."""
    state = scratch.write(cells.withColumn("cur", F.pmod("s0", F.lit(shards))), "labels")
    for k in itertools.count():
        load = {r.cur: r.load for r in state.groupBy("cur").agg(F.sum("n").alias("load")).collect()}  # a row for each shard
        room = {s: quota - load.get(s, 0) for s in load}
        if not load:
            break
        rooms = F.create_map(*itertools.chain.from_iterable((F.lit(int(s)), F.lit(int(v))) for s, v in sorted(room.items())))
        here = state.groupBy("key", "cur").agg(F.sum("n").alias("here"), F.max("n").alias("cell"))
        rank = F.struct("here", _spread("key", "cur"))
        fits = rooms[F.col("cur")] >= F.col("cell")
        best = here.groupBy("key").agg(F.max(F.when(fits, F.struct(rank.alias("rank"), F.col("cur").alias("to")))).alias("x"), F.max("cell").alias("cell"))
        best = best.where(F.col("x").isNotNull()).select("key", F.col("x.rank").alias("best"), F.col("x.to").alias("to"))
        wish = here.select("key", "cur", rank.alias("rank")).join(best, "key").where((F.col("cur") != F.col("to")) & (F.col("rank") < F.col("best"))).select("key", "cur", "to")
        wishes = state.join(wish, ["key", "cur"], "left").withColumn("b", F.pmod(_spread("key", "s0", F.lit(k)), F.lit(ADMIT)))
        sums = wishes.where("to is not null").groupBy("to", "b").agg(F.sum("n").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("to").orderBy("b"))
        admit = sums.withColumn("upto", upto).where(F.col("upto") <= rooms[F.col("to")]).select("to", "b", F.lit(True).alias("go"))  # ADMIT rows a shard
        moved = wishes.join(F.broadcast(admit), ["to", "b"], "left")
        new = scratch.write(moved.select("key", "s0", "n", F.when(F.col("go"), F.col("to")).otherwise(F.col("cur")).cast("int").alias("cur"), F.coalesce("go", F.lit(False)).alias("went")), "labels")
        scratch.drop(state)
        state = new
        if state.where("went").isEmpty():
            break
    return state.select("key", "s0", "n", "cur")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = SHARDS) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of every row: counts of shards at most one apart, slots gapless from 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(text).alias("key"),
    )
    # rows without an id are told apart by their place in this written table
    base = base.withColumn("h", F.when(F.col("id").isNull(), _spread(F.monotonically_increasing_id())).otherwise(_spread("id")))
    base = scratch.write(base.withColumn("s0", F.pmod("h", F.lit(shards * FINE)).cast("int")), "rows")
    total = base.count()
    if not total:
        return base.select("id", "size", "text_crc32", F.col("s0").alias("shard"), F.lit(0).cast("long").alias("slot"))
    quota, extra = divmod(total, shards)
    cells = base.groupBy("key", "s0").agg(F.count("*").alias("n"))
    linked = cells.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    labels = propagate(cells.join(linked, "key"), shards, quota, scratch).select("key", "s0", "cur")
    placed = base.join(labels, ["key", "s0"], "left")
    room = F.lit(quota) + F.when(F.col("cur") < extra, 1).otherwise(0)
    per_shard = max(1, -(-total // (shards * RANKED)))
    held = _ranked(placed.where("cur is not null"), ["cur"], per_shard, "rank").withColumn("stays", F.col("rank") <= room)
    held = scratch.write(held, "linked")
    kept = {r.cur: r.n for r in held.where("stays").groupBy("cur").agg(F.count("*").alias("n")).collect()}
    free = [quota + (s < extra) - kept.get(s, 0) for s in range(shards)]
    ends = list(itertools.accumulate(free))
    columns = ["id", "size", "text_crc32", "key", "h"]
    pool = placed.where("cur is null").select(*columns).unionByName(held.where("not stays").select(*columns))
    pool = _ranked(pool.withColumn("all", F.lit(0)), ["all"], per_shard * shards, "rank")
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    to = F.size(F.filter(bounds, lambda e: e < F.col("rank")))  # the first shard whose places reach this rank
    starts = F.array(*[F.lit(e - f).cast("long") for e, f in zip(ends, free)])
    held_n = F.array(*[F.lit(kept.get(s, 0)).cast("long") for s in range(shards)])
    pool = pool.withColumn("shard", to).withColumn("slot", F.get(held_n, F.col("shard")) + F.col("rank") - F.get(starts, F.col("shard")) - 1)
    fixed = held.where("stays").withColumn("shard", F.col("cur")).withColumn("slot", F.col("rank") - 1)
    columns = ["id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot")]
    return fixed.select(*columns).unionByName(pool.select(*columns))


def assigned(docs: DataFrame, **how) -> DataFrame:
    done = shard(docs, **how)
    return done.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
