"""Shared pieces of the operators: written scratch tables, graph components, text keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset a temporary folder is chosen
    once for the session if the master is local (a single machine, as in tests); elsewhere no folder of this
    machine would be seen by the others, and an error says so."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables of one operator call, under a fresh folder in the shared folder.

    A written table cuts the lineage: a lost executor costs its running tasks, not the
    jobs before. ``drop`` deletes tables that no result still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{name}-{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for t in tables:
            if t is not None and getattr(t, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def text_key(text: Column) -> Column:
    """16-byte key of a whole text; nulls share a key of their own."""
    return F.when(text.isNull(), F.lit(b"null")).otherwise(F.unhex(F.md5(text)))


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch, within: str | None = None) -> DataFrame:
    """rows with ``pos``, gapless from 0 in the given order (of each value of the non-null column within, if named,
    by which the order must begin), and ``n``, how many rows the value has.

    Rows are range-partitioned and sorted, and their places in the partitions written; partitions' counts, one for each
    partition and value, give the offsets. Rows that are equal in order meet in one partition: end it with a
    column that tells them apart where there may be many.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [] if within is None else [within]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("__part", F.shiftright("__at", 33)), "placed")
    cells = placed.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    every = Window.partitionBy(*group)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("__n").over(every))
    done = placed.join(cells, [*group, "__part"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first"))
    return done.drop("__at", "__part", "__first", "__n", "__before")


def connected_components(spark: SparkSession, pairs: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``pairs(a, b)`` of longs -> ``(node, component)`` for the nodes in pairs; the component is
    its smallest node.

    Alternates large-star and small-star steps (every neighbour above a node moves to the
    node's smallest neighbour, then the reverse) until the pairs are stars: every round
    is two aggregations and two joins, and no group is ever gathered in one place.
    """
    edges = scratch.write(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    for _ in range(rounds):
        if _stars(edges):
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = scratch.write(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.write(small.where("a != b").union(low.select("a", "m")).distinct(), "edges")
        scratch.drop(edges, large)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, and none that is pointed to points on."""
    end = lambda v, up, at: F.struct(F.col(v).alias("v"), F.lit(up).alias("up"), F.lit(at).alias("at"))
    ends = edges.select(F.inline(F.array(end("a", 1, 0), end("b", 0, 1))))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("at").alias("at")).where("up > 0 and up + at > 1").count() == 0


#: A DuckDB table ``crc(t)``: one list, the checksum's 256 entries.
CRC_SQL = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB, where the table ``crc`` is joined."""
    each = f"list_transform(range(octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), (2 * j + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
