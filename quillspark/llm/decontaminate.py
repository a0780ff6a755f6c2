"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Plan: one pass hashes the word shingles of every whole text in the row and looks each up among the
items' shingles; a maximal run of hits that follow each other in text and item proposes three
windows as many words long as the item: the one that aligns with the item, the one that begins with the run
and the one that ends with it. While a window slides, shared shingles enter on its right and leave on its left one at a
time, so their number has a maximum where a run begins at its left or ends at its right edge: the best
window of a document is among those proposed, whatever was inserted or left out. Only places leave the
scan; the texts with hits are read once more for the shingles of their windows. Windows are fingerprinted; an
index of the items' fingerprints in 8 blocks of 8 bits, each with all values up to RADIUS // 8
flips, yields every item of that size within RADIUS bits (if two words differ in at most RADIUS
bits, one of 8 blocks differs in at most RADIUS // 8). Candidates are decided by the exact
similarity of shingle multisets.

Defined results: words are runs without ASCII white space, lower-cased; an item of fewer words than a
shingle is one shingle of all its words; null or blank items match nothing, null or blank texts
match nothing; a text shorter than the item is compared as a whole; repeated rows and items each
give their own match; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Scratch

WORDS, SIMILARITY = 5, 0.8
#: Bits of 64. Multisets of similarity 0.8 differ in 9.7 on average with a deviation of 2.9: 3.6 deviations.
RADIUS = 20
BLOCKS = 8
#: Rows of item shingles up to which the items are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")


def shingle_array(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles in order; empty for fewer words (or null)."""
    n = F.size(words)
    made = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + x) for x in range(k)]))
    return F.when(n >= k, made).otherwise(F.array().cast("array<bigint>"))


def simhash_of(hashes: Column) -> Column:
    """64-bit majority word of an array of longs."""
    n = F.size(hashes)

    def bit(b: int) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.shiftright(h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(votes * 2 > n, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, 64):
        out = out.bitwiseOR(bit(b))
    return out


def block_value(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255).cast("long"))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller multiplicities over the sum of the larger ones."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x))))
    return both / (F.size(a) + F.size(b) - both)


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, item, start, n_words, similarity)``: the best window of each document for each item it
    holds at the similarity or more; start is the window's first word."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = bench.select(F.col(item_col).alias("item"), word_array(F.col(item_text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    items = items.withColumn("k", F.least("n", F.lit(words)))
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most as many values as a shingle has words
    found = None
    for k in sizes:
        own = items.where(F.col("k") == k).select("item", "n", shingle_array(F.col("w"), k).alias("ih"))
        own = scratch.write(own.withColumn("m", F.size("ih")).withColumn("ifp", simhash_of(F.col("ih"))), "items")
        posted = own.select("n", "m", F.posexplode("ih").alias("j", "hash"), "ih").select("n", "m", "j", "hash", F.get("ih", F.col("j") - 1).alias("before"), F.get("ih", F.col("j") + 1).alias("after")).distinct()
        # rows that repeat an id may differ in text: a hash of the text is part of the key
        keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("t"))
        shingled = lambda rows, *cols: rows.select("id", "tk", *cols, word_array(F.col("t")).alias("w")).select("id", "tk", *cols, shingle_array(F.col("w"), k).alias("h"))  # noqa: B023, E731
        place = F.transform("h", lambda x, i: F.struct(i.alias("pos"), x.alias("hash"), F.get("h", i - 1).alias("prev"), F.get("h", i + 1).alias("next")))
        placed = shingled(keyed).select("id", "tk", F.size("h").alias("size"), place.alias("places"))
        # outer: else a filter on the array is pushed below it, where the words would be split again for every shingle
        hits = placed.select("id", "tk", "size", F.explode_outer("places").alias("x")).select("id", "tk", "size", "x.*").join(_broadcast(posted), "hash")
        first = (F.col("j") == 0) | (F.col("pos") == 0) | (F.col("prev") != F.col("before"))
        last = (F.col("j") == F.col("m") - 1) | F.col("next").isNull() | (F.col("next") != F.col("after"))
        starts = F.array_compact(F.array(F.when(first, F.col("pos") - F.col("j")), F.when(first, F.col("pos")), F.when(last, F.col("pos") - F.col("m") + 1)))
        spots = hits.where(first | last).select("id", "tk", "n", "m", "size", F.explode(starts).alias("s"))
        spots = scratch.write(spots.select("id", "tk", "n", "m", F.greatest(F.lit(0), F.least("s", F.col("size") - F.col("m"))).alias("start")).distinct(), "windows")
        # a document's own windows in one row: as many as its runs of hits
        asked = spots.groupBy("id", "tk").agg(F.collect_list(F.struct("n", "m", "start")).alias("ws")).withColumnRenamed("id", "wid").withColumnRenamed("tk", "wtk")
        asked = F.broadcast(asked) if spots.count() <= BROADCAST_ROWS else asked
        again = keyed.join(asked, F.col("id").eqNullSafe(F.col("wid")) & (F.col("tk") == F.col("wtk")))
        cut = F.transform("ws", lambda x: F.struct(x.n.alias("n"), x.start.alias("start"), F.slice("h", x.start + 1, x.m).alias("wh")))
        marked = shingled(again, "ws").select("id", F.explode(cut).alias("x")).select("id", "x.*").distinct()
        marked = scratch.write(marked.withColumn("fp", simhash_of(F.col("wh"))), "fingerprints")
        flips = [0]
        for b in range(8):
            flips += [1 << b] + ([(1 << b) | (1 << c) for c in range(b)] if RADIUS // BLOCKS >= 2 else [])
        assert RADIUS // BLOCKS == 2
        index = own.select("item", "m", "n", "ih", "ifp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block_value(F.col("ifp"), b).alias("v")) for b in range(BLOCKS)])).alias("x"))
        index = index.select("item", F.col("n").alias("inn"), "ifp", F.col("x.b").alias("b"), F.col("x.v").alias("v0"), F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip"))
        index = index.select("item", F.col("inn").alias("n"), "ifp", "b", F.col("v0").bitwiseXOR(F.col("flip")).alias("v"))
        probe = marked.select("id", "n", "start", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block_value(F.col("fp"), b).alias("v")) for b in range(BLOCKS)])).alias("x"))
        probe = probe.select("id", "n", "start", "fp", F.col("x.b").alias("b"), F.col("x.v").alias("v"))
        near = probe.join(_broadcast(index), ["n", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
        near = near.select("id", "n", "start", "fp", "item").distinct()
        whole = near.join(_broadcast(own.select("item", "ih", "ifp")).drop("ifp"), "item").join(marked.select("id", "n", "start", "fp", "wh"), ["n", "start", "fp", "id"])
        sim = weighted_similarity(F.col("wh"), F.col("ih"))
        ok = whole.select("id", "item", "start", F.col("n").alias("n_words"), sim.alias("similarity")).where(F.col("similarity") >= similarity)
        found = ok if found is None else found.unionByName(ok)
    if found is None:
        kinds = T.StructType([docs.schema[id_col], bench.schema[item_col]])
        names = ["id", "item", "start", "n_words", "similarity"]
        found = spark.createDataFrame([], T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kinds)] + [T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words"))
    return found.groupBy("id", "item").agg(best.alias("x")).select("id", "item", (-F.col("x.s")).alias("start"), F.col("x.n_words").alias("n_words"), F.col("x.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """docs without those that hold an item. The matched ids are broadcast if they are few, else joined by id."""
    id_col = how.get("id_col", "doc_id")
    ids = contaminated(docs, bench, **how).select(F.col("id").alias("__id")).distinct()
    ids = Scratch(docs.sparkSession, "contaminated").write(ids, "ids")
    return docs.join(_broadcast(ids), F.col(id_col) == F.col("__id"), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminated(docs, bench)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", F.round("similarity", 6).alias("similarity"))
