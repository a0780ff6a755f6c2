"""Importance resampling towards a target distribution, by hashed word features.

Plan: one pass over the texts writes a row for each document and posting blocks: for one bucket, the documents
of a slice of a batch that have it and how often. Blocks are dealt by (bucket group, salt): a group has a sixteenth of the buckets, a salt
about a million postings of each group, so a bucket with a third of all postings lies in as many cells as it needs and
a document in at most sixteen. Corpus and target totals of a cell's buckets are co-grouped with its blocks, each bucket's
gain weighs its postings there, and a document's contributions, one for each group, are summed by document.
The draw is Gumbel top-k: seeded noise on the weights, then ranks by range partitions.

Defined results: null and empty texts have no features and weight 0; a document without an id draws its noise from the seed alone and
comes before others of its score; rows that repeat an id have equal noise and are drawn one by one; an empty table gives an empty result, an
empty target gives gains by the corpus alone; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_SQL, Scratch, crc32_sql, ranked
from .words import NOT_ALNUM, Words, combine, counted, slices, words_of

BUCKETS = 10000
#: Bucket groups (and the most contributions of a document), postings of a cell (about) and of a block (at most).
GROUPS, CELL, BLOCK = 16, 1 << 20, 1 << 14


def features(words: Words, lengths: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every run of lengths[0] to lengths[1] consecutive words of a text; each different run is hashed once."""
    rows, found = [], []
    for n in range(lengths[0], lengths[1] + 1):
        at = np.flatnonzero(words.row[: len(words.row) - n + 1] == words.row[n - 1 :]) if len(words.row) >= n else np.empty(0, np.int64)
        h = combine([words.hash[at + k] for k in range(n)]) if n > 1 else words.hash
        distinct, place, _ = counted(h)
        names = (b" ".join(words.data[words.start[i + k] : words.end[i + k]].tobytes() for k in range(n)) for i in at[place].tolist())
        bucket = np.fromiter((zlib.crc32(x) % buckets for x in names), np.int64, len(place))
        rows.append(words.row[at]), found.append(bucket[np.searchsorted(distinct, h)])
    return np.concatenate(rows), np.concatenate(found)


def bucket_totals(texts: DataFrame, text_col: str, lengths: tuple[int, int], buckets: int) -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 0)):
            n = np.bincount(features(words_of(batch.column(0), NOT_ALNUM), lengths, buckets)[1], minlength=buckets)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has])], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, id_col: str, text_col: str, lengths: tuple[int, int], buckets: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written ``documents(row, id, n_features, n_words)`` and ``blocks(bucket, batch, total, base, at, n)``:
    ``base + at[i]`` is a row that has the bucket ``n[i]`` times."""
    lists = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, k) for c, k in (
        ("n_features", T.LongType()), ("n_words", T.LongType()), ("bucket", T.IntegerType()), ("batch", T.LongType()), ("total", T.LongType()), ("base", T.LongType()), ("at", lists), ("n", lists)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in (x for b in batches for x in slices(b, 1)):
            size = batch.num_rows
            words = words_of(batch.column(1), NOT_ALNUM)
            row, bucket = features(words, lengths, buckets)
            key, _, n = counted(bucket.astype(np.uint64) * np.uint64(size) + row.astype(np.uint64))
            of, row_of = (key // np.uint64(max(size, 1))).astype(np.int64), (key % np.uint64(max(size, 1))).astype(np.int64)
            count = lambda rows: pa.array(np.bincount(rows, minlength=size))
            ids = [pa.array(np.arange(base, base + size)), batch.column(0), count(row), count(words.row)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.nulls(size, pa.int32() if k == 0 else pa.list_(pa.int32()) if k > 3 else pa.int64()) for k in range(6))], names=schema.names)
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
            head = np.unique(np.concatenate([head, *(np.arange(a, b, BLOCK) for a, b in zip(head, np.append(head[1:], len(of))) if b - a > BLOCK)]))
            if len(head):
                ends = pa.array(np.append(head, len(of)).astype(np.int32))
                k, same = len(head), lambda v, k=len(head): pa.array(np.full(k, v, np.int64))
                arrays = [pa.nulls(k, pa.int64()), pa.nulls(k, batch.column(0).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(of[head].astype(np.int32)), same(base), pa.array(np.add.reduceat(n, head)), same(base)]
                arrays += [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (row_of, n)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            base += size

    made = scratch.write(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema), "postings")
    return made.where("bucket is null").select("row", "id", "n_features", "n_words"), made.where("bucket is not null").select("bucket", "batch", "total", "base", "at", "n")


def _weigh(blocks: pa.Table, gains: pa.Table) -> pa.Table:
    """What the postings of a cell add to their documents."""
    if not blocks.num_rows:
        return pa.table({"row": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})
    gain = np.zeros(1 + max(gains["bucket"].to_numpy().max(), blocks["bucket"].to_numpy().max()), np.int64)
    gain[gains["bucket"].to_numpy()] = gains["gain"].to_numpy()
    at, n = blocks["at"].combine_chunks(), blocks["n"].combine_chunks()
    sizes = np.diff(np.append(at.offsets.to_numpy()[:-1], at.offsets.to_numpy()[-1]))
    row = np.repeat(blocks["base"].to_numpy(), sizes) + at.flatten().to_numpy()
    part = np.repeat(gain[blocks["bucket"].to_numpy()], sizes) * n.flatten().to_numpy().astype(np.int64)
    rows, _, total = counted(row, part)
    return pa.table({"row": pa.array(rows), "part": pa.array(total)})


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", lengths: tuple[int, int] = (1, 1), buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``(id, n_features, weight, score, rank)`` of every document: weight is the floored mean gain (thousandths of a nat) of
    its features; of the documents with least_words or more, the percent with the highest scores are drawn and ranked from 1."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    documents, blocks = postings(docs, id_col, text_col, lengths, buckets, scratch)
    own = blocks.groupBy("bucket").agg(F.sum("total").alias("s"), F.sum(F.size("at")).alias("entries"))
    aim = bucket_totals(target, target_col, lengths, buckets).withColumnRenamed("n", "t")
    totals = scratch.write(own.join(aim, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t"), "entries"), "totals")  # a row for each bucket
    all_s, entries = totals.agg(F.sum("s"), F.sum("entries")).first()
    all_t = aim.agg(F.sum("t")).first()[0] or 0
    salts = max(1, -(-(entries or 0) // (GROUPS * CELL)))
    ratio = (F.col("t") + 1).cast("double") * F.lit(float((all_s or 0) + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    group = F.pmod("bucket", F.lit(GROUPS)).alias("group")
    gains = totals.select(group, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))
    dealt = blocks.select(group, F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int").alias("salt"), "bucket", "base", "at", "n")
    parts = dealt.groupBy("group", "salt").cogroup(gains.groupBy("group", "salt")).applyInArrow(_weigh, "row long, part long")
    sums = parts.groupBy("row").agg(F.sum("part").alias("sum"))
    weighed = documents.join(sums, "row", "left").withColumn("sum", F.coalesce("sum", F.lit(0)))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0).cast("long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    weighed = weighed.withColumn("weight", weight).withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))))
    weighed = scratch.write(weighed.select("row", "id", "n_features", "n_words", "weight", "score"), "scores")
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row").asc()]
    drawn = ranked(weighed.where(F.col("n_words") >= least_words).select("row", "id", "score"), order, scratch)
    drawn = drawn.where(F.col("pos") < F.expr(f"n * {int(percent)} div 100")).select("row", (F.col("pos") + 1).alias("rank"))
    return weighed.join(drawn, "row", "left").select("id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    done = resample(docs, target, lengths=(1, 1), buckets=BUCKETS, percent=10, least_words=20, seed=2024)
    return done.withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS x FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) > 0 THEN (x - ((x % len(w)) + len(w)) % len(w)) // len(w) ELSE 0 END::BIGINT AS weight,
 (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0 AS h FROM d LEFT JOIN x USING (r)),
sc AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln(h)))::BIGINT AS score FROM m),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM sc LEFT JOIN k USING (r)
"""
