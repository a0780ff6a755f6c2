"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, scored by workers that map them.

Plan: words are counted by hash (one map-side count a batch, one aggregation). Then n-grams, as columns of word hashes, are counted
in the tasks and shuffled as packed blocks to buckets of their context; a context whose words are all among the hot ones (more
than 1/1024 of all tokens each, so at most 1024) is dealt by the whole n-gram instead, so no bucket grows with a word. A task merges one
bucket and writes its arrays, and returns what is summed on: context totals, counts of counts, and the next lower order's continuation
counts. Files are moved into place whole and hold the same bytes whenever a task runs again. Scoring looks up each distinct n-gram of a batch
once, in key order; arrays on a file system of this machine's or a mounted shared folder are memory-mapped, from an object store they are read.

The model: order k's probability is ``max(c - D(c), 0) / c(context) + gamma(context) * p(shorter)``, with raw counts at the highest order, the number
of different words before below it, three discounts from counts of counts, and 1 / (distinct tokens + 1) under the lowest. Texts
begin with as many start marks as the context is long and end with an end token, which is scored.

Defined results: a null or blank text is its end token alone; rows without an id are trained on; repeated rows count as
often as they occur; with nothing to learn from all tokens have probability 1; an empty table gives an empty result; other columns are not read.
Memory: one text and its arrays are held whole in a task, besides a slice of texts and a bucket.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_SQL, Scratch, crc32_sql
from .words import combine, counted, distinct_of, slices, words_of

ORDER = 2
#: Tokens for a bucket of n-grams, about; distinct n-grams that a task gathers before it sends them.
BUCKET, GATHER = 1 << 21, 1 << 20
#: A word is hot with more than this part of all tokens.
HOT = 1024
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


class Counted(NamedTuple):
    """Counts of one order: n-grams by columns of word hashes."""

    columns: list[np.ndarray]
    n: np.ndarray


def tokens_of(texts: pa.Array, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First token of each text, and the columns of the n-gram that ends at each token."""
    words = words_of(texts)
    sizes = np.bincount(words.row, minlength=len(texts)) + 1
    first = np.cumsum(sizes) - sizes
    last = np.full(int(sizes.sum()), END, np.uint64)
    last[np.arange(len(words.row)) + words.row] = words.hash
    within = np.arange(len(last)) - np.repeat(first, sizes)
    columns = [last]
    for back in range(1, order):
        before = np.full(len(last), START, np.uint64)
        before[back:] = last[:-back]
        before[within < back] = START
        columns.insert(0, before)
    return first, columns


def summed(parts: list[Counted]) -> Counted:
    columns = [np.concatenate(c) for c in zip(*(p.columns for p in parts))]
    _, place, n = counted(combine(columns), np.concatenate([p.n for p in parts]))
    return Counted([c[place] for c in columns], n)


def bucket_of(columns: list[np.ndarray], buckets: int, hot: np.ndarray) -> np.ndarray:
    """By context; by the whole n-gram where all words of the context are hot or start marks."""
    everywhere = np.ones(len(columns[0]), bool)
    for c in columns[:-1]:
        everywhere &= (c == START) | (hot[np.minimum(np.searchsorted(hot, c), len(hot) - 1)] == c if len(hot) else False)
    key = combine(columns[:-1])
    key[everywhere] = combine([c[everywhere] for c in columns])
    return (key % np.uint64(buckets)).astype(np.int32)


def packed(grams: Counted, buckets: int, hot: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A block for each bucket that has any; rows by context, whose repeats compress."""
    bucket = bucket_of(grams.columns, buckets, hot)
    order = np.lexsort((*grams.columns[:-1][::-1], bucket))
    columns, n, bucket = [c[order] for c in grams.columns], grams.n[order], bucket[order]
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    squeeze = zstandard.ZstdCompressor(1)
    blocks = []
    for a, b in zip(head.tolist(), np.append(head[1:], len(bucket)).tolist()):
        small = n[a:b].astype(np.min_scalar_type(n[a:b].max()))
        data = b"".join([np.array([b - a, small.itemsize], np.int64).tobytes(), small.tobytes(), *(c[a:b].tobytes() for c in columns)])
        blocks.append(squeeze.compress(data))
    return bucket[head].tolist(), blocks


def unpacked(block: bytes, order: int) -> Counted:
    data = zstandard.decompress(block)
    size, width = np.frombuffer(data, np.int64, 2).tolist()
    n = np.frombuffer(data, f"u{width}", size, 16).astype(np.int64)
    return Counted([np.frombuffer(data, np.uint64, size, 16 + size * (width + 8 * k)) for k in range(order)], n)


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    for column, values in arrays.items():
        np.save(data := io.BytesIO(), values)
        with store.open_output_stream(part := f"{base}/.{uuid.uuid4().hex}") as out:
            out.write(data.getbuffer())
        store.move(part, f"{base}/{name}.{column}.npy")


class Arrays:
    """Sorted key arrays with their values, one set of files a bucket; opened as they are asked for."""

    def __init__(self, folder: str, name: str, columns: tuple[str, ...]):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        self.name, self.columns, self.held = name, columns, {}

    def _bucket(self, bucket: int) -> list[np.ndarray] | None:
        if bucket not in self.held:
            paths = [f"{self.base}/{self.name}-{bucket}.{c}.npy" for c in ("key", *self.columns)]
            if not self.store.get_file_info(paths[0]).is_file:
                self.held[bucket] = None
            elif self.local:
                self.held[bucket] = [np.load(p, mmap_mode="r") for p in paths]
            else:
                self.held[bucket] = [np.load(io.BytesIO(self.store.open_input_file(p).read())) for p in paths]
        return self.held[bucket]

    def find(self, keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the ascending keys there are, and the values of each (0 where there are none)."""
        hit, values = np.zeros(len(keys), bool), [np.zeros(len(keys)) for _ in self.columns]
        small = bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket
        order = np.argsort(small, kind="stable")  # keys stay in order within a bucket
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, edges) if len(order) else []:
            arrays = self._bucket(int(bucket[at[0]]))
            if arrays is None:
                continue
            place = np.minimum(np.searchsorted(arrays[0], keys[at]), len(arrays[0]) - 1)
            found = arrays[0][place] == keys[at]
            hit[at[found]] = True
            for out, column in zip(values, arrays[1:]):
                out[at[found]] = column[place[found]]
        return hit, values


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2, and 3 or more; half a count each where the counts of counts do not allow the estimate."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _plain(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


class Model:
    """``order``, ``total`` and ``distinct`` tokens, discounts by order, hot words, the number of buckets and the folder of the arrays."""

    def __init__(self, **state):
        self.__dict__.update(state)

    def open(self) -> Model:
        self.grams = {k: Arrays(self.folder, f"grams-{k}", ("n",)) for k in range(2, self.order + 1)}
        self.contexts = {k: Arrays(self.folder, f"contexts-{k}", ("total", "gamma")) for k in range(2, self.order + 1)}
        self.words = Arrays(self.folder, "words", ("n", "p"))
        return self

    def word(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and lowest-order probability of words."""
        hit, (n, p) = self.words.find(h, (h % np.uint64(self.buckets)).astype(np.int32))
        return n, np.where(hit, p, self.unseen)

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last word of each n-gram after the others. The n-grams are distinct and ascend by their hash (one word: by itself)."""
        if len(columns) == 1:
            return self.word(columns[0])[1]
        k, d = len(columns), np.array([0.0, *self.discounts[len(columns)]])
        _, place, where = distinct_of(combine(columns[1:]) if k > 2 else columns[1])
        lower = self.probability([c[place] for c in columns[1:]])[where]
        _, (n,) = self.grams[k].find(combine(columns), bucket_of(columns, self.buckets, self.hot))
        context, _, where = distinct_of(combine(columns[:-1]))
        known, (total, gamma) = (x[where] if isinstance(x, np.ndarray) else [v[where] for v in x] for x in self.contexts[k].find(context, (context % np.uint64(self.buckets)).astype(np.int32)))
        own = np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0) / np.where(known, total, 1)
        return np.where(known, own + gamma * lower, lower)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        first, columns = tokens_of(texts, self.order)
        if not len(first):
            return {k: np.empty(0, t) for k, t in (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", float), ("score", float))}
        h = columns[-1]
        distinct, _, where = distinct_of(h)
        n = self.word(distinct)[0]
        base, n = np.log10((n + 1) / (self.total + self.distinct + 1))[where], n[where]
        _, place, where = distinct_of(combine(columns))
        p = np.log10(self.probability([c[place] for c in columns]))[where]
        add = lambda x: np.add.reduceat(x.astype(np.longdouble), first).astype(float)
        return {"n_tokens": np.diff(np.append(first, len(h))), "n_known": np.add.reduceat((n > 0).astype(np.int64), first), "base_score": add(base), "score": add(p)}


_LEVEL = "kind int, key long, a long, b long, c long, d long, bucket int, block binary"


def _level(k: int, buckets: int, hot: np.ndarray, folder: str):
    """Merges a bucket of blocks of order k."""

    def rows(kind: int, **columns) -> pa.Table:
        size = len(next(iter(columns.values())))
        fields = [("kind", pa.int32()), ("key", pa.int64()), *((x, pa.int64()) for x in "abcd"), ("bucket", pa.int32()), ("block", pa.binary())]
        given = {"kind": pa.array(np.full(size, kind, np.int32))} | {c: v if isinstance(v, pa.Array) else _plain(np.asarray(v)) for c, v in columns.items()}
        return pa.table([given.get(c, pa.nulls(size, t)).cast(t) for c, t in fields], names=[c for c, _ in fields])

    def merge(blocks: pa.Table) -> pa.Table:
        grams = summed([unpacked(b.as_py(), k) for b in blocks["block"]])
        key = combine(grams.columns)  # ascending, as counted leaves it
        save(folder, f"grams-{k}-{blocks['bucket'][0].as_py()}", key=key, n=grams.n.astype(np.min_scalar_type(grams.n.max())))
        context = combine(grams.columns[:-1])
        names, _, total = counted(context, grams.n)
        ones, twos, more = (counted(context, (x).astype(np.int64))[2] for x in (grams.n == 1, grams.n == 2, grams.n > 2))
        exactly = [[int((grams.n == x).sum())] for x in (1, 2, 3, 4)]
        out = [rows(1, key=names, a=total, b=ones, c=twos, d=more), rows(2, **dict(zip("abcd", exactly)))]
        lower = summed([Counted(grams.columns[1:], np.ones(len(key), np.int64))])
        if k == 2:
            out.append(rows(0, key=lower.columns[0], a=lower.n))
        else:
            to, packs = packed(lower, buckets, hot)
            out.append(rows(3, bucket=np.array(to, np.int32), block=pa.array(packs, pa.binary())))
        return pa.concat_tables(out)

    return merge


def train(docs: DataFrame, text_col: str = "text", *, order: int = ORDER, bucket: int = BUCKET, scratch: Scratch | None = None) -> Model:
    """Counts all rows of docs and writes the model's arrays under the session's shared folder."""
    assert order >= 2
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    texts, folder = docs.select(F.col(text_col).cast("string").alias("text")), scratch.path("model")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                h, _, n = counted(tokens_of(part.column(0), 1)[1][0])
                yield pa.RecordBatch.from_arrays([_plain(h), pa.array(n)], names=["key", "n"])

    vocabulary = scratch.write(texts.mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    distinct, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = np.sort(np.array([r.key for r in vocabulary.where(F.col("n") * HOT > total).collect()], np.int64).view(np.uint64))  # fewer than HOT rows
    buckets = max(1, -(-total // bucket))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counted] = []

        def sent() -> pa.RecordBatch:
            to, blocks = packed(summed(held), buckets, hot)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for part in slices(batch, 0):
                columns = tokens_of(part.column(0), order)[1]
                held.append(summed([Counted(columns, np.ones(len(columns[0]), np.int64))]))
                del columns
                if len(held) > 1 and len(held[0].n) < 4 * len(held[-1].n):
                    held[:] = [summed(held)]
                if sum(len(h.n) for h in held) >= GATHER:
                    yield sent()
        if held:
            yield sent()

    blocks, found = texts.mapInArrow(grams, "bucket int, block binary"), {}
    for k in range(order, 1, -1):
        level = scratch.write(blocks.groupBy("bucket").applyInArrow(_level(k, buckets, hot, folder), _LEVEL), f"order-{k}")
        counts = level.where("kind = 2").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "abcd"]).first()
        found[k] = discounts(*counts)
        gamma = sum((F.lit(d) * F.col(x) for d, x in zip(found[k], "bcd")), F.lit(0.0)) / F.col("a")
        contexts = level.where("kind = 1").groupBy("key").agg(*[F.sum(x).alias(x) for x in "abcd"]).select("key", F.col("a").alias("total"), gamma.alias("gamma"))
        _saved(contexts, folder, f"contexts-{k}", buckets, scratch)
        blocks = level.where("kind = 3").select("bucket", "block")
    words_seen = level.where("kind = 0").groupBy("key").agg(F.sum("a").alias("a"))
    lowest = scratch.write(vocabulary.join(words_seen, "key"), "lowest")
    exactly = [F.count_if(F.col("a") == x) for x in (1, 2, 3, 4)]
    *counts, all_seen, more = lowest.agg(*exactly, F.coalesce(F.sum("a"), F.lit(0)), F.count_if(F.col("a") > 2)).first()
    d = discounts(*counts)
    weight = (d[0] * counts[0] + d[1] * counts[1] + d[2] * more) / all_seen if all_seen else 1.0
    unseen = weight / (distinct + 1)
    off = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
    p = F.greatest(F.col("a") - off, F.lit(0.0)) / F.lit(float(all_seen or 1)) + F.lit(unseen)
    _saved(lowest.select("key", "n", p.alias("p")), folder, "words", buckets, scratch)
    return Model(order=order, total=total, distinct=distinct, discounts=found, unseen=unseen, hot=hot, buckets=buckets, folder=folder)


def _saved(rows: DataFrame, folder: str, name: str, buckets: int, scratch: Scratch) -> None:
    """rows(key, values...) as sorted arrays, dealt by the unsigned key."""
    bucket = F.expr(f"cast(pmod(cast(key as decimal(20)) + if(key < 0, 18446744073709551616, 0), {buckets}) as int)")
    columns = rows.columns

    def write(part: pa.Table) -> pa.Table:
        order = np.argsort(key := part["key"].to_numpy().view(np.uint64))
        save(folder, f"{name}-{part['bucket'][0].as_py()}", key=key[order], **{c: part[c].to_numpy()[order] for c in columns[1:]})
        return pa.table({"rows": pa.array([len(key)], pa.int64())})

    scratch.write(rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(write, "rows long"), name)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``n_tokens, n_known, base_score, score`` (log10) after its own columns; columns of docs that have these names give way."""
    kinds = {"n_tokens": T.LongType(), "n_known": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    docs = docs.drop(*kinds)
    at, state = docs.columns.index(text_col), dict(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**state).open()
        for batch in batches:
            for part in slices(batch, at):
                done = m.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(done[k]) for k in kinds)], names=[*part.schema.names, *kinds])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in kinds.items())]))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to 7 decimals. ``perplexity``: by token, ends included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs.where(~held), "text")
    done = scored(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    done = done.withColumn("train_tokens", F.lit(model.total).cast("long")).withColumn("perplexity", F.round(F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")), 4))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 7).alias("base_score"), F.round("score", 7).alias("score"), "perplexity")


def _discount_sql(of: str) -> str:
    """Discounts d1, d2, d3 of the counts n of a table."""
    y = "(n1 / (n1 + 2 * n2))"
    part = lambda k: f"least(greatest({k} - {k + 1} * {y} * n{k + 1} / n{k}, 0), {k})"
    whole = "n1 > 0 AND n2 > 0 AND n3 > 0"
    cases = ", ".join(f"CASE WHEN {whole} THEN {part(k)} ELSE {k / 2} END::DOUBLE AS d{k}" for k in (1, 2, 3))
    return f"SELECT {cases} FROM (SELECT " + ", ".join(f"count_if(n = {k})::DOUBLE AS n{k}" for k in (1, 2, 3, 4)) + f" FROM {of})"


_OFF = "greatest(n - CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END, 0)"
_KEPT = "(d1 * count_if(n = 1) + d2 * count_if(n = 2) + d3 * count_if(n > 2))"
_W = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [])"
#: For order 2. No word holds the blanks of the marks.
OP12_SQL = rf"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 2, false) AS held_out, {_W} AS w FROM documents, crc),
k AS (SELECT r, held_out, unnest(list_concat([' start'], w)) AS u, unnest(list_concat(w, [' end'])) AS v FROM d),
tr AS (SELECT * FROM k WHERE NOT held_out),
uni AS (SELECT v, count(*) AS c FROM tr GROUP BY 1), nv AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS kinds FROM uni),
bi AS (SELECT u, v, count(*) AS n FROM tr GROUP BY 1, 2), cont AS (SELECT v, count(*) AS n FROM bi GROUP BY 1),
d2 AS ({_discount_sql("bi")}), d1 AS ({_discount_sql("cont")}),
ctx AS (SELECT u, sum(n) AS total, {_KEPT} / sum(n) AS gamma FROM bi, d2 GROUP BY u, d1, d2, d3),
low AS (SELECT {_KEPT} / sum(n) / (any_value(kinds) + 1) AS unseen, sum(n) AS seen FROM cont, d1, nv GROUP BY d1, d2, d3),
p1 AS (SELECT v, {_OFF} / seen + unseen AS p FROM cont, d1, low),
lw AS (SELECT coalesce(max(unseen), 1.0) AS unseen FROM low),
g AS (SELECT u, v, coalesce(n, 0) AS n, coalesce(p, unseen) AS p, ctx.total, gamma, coalesce(c, 0) AS c
 FROM (SELECT DISTINCT u, v FROM k) LEFT JOIN bi USING (u, v) LEFT JOIN ctx USING (u) LEFT JOIN p1 USING (v) LEFT JOIN uni USING (v), lw),
q AS (SELECT u, v, c, log10(CASE WHEN g.total IS NULL THEN p ELSE {_OFF} / g.total + gamma * p END) AS lp, log10((c + 1) / (nv.total + kinds + 1)) AS lb FROM g, d2, nv),
s AS (SELECT r, count(*) AS n_tokens, count_if(c > 0)::BIGINT AS n_known, fsum(lb) AS b, fsum(lp) AS s FROM k JOIN q USING (u, v) GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, round(b, 7) AS base_score, round(s, 7) AS score, round(pow(10.0, -s / n_tokens), 4) AS perplexity
FROM d JOIN s USING (r), nv
"""
