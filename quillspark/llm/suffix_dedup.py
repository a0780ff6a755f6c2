"""Exact removal of long repeated byte strings by distributed prefix doubling over anchors.

A string of ``length`` bytes is repeated if it also starts elsewhere. Ranking every byte position in
every round would move sixteen bytes a position nine times; instead the rounds work on few
positions that equal strings agree on:

1. Anchors. In every window of ``length`` bytes the 64-byte gram of least hash is its anchor
   (the leftmost of equals), so equal windows have equal anchors at equal offsets. Consecutive windows of
   one anchor form a run: about one a 190 bytes. Runs are named by the gram's rolling hash.
2. Unique names are dropped: none of these windows is repeated. Runs whose whole extent is
   equal to another's are repeated as a whole. Of the rest one representative of each extent goes on.
3. Rounds at growing lengths (145, 273, 337, ... up to 400): a block of 2^k neighbouring windows is
   named by the bytes that all of them share, the next rank after its parent's; Spark groups equal
   names. A name without a partner is unique and ends; a block whose whole extent has a partner
   is repeated and ends (one of each extent stays as a partner for others); others halve,
   down to single windows, whose name is the whole string.
4. Removed ranges meet their documents again by a hash of id and text, and each text is cut.

Groups are only ever aggregated and joined, so a passage in a third of all documents is no
single task's work. Defined results: a null text is empty; texts shorter than the length lose nothing; repeated
rows repeat each other's strings and lose all of them; an empty table gives an empty result;
other columns are not read. Equality is by 128 bits: two hashes of the content of different bases and seeds, so that
even among 10^12 runs a false partner is not to be expected; documents are keyed by 128 bits as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

LENGTH, GRAM = 400, 64
#: Window starts handled at a time: bounds memory for very long texts. Positions must fit in 20 bits.
SEGMENT = 1 << 18


_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _tables(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd base and of its inverse modulo 2^64; made once a worker."""
    if (n, which) not in _TABLES:
        _TABLES[n, which] = _make_tables(n, which)
    return _TABLES[n, which]


def _make_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = BASES[which]
    inverse = pow(base, -1, 1 << 64)
    value = np.random.default_rng(20240229 + which).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def power(b: int) -> np.ndarray:
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return value, power(base), power(inverse)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def anchor_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash, two hashes of the run's whole extent) of all runs of a text."""
    n, span = len(data), length - gram + 1
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    value, power, inverse = _tables(SEGMENT + length + 1)
    value2, power2, inverse2 = _tables(SEGMENT + length + 1, 1)
    for seg in range(0, max(0, n - length + 1), SEGMENT):
        raw = np.frombuffer(data, np.uint8, min(n - seg, SEGMENT + length - 1), seg)
        x = value[raw]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * inverse[: len(x)], dtype=np.uint64)])
        sums2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value2[raw] * inverse2[: len(x)], dtype=np.uint64)])
        grams, windows = len(x) - gram + 1, len(x) - length + 1
        at = np.arange(grams, dtype=np.uint64)
        g = _mix((sums[gram:] - sums[:grams]) * power[:grams])
        order = (g & ~np.uint64(0xFFFFF)) | at
        pad = np.concatenate([order, np.full(-grams % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(pad, axis=1).ravel()
        back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [windows]]) - 1
        a = anchor[first]
        extent = _mix((sums[last + length] - sums[first]) * power[first])
        extent2 = _mix((sums2[last + length] - sums2[first]) * power2[first])
        for k, v in enumerate((first + seg, last + seg, a + seg, g[a], extent, extent2)):
            out[k].append(v)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)
    return tuple(np.concatenate(v) if v else np.empty(0, k) for v, k in zip(out, kinds))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"key": F.xxhash64("id", "text"), "key2": F.xxhash64(F.lit(2), "id", "text")})


def _runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [anchor_runs(text.as_buffer().to_pybytes(), length, gram) for text in batch.column(2)]
            first, last, a, g, extent, extent2 = (np.concatenate([p[k] for p in parts]) for k in range(6))
            key, key2 = (np.repeat(batch.column(k).to_numpy(), [len(p[0]) for p in parts]) for k in range(2))
            cols = [key, key2, first, (a - last).astype(np.int32), (a - first).astype(np.int32), *(v.view(np.int64) for v in (g, extent, extent2))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "key2", "first", "lo", "hi", "gram", "extent", "extent2"])

    return keyed.select("key", "key2", "text").mapInArrow(run, "key long, key2 long, first long, lo int, hi int, gram long, extent long, extent2 long")


#: A content's 128-bit name, and a document's.
CID, KEY = ["cid", "cid2"], ["key", "key2"]


def _name(*parts) -> tuple:
    """Two hashes of the same columns under different seeds."""
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def repeated_ranges(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(key, key2, start, end)`` byte ranges that repeated strings cover, for the documents' keys."""
    keyed = _keyed(docs, id_col, text_col)
    # cid and cid2 name a run's content and its place in the windows; equal names are equal runs
    made = _runs(keyed, length, gram).withColumns({"cid": F.xxhash64("gram", "extent", "lo", "hi"), "cid2": F.xxhash64("extent2", "gram", "lo", "hi")})
    runs = scratch.write(made.drop("extent", "extent2"), "runs")
    grams = runs.groupBy("gram").agg(F.count("*").alias("n"), *[f(c).alias(n) for f, c, n in ((F.min, "cid", "c0"), (F.max, "cid", "c1"), (F.min, "cid2", "d0"), (F.max, "cid2", "d1"))])
    open_grams = grams.where("n > 1 and (c0 != c1 or d0 != d1)").select("gram")
    by_cid = runs.groupBy(*CID).agg(F.count("*").alias("m"), F.min("gram").alias("gram"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min(F.struct(*KEY, "first")).alias("at"))
    by_cid = scratch.write(by_cid.join(open_grams, "gram", "left_semi").unionByName(by_cid.where("m > 1").join(open_grams, "gram", "left_anti")), "contents")
    whole = runs.join(by_cid.where("m > 1").select(*CID), CID, "left_semi")
    whole = scratch.write(whole.select(*KEY, F.col("first").alias("start"), (F.col("first") + F.col("hi") - F.col("lo") + length).alias("end")), "whole")

    # the bytes of every content that goes on, from one of its documents
    wanted = by_cid.join(open_grams, "gram", "left_semi").select(*CID, "gram", "lo", "hi", "m", *[F.col(f"at.{k}").alias(k) for k in KEY], F.col("at.first").alias("first"))
    listed = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*CID, "gram", "lo", "hi", "m", "first")).alias("x"))
    text = keyed.join(listed, KEY).dropDuplicates(KEY).select(F.encode("text", "UTF-8").alias("bytes"), F.explode("x").alias("x"))
    cut = F.substr("bytes", (F.col("x.first") + 1).cast("int"), F.col("x.hi") - F.col("x.lo") + length)
    contents = scratch.write(text.select(*[f"x.{c}" for c in CID], "x.gram", "x.lo", "x.hi", (F.col("x.m") == 1).alias("asks"), cut.alias("bytes")), "bytes")

    most = length - gram  # the largest offset of an anchor in a window
    level = max(most, 1).bit_length() - 1
    blocks = contents.select(*CID, F.explode(F.array(*[F.lit(j) for j in range((most >> level) + 1)])).alias("j"))
    found, held, names_of, same_as = None, None, ["name", "name2"], ["name", "name2", "extent", "extent2"]
    while level >= 0:
        lo_o, hi_o = F.col("j") * (1 << level), F.least(F.col("j") * (1 << level) + ((1 << level) - 1), F.lit(most))
        b = blocks.join(contents, CID).withColumn("o1", lo_o).withColumn("o2", hi_o).where("o1 <= hi and o2 >= lo")
        shared = F.substr("bytes", F.col("hi") - F.col("o1") + 1, F.col("o1") - F.col("o2") + length)
        inside = (F.col("lo") <= F.col("o1")) & (F.col("o2") <= F.col("hi"))
        extent = F.substr("bytes", F.col("hi") - F.col("o2") + 1, F.col("o2") - F.col("o1") + length)
        name, own = _name("gram", F.lit(level), "j", shared), _name(*CID, F.lit(-1))
        extent = [F.when(inside, e).otherwise(o) for e, o in zip(_name(extent, F.lit(level)), own)]
        named = b.select(*CID, "asks", "j", "o1", "o2", *[c.alias(n) for c, n in zip((*name, *extent), same_as)], inside.alias("inside"))
        named = scratch.write(named, "names")
        same = named.groupBy(*same_as).agg(F.count("*").alias("k"), F.min("cid").alias("stays"))
        names = same.groupBy(*names_of).agg(F.sum("k").alias("n"), F.count("*").alias("extents"))
        ranked = named.join(same, same_as).join(names.where("n > 1"), names_of)
        ranked = scratch.write(ranked.withColumn("done", F.col("inside") & (F.col("k") > 1)), "ranks")
        hit = ranked.where("done and asks").select(*CID, "o1", "o2")
        new = scratch.write(hit if found is None else found.union(hit), "found")
        # a block with partners of other extents halves; of equal extents one stays as a partner
        onward = ranked.where("extents > 1 and (not done or cid = stays)")
        blocks = onward.select(*CID, F.explode(F.array(F.col("j") * 2, F.col("j") * 2 + 1)).alias("j"))
        scratch.drop(found, named, held)
        found, held = new, ranked
        level -= 1
        if level >= 0 and onward.isEmpty():  # no block is left to halve
            break
    placed = wanted.where("m = 1").select(*CID, *KEY, (F.col("first") + F.col("hi")).alias("anchor"))
    part = found.join(placed, CID).select(*KEY, (F.col("anchor") - F.col("o2")).alias("start"), (F.col("anchor") - F.col("o1") + length).alias("end"))
    return scratch.write(whole.union(part), "ranges")


def merge_ranges(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of rows (start, end) of byte ranges."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    end = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > end[:-1]])
    first = np.flatnonzero(new)
    return np.stack([ranges[first, 0], end[np.concatenate([first[1:], [len(ranges)]]) - 1]], axis=1)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` of every row: removed byte ranges as structs (start, end), remaining bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    ranges = repeated_ranges(docs, scratch, id_col=id_col, text_col=text_col, length=length)
    gathered = ranges.distinct().groupBy(*KEY).agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))
    joined = _keyed(docs, id_col, text_col).join(gathered, KEY, "left").select("id", "text", "s", "e")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, kept = [], [], [], []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = text.as_buffer().to_pybytes()
                cut = np.empty((0, 2), np.int64)
                if s.is_valid and len(s):
                    cut = merge_ranges(np.stack([s.values.to_numpy(), e.values.to_numpy()], axis=1))
                at, rest = 0, []
                for x, y in cut.tolist():
                    rest.append(data[at:x])
                    at = y
                rest.append(data[at:])
                size.append(len(data)), removed.append(int((cut[:, 1] - cut[:, 0]).sum())), kept.append(b"".join(rest))
                spans.append([{"start": x, "end": y} for x, y in cut.tolist()])
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_removed", "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(run, T.StructType(fields))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=LENGTH)
    digest = F.lower(F.sha2("kept", 256)).alias("kept_sha256")
    # a removed range may begin inside a character; the text shows what is left of such a character as U+FFFD
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), digest, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
