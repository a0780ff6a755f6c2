"""SimHash near-duplicates by tiled exact comparison.

Plan: (1) one pass over the texts makes fingerprints; (2) equal fingerprints (or equal texts)
collapse to one representative; (3) representatives are dealt into cells by population counts,
cells are cut into tiles of a bounded size, and only tiles whose population counts can lie
within the radius meet: a tile travels once to each band of SPAN tiles of its partners, not once to
each of them; (4) band and tile are compared exactly with numpy exclusive-or and
bit counts and yield a spanning forest of their links, never all pairs; (5) the forests are joined
to components by star contraction.

Defined results: null and blank texts have fingerprint zero and link like any other; repeated
rows and ties share a class; an empty table gives an empty result; columns other than the named
id and text columns are never read by the fingerprint operators.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, text_key

#: Shingles whose bits are counted at a time: bounds memory for very long texts.
BLOCK = 1 << 15
#: Most fingerprints in a tile, on average; a tile pair holds at most its square in memory, a slice at a time.
TILE = 2048
SLICE = 256
#: Tiles in a band: tiles are shuffled that many times less often than they are compared.
SPAN = 8
#: Hashes in a tile that carries whole sets, about.
SET_TILE = 1 << 20
#: Columns of the further words of wide fingerprints.
MORE = ["fp2", "fp3", "fp4"]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of the A-Z-lowered text, repeats included; a text of fewer words is one shingle."""
    if text is None:
        return np.empty(0, np.uint64)
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start, n = (end - size)[: len(w) - words + 1].tolist(), len(w) - words + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist())), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes, as a signed long."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK]).astype("<u8", copy=False)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _further(h: np.ndarray) -> np.ndarray:
    """Another 64 hash bits from the ones before, by a bijective mixer."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, wide: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: the id, ``fp`` (if wide, of the set of shingles, with 192 further bits in ``more``), ``size`` (shingles) and the columns in keep."""

    names = ["fp", "size", *MORE * wide]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, more, size = [], [[], [], []], []
            for text in batch.column(0):
                h = shingle_hashes(text.as_py(), words)
                if wide:
                    h = np.unique(h)
                fp.append(majority_bits(h))
                size.append(len(h))
                for words_of in more if wide else ():
                    h = _further(h)
                    words_of.append(majority_bits(h))
            cols = [pa.array(x, pa.int64()) for x in (fp, size, *(more if wide else ()))] + list(batch.columns[1:])
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *batch.schema.names[1:]])

    source = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias(id_col), *[c.alias(k) for k, c in (keep or {}).items()])
    schema = T.StructType([*(T.StructField(k, T.LongType()) for k in names), *source.schema.fields[1:]])
    return source.mapInArrow(run, schema)


def _unpack(col: pa.Array) -> list:
    """Arrays of a list column; lists of arrays of a list of lists."""
    values = _unpack(col.values) if pa.types.is_list(col.values.type) else col.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in itertools.pairwise(col.offsets.to_numpy())]


def similar_links(i: np.ndarray, j: np.ndarray, d: np.ndarray, shift: int, left: list[np.ndarray], right: list[np.ndarray], n: int, bound: float) -> np.ndarray:
    """Positions of links that span what the pairs of sets with Jaccard similarity of bound or more connect.

    Each left set in turn meets its nearest candidates that are not yet in its group, in doubling
    portions, so a large group of copies is soon one and its other pairs are passed over."""
    label, chosen = np.arange(n), []
    order = np.lexsort((d, i))
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own, portion = left[i[part[0]]], 4
        while len(part):
            part = part[label[i[part]] != label[j[part] + shift]]
            now, part, portion = part[:portion], part[portion:], portion * 2
            if not len(now):
                break
            sets = [right[k] for k in j[now].tolist()]
            sizes = np.array([len(s) for s in sets])
            pool = np.concatenate(sets)
            at = np.minimum(np.searchsorted(own, pool), len(own) - 1) if len(own) else np.zeros(len(pool), np.int64)
            hit = np.concatenate([[0], np.cumsum(own[at] == pool if len(own) else np.zeros(len(pool), bool))])
            ends = np.cumsum(sizes)
            both = hit[ends] - hit[ends - sizes]
            for k in now[both >= bound * (len(own) + sizes - both)].tolist():
                a, b = label[i[k]], label[j[k] + shift]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    chosen.append(k)
    return np.array(chosen, np.int64)


def _links(a: dict, b: dict | None, first: int, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in a, positions in b and distances of all links between two tiles, or within one (b None)."""
    ii, jj, dd = [], [], []
    other = b or a
    rows = max(8, SLICE * TILE // max(1, len(other["fp"])))
    for at in range(0, len(a["fp"]), rows):
        d = np.bitwise_count(a["fp"][at : at + rows, None] ^ other["fp"][None, :])
        i, j = np.nonzero(d <= first)
        d = d[i, j].astype(np.int16)
        i = i + at
        if b is None:
            up = j > i
            i, j, d = i[up], j[up], d[up]
        if "fp2" in a and len(i):
            for word in MORE:
                d = d + np.bitwise_count(a[word][i] ^ other[word][j])
            near = d <= radius
            i, j, d = i[near], j[near], d[near]
        if ratio and len(i):
            s, t = a["size"][i], other["size"][j]
            near = np.minimum(s, t) >= ratio * np.maximum(s, t)
            i, j, d = i[near], j[near], d[near]
        if "label" in a and len(i):
            apart = a["label"][i] != other["label"][j]
            i, j, d = i[apart], j[apart], d[apart]
        ii.append(i), jj.append(j), dd.append(d)
    return np.concatenate(ii), np.concatenate(jj), np.concatenate(dd)


def spanning_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that span what all links connect, the lightest first (Borůvka's rounds on arrays)."""
    if len(u) <= 1:
        return np.arange(len(u))
    order = np.argsort(weight, kind="stable")
    u, v, label, chosen = u[order], v[order], np.arange(n), []
    left = np.arange(len(u))
    while len(left):
        lu, lv = label[u[left]], label[v[left]]
        keep = lu != lv
        left, lu, lv = left[keep], lu[keep], lv[keep]
        if not len(left):
            break
        first = np.full(n, len(u))
        np.minimum.at(first, lu, left)
        np.minimum.at(first, lv, left)
        pick = np.unique(first[first < len(u)])
        chosen.append(pick)
        pu, pv = u[pick], v[pick]
        while True:  # hook the picked links until every label is settled
            a, b = label[pu], label[pv]
            if (a == b).all():
                break
            hook = np.arange(n)
            np.minimum.at(hook, np.maximum(a, b), np.minimum(a, b))
            while (hook[hook] != hook).any():
                hook = hook[hook]
            label = hook[label]
    return order[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)


def tiled_links(spark: SparkSession, reps: DataFrame, scratch: Scratch, radius: int, *, first: int | None = None, ratio: float = 0.0, wide: bool = False, labels: bool = False, give: str = "forest") -> DataFrame:
    """Links ``(a, b)`` of nodes among ``reps(node, fp[, size, fp2, fp3, fp4][, label])`` at up to radius
    differing bits, and up to ``first`` in the first word.

    Small radii (no ratio): a cell is the population counts of the four 16-bit quarters, and two
    cells can hold a link only if these counts differ by radius or less in sum. With a ratio,
    the fingerprints are of sets whose sizes must lie within it, and a cell is a band of set
    sizes; links lie in one band or the next. ``labels``: skip pairs of one label. ``give``:
    "forest" a spanning forest of each tile pair's links; "nodes" every node that has a link, as
    (node, node); "similar" reps carry the sorted ``hashes`` of their sets, links are held to the
    ratio as exact Jaccard similarity, and a spanning forest of those that reach it is given.
    """
    with_sets = give == "similar"
    fields, first = ["node", "fp", *["size", *MORE] * wide, *["label"] * labels, *["hashes"] * with_sets], radius if first is None else first
    if ratio:
        band = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.log(F.lit(1 / ratio)))
        cell, steps = band.cast("long"), [0, 1]
    else:
        quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("long") for k in range(4)]
        cell = quarter[0] + quarter[1] * 64 + quarter[2] * 4096 + quarter[3] * 262144
        span = range(-radius, radius + 1)
        steps = [a + b * 64 + c * 4096 + d * 262144 for a, b, c, d in itertools.product(span, repeat=4) if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
        steps = sorted(s for s in steps if s >= 0)
    reps = reps.withColumn("cell", cell)
    # At most 17^4 cells by population counts, or one per band of sizes: bounded whatever the input.
    held = F.ceil(F.count("*") / TILE)
    blocks = reps.groupBy("cell").agg((F.greatest(held, F.ceil(F.sum("size") / SET_TILE)) if with_sets else held).alias("blocks"))
    dealt = reps.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    tiles = scratch.write(dealt.groupBy("cell", "block").agg(*[F.collect_list(c).alias(c) for c in fields]), "tiles")
    span = 1 if with_sets else SPAN
    bands = tiles.groupBy("cell", F.floor(F.col("block") / span).alias("band")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in fields])
    bands = scratch.write(bands.select("cell", "band", F.struct(*fields).alias("x")), "bands")
    left = bands.select(F.col("cell").alias("ca"), F.col("band").alias("ga"), F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"))
    right = tiles.select(F.col("cell").alias("cb"), F.col("block").alias("kb"))
    pairs = left.join(right, F.col("ca") + F.col("step") == F.col("cb")).where(f"ca != cb or ga < floor(kb / {span})").select("ca", "ga", "cb", "kb")
    met = pairs.join(tiles.select(F.col("cell").alias("cb"), F.col("block").alias("kb"), F.struct(*fields).alias("y")), ["cb", "kb"])
    joined = met.join(bands.withColumnsRenamed({"cell": "ca", "band": "ga"}), ["ca", "ga"]).select(F.lit(False).alias("own"), "x", "y")
    nothing = F.struct(*[F.array().cast(tiles.schema[f].dataType).alias(f) for f in fields])
    joined = joined.union(bands.select(F.lit(True), "x", nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            x, y = ({f: _unpack(c.field(f)) for f in fields} for c in (batch.column(1), batch.column(2)))
            out_a, out_b = [], []
            for k, same in enumerate(own):
                p, q = ({f: v[k] for f, v in side.items()} for side in (x, y))
                for side in (p, q):
                    side["fp"] = side["fp"].view(np.uint64)
                    for word in MORE * wide:
                        side[word] = side[word].view(np.uint64)
                i, j, d = _links(p, None if same else q, first, radius, ratio)
                if not len(i):
                    continue
                other = p if same else q
                if give == "nodes":
                    seen = np.unique(np.concatenate([p["node"][i], other["node"][j]]))
                    out_a.append(seen), out_b.append(seen)
                    continue
                shift = 0 if same else len(p["fp"])
                if with_sets:
                    f = similar_links(i, j, d, shift, p["hashes"], other["hashes"], len(p["fp"]) + (0 if same else len(q["fp"])), ratio)
                else:
                    f = spanning_forest(i, j + shift, d, len(p["fp"]) + (0 if same else len(q["fp"])))
                out_a.append(p["node"][i[f]]), out_b.append(other["node"][j[f]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fp, component)`` for every row: documents whose fingerprints differ in radius bits or
    fewer are linked; the component is the smallest id that links reach."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    marked = scratch.write(fingerprints(docs, id_col, text_col, words).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    reps = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("first")), "representatives")
    links = tiled_links(spark, reps.select(F.col("fp").alias("node"), "fp"), scratch, radius)
    parts = connected_components(spark, links, scratch)
    named = reps.join(parts, reps.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    names = named.join(lowest, "component").select("fp", F.col("lowest").alias("component"))
    return marked.join(names, "fp").select("id", "fp", "component")


# ---- near-duplicate removal by verified similarity ---------------------------------------

#: Differing bits of 256, and of the first 64, up to which texts are candidates. Shingle sets of similarity
#: 0.8 are 39 bits apart on average with a deviation of 5.7 (the smallest sets 48 and 6.2), unrelated ones 128 with 8:
#: the bounds leave five deviations on one side and seven on the other. Candidates are then compared exactly.
CANDIDATE_BITS, FIRST_BITS = 68, 24
#: Rows of ids up to which they are broadcast to a filter of the texts; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _similar(spark: SparkSession, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs with ``ok``: whether the Jaccard similarity of their shingle sets reaches the bound."""
    x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", (both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).alias("ok"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t.as_py(), words).view(np.int64)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "hashes"])

    return docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("t")).mapInArrow(run, "node long, hashes array<long>")


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, bits: int = CANDIDATE_BITS, first: int = FIRST_BITS) -> tuple[DataFrame, DataFrame]:
    """``(key, id)`` of all rows, and ``(key, id, keep)`` for each distinct text: whether its lowest id is the one
    that its group of near-duplicates keeps.

    Texts are linked if the Jaccard similarity of their word shingles reaches the bound (256-bit
    SimHash tiles find the candidates, an exact comparison decides); groups are what links
    connect; the smallest id of a group stays. Texts without a word, nulls included, are one group; texts whose
    rows all have a null id are compared for equality only. First only a spanning forest of each
    tile pair's candidates is compared; then the nodes with candidates still in two groups meet again
    tile by tile with their whole sets, and each such pair is decided there or passed over because its
    group is already one: no row is made for a pair, and no candidate is left undecided.
    """
    spark = docs.sparkSession
    made = fingerprints(docs, id_col, text_col, words, wide=True, keep={"key": text_key(F.col(text_col))}).withColumnRenamed(id_col, "id")
    rows = scratch.write(made, "rows")
    marked = scratch.write(rows.groupBy("key").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in ("fp", "size", *MORE)]), "representatives")
    reps = marked.where("id is not null").select(F.col("id").alias("node"), "fp", "size", *MORE, "key")
    small, how = reps.drop("key"), {"first": first, "ratio": similarity, "wide": True}
    found = scratch.write(tiled_links(spark, small, scratch, bits, **how).distinct(), "candidates")

    def sets_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps.select("node", "key"), "node")
        needed = _small(scratch.write(needed.select(F.col("node").alias("__node"), F.col("key").alias("__key")), "needed"))
        texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("t")).withColumn("key", text_key(F.col("t")))
        texts = texts.join(needed, (F.col("node") == F.col("__node")) & (F.col("key") == F.col("__key")), "left_semi")
        return scratch.write(shingle_sets(texts, "node", "t", words).groupBy("node").agg(F.min("hashes").alias("hashes")), "sets")

    sets = sets_of(found)
    judged = scratch.write(_similar(spark, found, sets, similarity), "judged")
    linked = judged.where("ok").select("a", "b")
    parts = scratch.write(connected_components(spark, linked, scratch), "parts")
    labelled = small.join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    # candidates that the forest left in two groups: their nodes come together again with their whole sets
    open_nodes = scratch.write(tiled_links(spark, labelled, scratch, bits, labels=True, give="nodes", **how).select(F.col("a").alias("node")).distinct(), "open")
    open_sets = sets_of(open_nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    carried = labelled.join(open_sets, "node")
    more = scratch.write(tiled_links(spark, carried, scratch, bits, labels=True, give="similar", **how), "more")
    settled = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = parts if more.isEmpty() else connected_components(spark, settled.union(more), scratch)
    scratch.drop(sets, open_sets)
    named = marked.join(final, marked.id == final.node, "left")
    return rows.select("key", "id"), named.select("key", "id", F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: all columns as they came."""
    scratch = Scratch(docs.sparkSession, "neardup")
    rows, kept = near_duplicates(docs, scratch, id_col, text_col, **how)
    kept = kept.select("key", F.col("id").alias("__kept"), "keep")
    gone = rows.join(kept, "key").where(~(F.col("keep") & F.col("id").eqNullSafe(F.col("__kept"))))
    gone = _small(scratch.write(gone.select(F.col("key").alias("__gone"), F.col("id").alias("__id")).distinct(), "gone"))
    keyed = docs.withColumn("__key", text_key(F.col(text_col)))
    left = keyed.join(gone, (F.col("__key") == F.col("__gone")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
    if not rows.groupBy("key", "id").count().where("count > 1").isEmpty():
        left = left.dropDuplicates([id_col, "__key"])  # rows that repeat both id and text are one document
    return left.drop("__key")


# ---- registered query --------------------------------------------------------------------


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = simhash_components(docs, "doc_id", "text", words=3, radius=3)
    return done.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
