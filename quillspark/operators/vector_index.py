"""Inverted lists of vectors: k-means centroids, one list a centroid, search of the lists nearest to a query.

Centroids are fitted by rounds over a bounded hash sample (``PER_LIST`` vectors a list); every vector is then put in the list of its nearest
centroid. A list is stored as blocks of up to ``VECTORS`` vectors, so a list with a third of all vectors is many rows. A query
meets the blocks of its ``probes`` nearest lists only, by a join on the list, and what it meets is ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written
from .dense import QUERIES, VECTORS, nearest
from .dense import search as search_all
from .lexical import top
from .sizes import checked_broadcast

#: Sampled vectors for each list, rounds of k-means at most, and the share of sampled vectors that may still move when the rounds end.
PER_LIST, ROUNDS, SETTLED = 256, 12, 0.002
#: Tasks that the vectors of one list are dealt to.
SPREAD = 32
#: Bytes of centroids that are sent to every task.
CENTROID_BYTES = 64 << 20


@dataclass(frozen=True)
class VectorIndex:
    """``lists(list, n, ids, m)``: blocks of unit vectors; centroids as unit rows, sent with the tasks (size checked)."""

    lists: DataFrame
    centroids: np.ndarray


def _unit(column: pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _near(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    return np.argsort(-(rows @ centroids.T), axis=1, kind="stable")[:, :n]


def fit(vectors: DataFrame, lists: int, *, id_col: str, vec_col: str) -> np.ndarray:
    """Unit centroids of a hash sample of about PER_LIST * lists vectors. Rounds assign in the tasks and sum by centroid in Spark; the driver
    holds the centroids only."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), F.lit("vector sample")).alias("h"), F.col(vec_col).cast("array<double>").alias("v"))
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    share = PER_LIST * lists / total
    sample = written(rows.where(F.col("h") <= int((2 * share - 1) * 2**63)) if share < 1 else rows, "sample").select("h", "v")
    first = sample.orderBy("h").limit(lists).select("v")  # a bounded set: one vector a list
    centroids = _unit(pa.array([r.v for r in first.collect()]))
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError("so many lists do not fit in a task; take fewer")
    moved = None
    for _ in range(ROUNDS):
        state = (centroids, moved)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, before = state
            sums, counts, changed = np.zeros_like(now), np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                v = _unit(batch.column(1))
                own = _near(v, now, 1)[:, 0]
                np.add.at(sums, own, v)
                counts += np.bincount(own, minlength=len(now))
                if before is not None:
                    changed += np.bincount(own, weights=_near(v, before, 1)[:, 0] != own, minlength=len(now)).astype(np.int64)
            has = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has]), pa.array(changed[has]), pa.array(list(sums[has]), pa.list_(pa.float64()))], names=["list", "n", "changed", "sum"])

        parts = sample.mapInArrow(assign, "list int, n long, changed long, sum array<double>")
        each = parts.select("list", "n", "changed", F.posexplode("sum").alias("k", "x")).groupBy("list", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("changed").alias("c"))
        new = each.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v"), F.first("n").alias("n"), F.first("c").alias("c")).collect()  # a row a list
        moved, centroids = centroids, centroids.copy()
        for r in new:
            mean = np.array([x.x for x in r.v])
            centroids[r.list] = mean / max(np.sqrt(mean @ mean), 1e-12)
        if state[1] is not None and sum(r.c for r in new) <= SETTLED * sum(r.n for r in new):
            break
    return centroids


def build(vectors: DataFrame, *, lists: int, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """Every vector in the list of its nearest centroid, written; null vectors are left out."""
    centroids = fit(vectors, lists, id_col=id_col, vec_col=vec_col)
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    # a list of many vectors is dealt to several tasks; in each, rows of one list follow each other
    dealt = _assigned(rows, centroids, 1).repartition("list", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("list", "id")
    return VectorIndex(written(_packed(dealt, VECTORS), "lists"), centroids)


def _assigned(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """rows(id, v) as ``(list, id, v)``, one for each of the n nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(centroids) and batch.num_rows:
                near = _near(_unit(batch.column(1)), centroids, n)
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "id", "v"])

    return rows.mapInArrow(run, "list int, id long, v array<double>")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks ``(list, n, ids, m)`` of rows(list, id, v) that are sorted by list in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ids, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unit(batch.column(2))
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
            cuts = [(x, min(x + size, b)) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(of)]) for x in range(a, b, size)]
            yield pa.RecordBatch.from_arrays([pa.array([int(of[a]) for a, _ in cuts], pa.int32()), pa.array([b - a for a, b in cuts], pa.int64()), pa.array([ids[a:b] for a, b in cuts], pa.list_(pa.int64())), pa.array([unit[a:b].tobytes() for a, b in cuts], pa.binary())], names=["list", "n", "ids", "m"])

    return rows.select("list", "id", "v").mapInArrow(run, "list int, n long, ids array<long>, m binary")


def search(index: VectorIndex, queries: DataFrame, k: int, *, probes: int, id_col: str = "vec_id", vec_col: str = "embedding", own: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best by cosine among the vectors of each query's nearest lists, with all lists as probes the exact ones.
    Blocks of queries and of vectors meet by list: one matrix product each, cut to its best before the last shuffle."""
    pairs = probed(index, queries, probes=probes, id_col=id_col, vec_col=vec_col)
    return top(nearest(pairs, k, own), k)


def probed(index: VectorIndex, queries: DataFrame, *, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Pairs of blocks ``(ids, m, qids, qm)`` that the queries meet."""
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    blocks = _packed(_assigned(asked, index.centroids, probes).repartition("list").sortWithinPartitions("list", "id"), QUERIES)
    blocks = written(blocks, "asked").select("list", F.col("ids").alias("qids"), F.col("m").alias("qm"))
    return index.lists.join(checked_broadcast(blocks), "list")


def work(index: VectorIndex, queries: DataFrame, *, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: comparisons that a search makes, and those of a search of all vectors."""
    met = probed(index, queries, probes=probes, id_col=id_col, vec_col=vec_col).agg(F.coalesce(F.sum(F.col("n") * F.size("qids")), F.lit(0)).alias("compared"))
    every = index.lists.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))
    asked = queries.agg(F.count(vec_col).alias("asked"))
    return met.crossJoin(every).crossJoin(asked).select("compared", (F.col("vectors") * F.col("asked")).alias("all_pairs"))  # one row each


def calibrated(index: VectorIndex, vectors: DataFrame, k: int, *, target: float = 0.97, sample: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
    """The fewest probes that find the target share of the k exact neighbours of ``sample`` hash-sampled vectors: for each neighbour, how many of its
    query's nearest lists must be read until its own. One exact search of the sample; the driver sees its neighbours only."""
    asked = vectors.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit("probe sample"))).limit(sample)
    asked = written(asked.select(F.col(id_col).cast("long").alias(id_col), vec_col), "probe-sample")
    exact = search_all(vectors, asked, k, id_col=id_col, vec_col=vec_col)
    homes = index.lists.select("list", F.explode("ids").alias("doc_id"))
    pairs = homes.join(F.broadcast(exact.select("query_id", "doc_id")), "doc_id").select("query_id", "list").collect()  # sample * k rows
    by_id = {r[0]: r[1] for r in asked.collect()}
    if not pairs:
        return 1
    names = sorted(by_id)
    order = _near(_unit(pa.array([by_id[n] for n in names])), index.centroids, len(index.centroids))
    place = {n: np.argsort(order[x]) for x, n in enumerate(names)}
    needed = np.sort([int(place[r.query_id][r.list]) + 1 for r in pairs])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of each query's exact neighbours that were found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def stats(vectors: DataFrame, namespace: Column, vec_col: str = "embedding") -> DataFrame:
    """``(namespace, vectors, dimension, empty)``: what an index would hold of each namespace."""
    return vectors.groupBy(namespace.alias("namespace")).agg(F.count(vec_col).alias("vectors"), F.max(F.size(vec_col)).alias("dimension"), F.count_if(F.col(vec_col).isNull()).alias("empty"))
