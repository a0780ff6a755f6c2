"""Dense vectors: exact cosine search of a query table against all vectors, in blocks of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top
from .sizes import BROADCAST_BYTES

#: Vectors and queries that are compared in one block: a product of two matrices that fit in a few megabytes.
VECTORS, QUERIES = 4096, 512
def packed(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(ids, m) blocks of up to ``size`` vectors: their ids, and their unit-length rows as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = np.array(part.column(1).to_pylist(), np.float64)
                length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary())], names=["ids", "m"])

    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "ids array<long>, m binary")


def nearest(pairs: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(query_id, doc_id, score): of each pair of blocks (ids, m, qids, qm) the k best vectors of every query by cosine to 6 digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids = np.array(row["ids"], np.int64), np.array(row["qids"], np.int64)
                a, q = (np.frombuffer(row[c]).reshape(len(n), -1) for c, n in (("m", ids), ("qm", qids)))
                cos = np.round(q @ a.T, 6)
                if not own:
                    cos[qids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :k]
                best = np.take_along_axis(cos, order, axis=1)
                real = np.isfinite(best)
                cols = [np.repeat(qids, real.sum(axis=1)), ids[order][real], best[real]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "doc_id", "score"])

    return pairs.select("ids", "m", "qids", "qm").mapInArrow(run, "query_id long, doc_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", keep: Column | None = None, floor: float | None = None, own: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest by cosine to 6 digits, ties by id, a vector of the query's own id left out
    unless ``own``.

    The stated query set meets all vectors block by block in one scan: a pair of blocks is one matrix product, and
    each pair's best are cut before anything else moves. The queries are broadcast if their bytes allow it. ``keep`` filters vectors before they are
    ranked, ``floor`` drops scores after. Vectors of no length score zero."""
    base = vectors if keep is None else vectors.where(keep)
    asked = packed(queries, id_col, vec_col, QUERIES).withColumnsRenamed({"ids": "qids", "m": "qm"})
    # the bytes of the query vectors as they will be packed, from one pass over the queries
    width = queries.agg(F.sum(F.size(vec_col) * 8 + 8)).first()[0] or 0
    pairs = packed(base, id_col, vec_col, VECTORS).crossJoin(F.broadcast(asked) if width <= BROADCAST_BYTES else asked)
    out = top(nearest(pairs, k, own), k)
    return out if floor is None else out.where(F.col("score") >= floor)
