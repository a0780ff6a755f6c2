"""One stream from files to an index: records, chunks, vectors, rows of a table of committed batches.

Ids that come again within ``expiry`` are dropped by keyed state, before anything is chunked or embedded; the state of an id goes when the watermark has passed
it, so it does not grow for ever. An id that comes again later finds its chunks in the table and adds nothing. A batch's name is the checkpoint's and its number, so a batch that
runs again after a crash, between whichever stages, is in the table once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import models as M
from ..operators import records as R
from ..operators.chunks import chunk
from ..sources.commits import append_batch
from ..sources.sinks import written


def fresh(docs: DataFrame, at: str, expiry: str, key: str = "doc_id") -> DataFrame:
    """Rows of a stream whose key was not seen within expiry of their time ``at``. Rows later than the watermark are dropped by it, not stored for ever."""
    return docs.withWatermark(at, expiry).dropDuplicatesWithinWatermark([key])


def index_rows(docs: DataFrame, name: str, factory: Callable[[], M.Model], **how) -> DataFrame:
    """``(id, doc_id, chunk_index, total_chunks, text, category, vector, vector_rejected)`` of documents: what a batch adds to the index."""
    rows = R.unified(docs)
    parts = chunk(rows, "id", "text")
    both = parts.join(rows.select(F.col("id").alias("doc"), "doc_id", "category"), "doc")
    whole = both.select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", "total_chunks", "text", "category")
    return M.call(whole, "text", name, factory, T.ArrayType(T.DoubleType()), out="vector", **how)


def ingest_index(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, *, name: str = "hashed vectors", factory: Callable[[], M.Model] = M.HashedVectors, at: str = "arrived", expiry: str = "1 day", files: int | None = None, **how) -> None:
    """All files of source not seen yet (``files`` a batch), to the end. ``at`` is the column of a row's time; where the schema has none, it is the file's.

    Rows that the model refuses are in the table without a vector and with the reason."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    docs = reader.parquet(source)
    if at not in docs.columns:
        docs = docs.withColumn(at, F.col("_metadata.file_modification_time"))

    def add(batch: DataFrame, n: int) -> None:
        # the model is asked once: what it said is written before rows are counted and appended
        append_batch(written(index_rows(batch, name, factory, **how), "index-rows"), target, f"{checkpoint}#{n}")

    query = fresh(docs, at, expiry).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
