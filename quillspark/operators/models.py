"""Models behind a network or on a device, called from the tasks: one client a worker, requests bounded by rows and characters, rejected rows as rows.

``call`` sends distinct inputs once (by 128 bits of their hash) and gives every row its output or the reason why there is none. A request that fails in passing is
tried again after a random pause that doubles; one that fails for good is sent in halves until the inputs at fault are alone. Blank inputs are not sent.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.vector_sink import Passing
from ..sources.sinks import written

#: Inputs of a request and their characters, together; a single input may have more.
ROWS, CHARACTERS = 128, 1_200_000
TRIES, PAUSE = 5, 0.5

#: Clients of a worker process, by the name that the caller gives them.
_CLIENTS: dict[str, Model] = {}


class Model(Protocol):
    """Outputs in the order of the inputs; ``Passing`` for what may go well later."""

    def __call__(self, inputs: list[str]) -> list: ...


def requests(inputs: list[str], rows: int, characters: int) -> Iterator[list[str]]:
    """Inputs in order, in as few requests as they fit in greedily."""
    held, size = [], 0
    for x in inputs:
        if held and (len(held) == rows or size + len(x) > characters):
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def answers(model: Model, inputs: list[str], tries: int = TRIES, pause: float = PAUSE, rest: Callable[[float], None] = time.sleep) -> list[tuple[object, str | None]]:
    """``(output, None)`` or ``(None, reason)`` for each input."""
    reason = ""
    for k in range(tries):
        try:
            got = model(inputs)
            if len(got) != len(inputs):
                raise ValueError(f"{len(got)} outputs for {len(inputs)} inputs")
            return [(x, None) for x in got]
        except Passing as e:
            reason = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                rest(random.uniform(0, pause * 2**k))
        except Exception as e:  # whatever the model does not take
            if len(inputs) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(inputs) // 2
            return answers(model, inputs[:half], tries, pause, rest) + answers(model, inputs[half:], tries, pause, rest)
    return [(None, reason)] * len(inputs)


def call(docs: DataFrame, text_col: str, name: str, factory: Callable[[], Model], kind: T.DataType, *, out: str = "output", rows: int = ROWS, characters: int = CHARACTERS, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """docs with ``out`` (of the type kind) and ``<out>_rejected``: why a row has none (``blank``, or what the model said). Columns of docs with these names give way.

    ``name`` names the client in a worker: one is made by ``factory()`` and kept for all tasks of the process. Each distinct text is sent once, wherever its rows are."""
    failed = f"{out}_rejected"
    docs = docs.drop(out, failed)
    key = F.unhex(F.md5(F.col(text_col)))
    blank = F.coalesce(F.trim(text_col), F.lit("")) == ""
    unique = docs.where(~blank).select(key.alias("__key"), F.col(text_col).alias("text")).groupBy("__key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        if name not in _CLIENTS:
            _CLIENTS[name] = factory()
        for batch in batches:
            got = [a for part in requests(batch.column(1).to_pylist(), rows, characters) for a in answers(_CLIENTS[name], part, tries, pause)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], to_arrow_type(kind)), pa.array([why for _, why in got], pa.string())], names=["__key", out, failed])

    made = written(unique.mapInArrow(run, T.StructType([T.StructField("__key", T.BinaryType()), T.StructField(out, kind), T.StructField(failed, T.StringType())])), "outputs")
    # blank rows have a key of their own each, so they do not meet in one task
    keyed = docs.withColumn("__key", F.when(blank, F.lit(None)).otherwise(key))
    done = keyed.where(~blank).join(made, "__key").drop("__key")
    return done.unionByName(keyed.where(blank).drop("__key").withColumn(out, F.lit(None).cast(kind)).withColumn(failed, F.lit("blank")))


def rejected(done: DataFrame, out: str = "output") -> DataFrame:
    """``(reason, n)`` of the rows without an output."""
    return done.where(F.col(f"{out}_rejected").isNotNull()).groupBy(F.col(f"{out}_rejected").alias("reason")).agg(F.count("*").alias("n"))


class HashedVectors:
    """The deterministic default embedder as a model: unit-length signed sums of hashed words, the same numbers as ``plugins.hashed_embedding``."""

    def __init__(self, dims: int = 64, seed: int = 7):
        self.dims, self.seed, self.known = dims, seed, {}

    def word(self, w: str) -> tuple[int, float]:
        import struct

        import xxhash

        if w not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            own = xxhash.xxh64_intdigest(w.encode(), 42)
            # a second column is hashed with the hash before as its seed
            place, sign = (np.int64(np.uint64(xxhash.xxh64_intdigest(struct.pack("<i", s), own))) for s in (self.seed, self.seed + 1))
            self.known[w] = int(place) % self.dims, 1.0 if int(sign) % 2 == 0 else -1.0
        return self.known[w]

    def __call__(self, inputs: list[str]) -> list[list[float]]:
        import regex

        out = []
        for text in inputs:
            v = np.zeros(self.dims)
            words = [self.word(w) for w in regex.findall(r"[\p{L}\p{N}_]+", text.lower()) if len(w) >= 2]
            if words:
                place, sign = zip(*words)
                np.add.at(v, list(place), sign)
                if not v.any():  # words that cancel out are counted without their signs
                    np.add.at(v, list(place), 1.0)
            length = np.sqrt((v * v).sum())
            out.append((v / length if length > 0 else v).tolist())
        return out
