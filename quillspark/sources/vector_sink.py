"""A Spark data source that writes rows to a vector service: bounded parallel requests, retries, rejected rows, counters.

``spark.dataSource.register(vector_sink("name", factory))`` and then ``df.write.format("name").option(...).mode("append").save()``. The frame has ``id``, ``vector`` and
any other columns, which are sent as metadata. Each task opens one client and keeps at most ``inFlight`` requests of ``rows`` rows open: it
takes no further rows from Spark while they are (back-pressure). A request that fails in passing (``Passing``) is sent again after a random pause
that doubles; one that fails for good is sent in halves until the rows at fault are alone, and these are rejected. Upserts are by id, so a task that runs again changes nothing.

Options: ``rows`` (100), ``inFlight`` (4), ``tries`` (5), ``pause`` (0.2 seconds), ``report`` (a folder: rejected rows as JSON lines of each task, and
the counters of the whole write, once it has ended or was given up).
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


class Passing(Exception):
    """A failure that may not come again: too many requests, a lost connection."""


class Client(Protocol):
    def upsert(self, rows: list[dict]) -> None: ...


@dataclass
class Counters(WriterCommitMessage):
    upserted: int = 0
    rejected: int = 0
    requests: int = 0
    retries: int = 0
    most_in_flight: int = 0

    def __add__(self, other: Counters) -> Counters:
        most = max(self.most_in_flight, other.most_in_flight)
        return Counters(self.upserted + other.upserted, self.rejected + other.rejected, self.requests + other.requests, self.retries + other.retries, most)


def _store(folder: str, name: str, text: str) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(part := f"{base}/.{uuid.uuid4().hex}") as out:
        out.write(text.encode())
    store.move(part, f"{base}/{name}")


def send(client: Client, rows: list[dict], tries: int, pause: float, rest: Callable[[float], None] = time.sleep) -> tuple[Counters, list[tuple[dict, str]]]:
    """One request to its end: what came of it, and the rows rejected with the reason."""
    done = Counters()
    for k in range(tries):
        done.requests += 1
        try:
            client.upsert(rows)
            done.upserted += len(rows)
            return done, []
        except Passing as e:
            reason = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                done.retries += 1
                rest(random.uniform(0, pause * 2**k))
        except Exception as e:  # the service does not take it, whatever its reason
            if len(rows) == 1:
                done.rejected += 1
                return done, [(rows[0], f"{type(e).__name__}: {e}")]
            half = len(rows) // 2
            (a, bad), (b, worse) = (send(client, part, tries, pause, rest) for part in (rows[:half], rows[half:]))
            return done + a + b, bad + worse
    done.rejected += len(rows)
    return done, [(r, reason) for r in rows]


def send_all(client: Client, rows: Iterator[dict], *, size: int, in_flight: int, tries: int, pause: float) -> tuple[Counters, list[tuple[dict, str]]]:
    """All rows, at most in_flight requests at a time."""
    total, bad = Counters(), []
    waiting: set[Future] = set()

    def take(done: set[Future]) -> None:
        nonlocal total
        for f in done:
            counted, rejected = f.result()
            total += counted
            bad.extend(rejected)

    def batches() -> Iterator[list[dict]]:
        held: list[dict] = []
        for r in rows:
            held.append(r)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    with ThreadPoolExecutor(in_flight) as pool:
        for batch in batches():
            if len(waiting) >= in_flight:
                done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                take(done)
            waiting.add(pool.submit(send, client, batch, tries, pause))
            total.most_in_flight = max(total.most_in_flight, len(waiting))
        take(waiting)
    return total, bad


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], factory: Callable[[], Client]):
        get = lambda name, default: type(default)(options.get(name, options.get(name.lower(), default)))
        self.size, self.in_flight, self.tries, self.pause, self.report, self.factory = get("rows", 100), get("inFlight", 4), get("tries", 5), get("pause", 0.2), get("report", ""), factory

    def write(self, iterator) -> Counters:
        from pyspark import TaskContext

        done, bad = send_all(self.factory(), (r.asDict(True) for r in iterator), size=self.size, in_flight=self.in_flight, tries=self.tries, pause=self.pause)
        if bad and self.report:  # by partition: a task that runs again replaces its own
            _store(self.report, f"rejected-{TaskContext.get().partitionId():06d}.json", "".join(json.dumps({"id": r.get("id"), "reason": why}) + "\n" for r, why in bad))
        return done

    def _tell(self, messages, status: str) -> None:
        if self.report:
            total = sum((m for m in messages if m is not None), Counters())
            _store(self.report, "counters.json", json.dumps({"status": status, "tasks": sum(m is not None for m in messages)} | asdict(total)))

    def commit(self, messages) -> None:
        self._tell(messages, "completed")

    def abort(self, messages) -> None:
        """Some task failed for good. What others upserted stays, by id; the next run sends all rows again."""
        self._tell(messages, "failed")


def vector_sink(name: str, factory: Callable[[], Client]) -> type[DataSource]:
    """A data source of this name whose tasks write through ``factory()``."""

    class VectorSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> _Writer:
            if not {"id", "vector"} <= set(schema.names):
                raise ValueError("rows need the columns id and vector")
            return _Writer(dict(self.options), factory)

    return VectorSink
