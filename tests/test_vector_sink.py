"""The service writer against clients that fail in passing, for good, and now and then."""

import json
import threading
import time

import pytest

from quillspark.sources import vector_sink as S


class Fake:
    """Keeps rows by id; ids that 7 divides are refused, every other request fails in passing the first time."""

    def __init__(self):
        self.rows, self.calls, self.open, self.most, self.lock, self.seen = {}, 0, 0, 0, threading.Lock(), set()

    def upsert(self, rows):
        with self.lock:
            self.calls += 1
            self.open += 1
            self.most, first = max(self.most, self.open), (rows[0]["id"], len(rows))
            again = first in self.seen
            self.seen.add(first)
        time.sleep(0.002)
        with self.lock:
            self.open -= 1
        if not again and rows[0]["id"] % 40 == 0:
            raise S.Passing("slow down")
        if any(r["id"] % 7 == 0 for r in rows):
            raise ValueError("no such id")
        with self.lock:
            self.rows.update({r["id"]: r for r in rows})


def test_all_rows_are_sent_or_rejected_with_bounded_requests():
    client = Fake()
    done, bad = S.send_all(client, ({"id": k, "vector": [1.0]} for k in range(500)), size=20, in_flight=3, tries=20, pause=0.0)
    assert set(client.rows) == {k for k in range(500) if k % 7} and sorted(r["id"] for r, _ in bad) == list(range(0, 500, 7))
    assert done.upserted == len(client.rows) and done.rejected == len(bad) and done.requests == client.calls and done.retries > 0
    assert client.most <= 3 and done.most_in_flight <= 3 and all(why == "ValueError: no such id" for _, why in bad)


def test_pauses_double_and_end():
    pauses = []

    class Never:
        def upsert(self, rows):
            raise S.Passing("gone")

    done, bad = S.send(Never(), [{"id": 1}, {"id": 2}], 4, 1.0, pauses.append)
    assert len(pauses) == 3 and all(0 <= p <= 2**k for k, p in enumerate(pauses)) and (done.rejected, done.requests, len(bad)) == (2, 4, 2)


def test_rows_are_not_taken_ahead():
    """Back-pressure: no more rows are read than requests may hold, and one batch that waits."""
    taken, gate = [], threading.Event()

    class Held:
        def upsert(self, rows):
            gate.wait(10)

    def rows():
        for k in range(100):
            taken.append(k)
            yield {"id": k}

    t = threading.Thread(target=S.send_all, args=(Held(), rows()), kwargs=dict(size=5, in_flight=2, tries=1, pause=0.0))
    t.start()
    time.sleep(0.5)
    assert len(taken) <= 15
    gate.set()
    t.join()
    assert len(taken) == 100


def client_of(folder, dies=False):
    """Writes each id to a file; a client that dies fails the task that has id 13."""

    class Files:
        def upsert(self, rows):
            import pathlib

            for r in rows:
                if r["id"] == 12:
                    raise KeyError("refused")
                pathlib.Path(folder, str(r["id"])).write_text(json.dumps(r))

    class Dying(Files):
        def __init__(self):
            raise MemoryError("the task dies")

    def factory():
        from pyspark import TaskContext

        return Dying() if dies and TaskContext.get().partitionId() == 2 else Files()

    return factory


def test_through_spark(spark, tmp_path):
    (tmp_path / "rows").mkdir()
    frame = spark.range(40).selectExpr("id", "array(cast(id as float)) as vector", "'m' as meta").repartition(4)
    spark.dataSource.register(S.vector_sink("quill_dying", client_of(str(tmp_path / "rows"), dies=True)))
    report = tmp_path / "report"
    with pytest.raises(Exception):  # noqa: B017  (Spark's own, around the task's)
        frame.write.format("quill_dying").option("report", f"file://{report}").mode("append").save()
    told = json.loads((report / "counters.json").read_text())
    assert told["status"] == "failed" and told["tasks"] < 4
    spark.dataSource.register(S.vector_sink("quill_files", client_of(str(tmp_path / "rows"))))
    frame.write.format("quill_files").option("report", f"file://{report}").option("rows", "3").option("inFlight", "2").mode("append").save()
    told = json.loads((report / "counters.json").read_text())
    assert (told["status"], told["tasks"], told["upserted"], told["rejected"]) == ("completed", 4, 39, 1) and told["most_in_flight"] <= 2
    assert {p.name for p in (tmp_path / "rows").iterdir()} == {str(k) for k in range(40) if k != 12}
    rejected = [json.loads(x) for p in report.glob("rejected-*") for x in p.read_text().splitlines()]
    assert rejected == [{"id": 12, "reason": "KeyError: 'refused'"}]
    with pytest.raises(Exception):  # noqa: B017
        spark.range(3).write.format("quill_files").mode("append").save()
