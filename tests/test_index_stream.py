"""Files to index in one stream: restarts, repeats within and after expiry, rows that the model refuses."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import models as M
from quillspark.sources import commits as C
from quillspark.streaming import index_stream as S

DAY = datetime.datetime(2026, 1, 1)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, arrived timestamp"


def put(spark, folder, ids, hours, text="Question {0}? Answer of {0} is long."):
    rows = [(i, text.format(i), "en", "s", 9, DAY + datetime.timedelta(hours=hours)) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, p, **how):
    S.ingest_index(spark, f"{p}/in", f"file://{p}/out", f"file://{p}/cp", spark.createDataFrame([], SCHEMA).schema, **how)


def table(spark, p):
    return C.read_committed(spark, f"file://{p}/out")


def test_restarts_and_repeats(spark, tmp_path):
    p = str(tmp_path)
    put(spark, f"{p}/in", range(10), 0)
    run(spark, p)
    assert table(spark, p).count() == 10
    run(spark, p)  # nothing new
    put(spark, f"{p}/in", range(5, 15), 1)  # five within expiry
    run(spark, p)
    assert sorted(r.doc_id for r in table(spark, p).collect()) == list(range(15))
    put(spark, f"{p}/in", [20], 200)  # the watermark moves on, the state of before goes
    run(spark, p)
    put(spark, f"{p}/in", range(8, 24), 201)  # repeats after expiry: their chunks are there
    run(spark, p)
    rows = table(spark, p).collect()
    assert sorted(r.doc_id for r in rows) == [*range(24)] and len({r.id for r in rows}) == len(rows)
    assert all(len(r.vector) == 64 and r.vector_rejected is None for r in rows)


@pytest.mark.parametrize("at", ["before", "after"])
def test_death_in_a_batch(spark, tmp_path, monkeypatch, at):
    """The commit's process dies before or after the rename; the restart ends with every chunk there once."""
    p, commit, died = str(tmp_path), C._commit, []

    def dies(*a):
        if not died:
            died.append(1)
            if at == "after":
                commit(*a)
            raise RuntimeError("killed")
        return commit(*a)

    put(spark, f"{p}/in", range(6), 0)
    monkeypatch.setattr(C, "_commit", dies)
    with pytest.raises(Exception):  # noqa: B017  (the stream's own, around it)
        run(spark, p)
    assert (table(spark, p) is None) == (at == "before")
    run(spark, p)
    assert sorted(r.doc_id for r in table(spark, p).collect()) == list(range(6)) and died == [1]


def test_refused_rows_and_long_texts(spark, tmp_path):
    def refusing():  # here, so that it travels to the workers whole
        hashed = M.HashedVectors()

        def model(inputs):
            if any("3" in x for x in inputs):
                raise ValueError("three")
            return hashed(inputs)

        return model

    p = str(tmp_path)
    put(spark, f"{p}/in", range(5), 0)
    put(spark, f"{p}/in", [50], 0, text="Word is here. " * 900)
    run(spark, p, name="refusing", factory=refusing, files=1, pause=0.0)
    rows = table(spark, p).collect()
    assert {r.doc_id: r.vector_rejected for r in rows if r.doc_id < 9} == {k: "ValueError: three" if k == 3 else None for k in range(5)}
    long = [r for r in rows if r.doc_id == 50]
    assert len(long) > 1 and {r.chunk_index for r in long} == set(range(long[0].total_chunks)) and len(C.commits(spark, f"file://{p}/out")) == 2


def test_without_a_time_column(spark, tmp_path):
    p = str(tmp_path)
    put(spark, f"{p}/in", range(3), 0)
    schema = spark.createDataFrame([], SCHEMA).drop("arrived").schema
    S.ingest_index(spark, f"{p}/in", f"file://{p}/out", f"file://{p}/cp", schema)
    assert table(spark, p).where(F.col("vector").isNotNull()).count() == 3
