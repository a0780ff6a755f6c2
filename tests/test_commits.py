"""Batches are appended once and whole, whatever dies and whoever else writes."""

import threading

import pytest

from quillspark.sources import commits as C


def rows(spark, ids, v="a"):
    return spark.createDataFrame([(i, v) for i in ids], "id long, v string")


def table(spark, path):
    return sorted(tuple(r) for r in C.read_committed(spark, path).collect())


def test_batches_and_counters(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert C.read_committed(spark, path) is None
    assert C.append_batch(rows(spark, [1, 2, 2, 3]), path, "b0") == {"upserted": 3, "skipped": 1, "total": 4}
    assert C.append_batch(rows(spark, [3, 4], "b"), path, "b1") == {"upserted": 1, "skipped": 1, "total": 2}
    assert C.append_batch(rows(spark, [3, 4], "c"), path, "b2") == {"upserted": 0, "skipped": 2, "total": 2}
    # the same batch again, with whatever rows: nothing, and the counters of before
    assert C.append_batch(rows(spark, [8, 9]), path, "b0") == {"upserted": 3, "skipped": 1, "total": 4}
    assert table(spark, path) == [(1, "a"), (2, "a"), (3, "a"), (4, "b")]
    assert sorted(tuple(r) for r in C.read_committed(spark, path, upto=0).collect()) == [(1, "a"), (2, "a"), (3, "a")]
    assert [c.batch for c in C.commits(spark, path)] == ["b0", "b1", "b2"]


def test_empty_batches_and_null_keys(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert C.append_batch(rows(spark, []), path, "none") == {"upserted": 0, "skipped": 0, "total": 0}
    assert C.read_committed(spark, path) is None
    assert C.append_batch(rows(spark, [None, None, 1]), path, "some")["upserted"] == 3


@pytest.mark.parametrize("at", ["staged", "before", "after"])
def test_death_between_stages(spark, tmp_path, monkeypatch, at):
    """Before the rename nothing is in the table, after it everything; a second run of the batch ends with it there once."""
    path = f"file://{tmp_path}/t"
    C.append_batch(rows(spark, [1]), path, "b0")
    commit, put = C._commit, C._Files.put

    class Death(Exception):
        pass

    def dies(*a):
        if at == "after":
            commit(*a)
        raise Death

    if at == "before":
        monkeypatch.setattr(C._Files, "put", lambda *a: (_ for _ in ()).throw(Death()))
    else:
        monkeypatch.setattr(C, "_commit", dies)
    with pytest.raises(Death):
        C.append_batch(rows(spark, [1, 2, 3]), path, "b1")
    monkeypatch.setattr(C, "_commit", commit), monkeypatch.setattr(C._Files, "put", put)
    assert table(spark, path) == ([(1, "a")] if at != "after" else [(1, "a"), (2, "a"), (3, "a")])
    assert C.append_batch(rows(spark, [1, 2, 3]), path, "b1") == {"upserted": 2, "skipped": 1, "total": 3}
    assert table(spark, path) == [(1, "a"), (2, "a"), (3, "a")]
    assert len(C.vacuum(spark, path)) == (0 if at == "after" else 1) and C.vacuum(spark, path) == []
    assert table(spark, path) == [(1, "a"), (2, "a"), (3, "a")]


def test_a_writer_that_comes_second_takes_the_others_keys_out(spark, tmp_path, monkeypatch):
    path, commit, beaten = f"file://{tmp_path}/t", C._commit, []

    def slow(files, made):
        if not beaten:
            beaten.append(1)
            C.append_batch(rows(spark, [2, 3], "other"), path, "theirs")
        return commit(files, made)

    monkeypatch.setattr(C, "_commit", slow)
    assert C.append_batch(rows(spark, [1, 2], "mine"), path, "mine") == {"upserted": 1, "skipped": 1, "total": 2}
    assert table(spark, path) == [(1, "mine"), (2, "other"), (3, "other")]


def test_the_same_batch_from_two_writers_at_once(spark, tmp_path, monkeypatch):
    path, commit, beaten = f"file://{tmp_path}/t", C._commit, []

    def slow(files, made):
        if not beaten:
            beaten.append(1)
            C.append_batch(rows(spark, [1, 2]), path, "same")
        return commit(files, made)

    monkeypatch.setattr(C, "_commit", slow)
    C.append_batch(rows(spark, [1, 2]), path, "same")
    assert table(spark, path) == [(1, "a"), (2, "a")] and len(C.commits(spark, path)) == 1 and C.vacuum(spark, path) == []


def test_many_writers(spark, tmp_path):
    path, done = f"file://{tmp_path}/t", []
    writers = [threading.Thread(target=lambda k=k: done.append(C.append_batch(rows(spark, [k, 100]), path, f"w{k}"))) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sum(d["upserted"] for d in done) == 5 and [i for i, _ in table(spark, path)] == [0, 1, 2, 3, 100]


def test_delete_is_one_commit_and_keeps_what_others_add(spark, tmp_path, monkeypatch):
    path, commit, beaten = f"file://{tmp_path}/t", C._commit, []
    C.append_batch(rows(spark, [1, 2, 3]), path, "b0")

    def slow(files, made):
        if not beaten:
            beaten.append(1)
            C.append_batch(rows(spark, [2, 4], "late"), path, "b1")
        return commit(files, made)

    monkeypatch.setattr(C, "_commit", slow)
    assert C.delete_keys(spark, path, rows(spark, [2, 9]), "d0") == 3 == C.delete_keys(spark, path, rows(spark, [1]), "d0")
    assert table(spark, path) == [(1, "a"), (3, "a"), (4, "late")]
    assert C.append_batch(rows(spark, [2, 3]), path, "b2")["upserted"] == 1 and len(table(spark, path)) == 4
    assert sorted(tuple(r) for r in C.read_committed(spark, path, upto=0).collect()) == [(1, "a"), (2, "a"), (3, "a")]
