"""Batches that are appended once and whole, by any number of writers.

A batch is written beside the table, in a folder of its own that no reader looks into. It becomes part of the table by one rename: of a small manifest to
``_commits/<number>``, the next one, which only one writer can give away. Who loses the number reads the commits that came before it, takes
out the rows whose keys they hold, and tries the next. A batch whose name is committed already adds nothing. A writer that dies before the rename
leaves a folder that is no part of the table; one that dies after it has done its work.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import NamedTuple

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    number: int
    batch: str
    folder: str
    rows: int
    total: int
    whole: bool = False  # takes the place of all commits before it


class _Files:
    """The table's folder in its own file system, whichever that is."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs_package, self.conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        root = self.fs_package.Path(path)
        self.root = root.getFileSystem(self.conf).makeQualified(root)
        self.store = self.root.getFileSystem(self.conf)
        self.context = self.fs_package.FileContext.getFileContext(self.root.toUri(), self.conf)

    def at(self, *parts: str):
        return self.fs_package.Path("/".join([self.root.toString(), *parts]))

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return sorted(s.getPath().getName() for s in self.store.listStatus(at)) if self.store.exists(at) else []

    def text(self, *parts: str) -> str:
        stream = self.store.open(self.at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> None:
        """A new file, made under another name and renamed; an error that says FileAlreadyExists if the name is taken."""
        temporary = self.at("_staged", f".{uuid.uuid4().hex}")
        out = self.store.create(temporary, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self.at(*parts)
        self.store.mkdirs(target.getParent())
        try:
            if self.root.toUri().getScheme() == "file":  # where a rename would look first and then act, a link does both at once
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            else:
                options = SparkContext._gateway.new_array(getattr(self.fs_package, "Options$Rename"), 1)
                options[0] = getattr(self.fs_package, "Options$Rename").NONE
                self.context.rename(temporary, target, options)
        except FileExistsError as e:
            raise RuntimeError("FileAlreadyExists") from e
        finally:
            self.store.delete(temporary, False)

    def drop(self, *parts: str) -> None:
        self.store.delete(self.at(*parts), True)


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """All commits of the table in order."""
    files = _Files(spark, path)
    return [Commit(int(n), **json.loads(files.text("_commits", n))) for n in files.names("_commits") if n.isdigit()]


def _read(spark: SparkSession, path: str, done: list[Commit], schema=None) -> DataFrame | None:
    last = max((k for k, c in enumerate(done) if c.whole), default=0)
    folders = [f"{path}/{c.folder}" for c in done[last:] if c.rows]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders) if folders else None


def read_committed(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """Rows of all committed batches (up to a number, for a state of before), or None if there are none."""
    return _read(spark, path, [c for c in commits(spark, path) if upto is None or c.number <= upto])


def append_batch(rows: DataFrame, path: str, batch: str, key: str = "id", *, tries: int = 100) -> dict[str, int]:
    """Adds the rows whose key the table lacks, the first of each key, as one batch; returns counters (``upserted``, ``skipped``, ``total``).

    Whatever happens between, the batch is in the table once or not at all. A batch of this name that is in the table already is left as it is
    and its counters are returned. Rows with a null key are all new."""
    spark = rows.sparkSession
    files = _Files(spark, path)
    seen = commits(spark, path)
    counters = lambda c: {"upserted": c.rows, "skipped": c.total - c.rows, "total": c.total}
    if found := next((c for c in seen if c.batch == batch), None):
        return counters(found)
    folder = f"_staged/{uuid.uuid4().hex}"
    keyed = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
    total, staged = rows.count(), _without(keyed, _read(spark, path, seen), key)
    staged.write.parquet(f"{path}/{folder}")
    for _ in range(tries):
        now = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
        made = Commit(seen[-1].number + 1 if seen else 0, batch, folder, now.count(), total)
        if _commit(files, made):
            return counters(made)
        newer = [c for c in commits(spark, path) if not seen or c.number > seen[-1].number]
        seen = [*seen, *newer]
        if found := next((c for c in newer if c.batch == batch), None):
            files.drop(folder)
            return counters(found)
        if any(c.rows for c in newer):  # keys that another writer has added meanwhile go
            again = f"_staged/{uuid.uuid4().hex}"
            _without(now, _read(spark, path, newer), key).write.parquet(f"{path}/{again}")
            files.drop(folder)
            folder = again
    raise RuntimeError(f"batch {batch}: other writers were first {tries} times")


def delete_keys(spark: SparkSession, path: str, gone: DataFrame, batch: str, key: str = "id", *, tries: int = 100) -> int:
    """Takes the rows with these keys out by one commit that holds what is left; returns how many rows that is. Readers see the state of
    before or of after; what other writers add meanwhile is kept."""
    files = _Files(spark, path)
    for _ in range(tries):
        seen = commits(spark, path)
        held = _read(spark, path, seen)
        if held is None:
            return 0
        if any(c.batch == batch for c in seen):
            return held.count()
        folder = f"_staged/{uuid.uuid4().hex}"
        _without(held, gone, key).write.parquet(f"{path}/{folder}")
        left = spark.read.schema(held.schema).parquet(f"{path}/{folder}").count()
        if _commit(files, Commit(seen[-1].number + 1, batch, folder, left, left, True)):
            return left
        files.drop(folder)
    raise RuntimeError(f"batch {batch}: other writers were first {tries} times")


def _without(rows: DataFrame, held: DataFrame | None, key: str) -> DataFrame:
    return rows if held is None else rows.join(held.select(key), key, "left_anti").select(*rows.columns)


def _commit(files: _Files, made: Commit) -> bool:
    """The one step that changes the table; False if the number is taken."""
    said = json.dumps({k: v for k, v in made._asdict().items() if k != "number"})
    try:
        files.put(said, "_commits", f"{made.number:012d}")
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes what writers that died have left, while none writes; returns the folders' names."""
    files, held = _Files(spark, path), {c.folder for c in commits(spark, path)}
    gone = [n for n in files.names("_staged") if f"_staged/{n}" not in held]
    for n in gone:
        files.drop("_staged", n)
    return gone
