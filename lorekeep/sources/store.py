"""Catalog tables as parquet snapshots behind numbered pointer files.

A write adds new folders for the tables it changes, then makes the pointer file of the next number, which
only one writer can: the other sees that it exists, reads the new state and tries again. So readers see all
of a write or nothing of it, and no write is lost. Any file system that Spark reaches will do whose rename
is atomic and refuses an existing name (HDFS and local ones are so; for object stores use a committer that is).
"""

from __future__ import annotations

import json
import sqlite3
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.schemas import SCHEMAS

POINTER = "_state-"
#: Rows of a table in one file.
ROWS_PER_FILE = 1_000_000
TRIES = 20


class Conflict(RuntimeError):
    """Another writer came first."""


@dataclass
class State:
    """The number of the last write, the folder of each table, and the highest Id each ever had: ids don't come back."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    last_ids: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lock = threading.RLock()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.setWriteChecksum(False)  # a pointer has no second file beside it
        return fs

    def state(self) -> State:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return State()
        names = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(self._path(""))) if n.startswith(POINTER))
        if not names:
            return State()
        stream = fs.open(self._path(names[-1]))
        try:
            return State(**json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
        finally:
            stream.close()

    def folders(self) -> dict[str, str]:
        """Table name -> folder of its current snapshot."""
        return self.state().folders

    def create_missing(self) -> None:
        """Empty snapshots for the tables that have none."""
        self.write(lambda have, _: ({n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in have}, None))

    def table(self, name: str) -> DataFrame:
        return self.tables()[name]

    def tables(self, state: State | None = None) -> dict[str, DataFrame]:
        return {n: self.spark.read.schema(SCHEMAS[n]).parquet(f"{self.root}/{f}") for n, f in (state or self.state()).folders.items()}

    def write(self, change: Callable[[dict[str, DataFrame], dict[str, int]], tuple[dict[str, DataFrame] | None, object]]):
        """change(tables, highest Ids so far) -> (changed tables, or nothing; a result), done on the newest state; returns the result.

        If another writer comes first it is done again on that writer's state.
        """
        with self.lock:
            for attempt in range(TRIES):
                state = self.state()
                changed, result = change(self.tables(state), state.last_ids)
                if not changed:
                    return result
                try:
                    self.commit(changed, state)
                    return result
                except Conflict:
                    if attempt == TRIES - 1:
                        raise

    def commit(self, changed: dict[str, DataFrame], state: State | None = None) -> None:
        """Writes the changed tables in order of Id as the write after `state` (the newest); Conflict if there is one already."""
        with self.lock:
            state = state or self.state()
            after = State(state.number + 1, dict(state.folders), dict(state.last_ids))
            for name, df in changed.items():
                folder = f"{name}/{uuid.uuid4().hex}"
                rows = df.select(*SCHEMAS[name].fieldNames())
                n, most = rows.agg(F.count("*"), F.coalesce(F.max("Id"), F.lit(0))).first()
                files = n // ROWS_PER_FILE + 1
                rows = rows.coalesce(1).sortWithinPartitions("Id") if files == 1 else rows.repartitionByRange(files, "Id").sortWithinPartitions("Id")
                rows.write.parquet(f"{self.root}/{folder}")
                after.folders[name] = folder
                after.last_ids[name] = max(most, after.last_ids.get(name, 0))
            self._point(after)

    def _point(self, state: State) -> None:
        fs, part = self._fs(), self._path(f"_{uuid.uuid4().hex}.part")
        out = fs.create(part)
        try:
            out.write(json.dumps(vars(state), indent=1).encode())
        finally:
            out.close()
        fs_ = self.spark._jvm.org.apache.hadoop.fs
        context = fs_.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without the option to overwrite
            context.rename(part, self._path(f"{POINTER}{state.number:012d}.json"), self.spark.sparkContext._gateway.new_array(fs_.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"write {state.number} exists") from e
            raise


def _value(kind: T.DataType, x):
    if x is None:
        return None
    if isinstance(kind, T.BooleanType):
        return bool(x)
    if isinstance(kind, T.TimestampNTZType):
        # at most microseconds
        head, _, tail = str(x).partition(".")
        return datetime.fromisoformat(head + (f".{tail[:6]}" if tail else ""))
    return int(x) if isinstance(kind, T.IntegerType) else str(x)


def read_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The catalog tables of an SQLite file on the driver; a table or nullable column that it lacks is empty."""
    found = {}
    with sqlite3.connect(f"file:{Path(path)}?mode=ro", uri=True) as db:
        have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        for name, schema in SCHEMAS.items():
            rows = []
            if name in have:
                columns = {r[1] for r in db.execute(f'PRAGMA table_info("{name}")')}
                picked = ", ".join(f'"{f.name}"' if f.name in columns else "NULL" for f in schema)
                rows = [tuple(_value(f.dataType, x) for f, x in zip(schema, r, strict=True)) for r in db.execute(f'SELECT {picked} FROM "{name}"')]
            found[name] = spark.createDataFrame(rows, schema)
    return found


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A report as one text file, on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(text.encode())
    finally:
        out.close()
