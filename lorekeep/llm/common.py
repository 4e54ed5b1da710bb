"""Pieces the text operators share: the shared folder, whole-text batches, packed arrays, fold rules.

The shared folder is the one the cluster names in ``spark.checkpoint.dir``. Files that executors must
see (trie levels, fingerprint sets, archives) live there and nowhere else.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import workers_import

#: Text that a Python worker holds in pieces at a time (a longer single text is one piece).
CHUNK_BYTES = 4 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; set here only where a local session has none (as in tests). On a cluster that raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "lorekeep-checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Folders that this driver made, for remove_folders().
_MADE: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh sub-folder of the shared folder, as a URI."""
    uri = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    filesystem(uri)[0].create_dir(filesystem(uri)[1], recursive=True)
    _MADE.append(uri)
    return uri


def remove_folders(spark: SparkSession) -> int:
    """Removes the folders that operators have made from this driver, and says how many. Only once all results are written: plans read them."""
    n = len(_MADE)
    while _MADE:
        system, path = filesystem(_MADE.pop())
        system.delete_dir(path)
    return n


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, data: bytes | memoryview) -> None:
    """Writes a whole file under a private name, then renames it: a task that runs twice leaves one whole file."""
    system, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    try:
        system.move(part, path)
    except OSError:  # some file systems don't rename over a file; the first attempt's is as whole
        from pyarrow import fs

        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(part)


def map_file(uri: str) -> memoryview:
    """A file's bytes: memory-mapped where the shared folder is mounted, else read."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return memoryview(np.memmap(path, dtype=np.uint8, mode="r")) if os.path.getsize(path) else memoryview(b"")
    with system.open_input_file(path) as f:
        return memoryview(f.read())


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays one after another, each on an 8-byte border, behind a small directory."""
    import json

    head, at, body = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def unpack(data: memoryview | bytes) -> dict[str, np.ndarray]:
    """Views into what pack() wrote; nothing is copied."""
    import json

    n = int.from_bytes(bytes(data[:8]), "little")
    head = json.loads(bytes(data[8 : 8 + n]))
    return {name: np.frombuffer(data, dtype=kind, count=count, offset=8 + n + at) for name, (kind, at, count) in head.items()}


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; later steps read them and lose nothing with an executor.

    What the plan has broadcast goes at once. A hashed relation of a few rows fills a page of memory (16 MB) in
    each executor, and would stay there until the driver happens to collect its garbage.
    """
    shared_dir(df.sparkSession)
    own = df.select("*")  # a plan that is run here alone
    out = own.checkpoint(eager=True)
    for b in broadcasts_of(own):
        b.destroy()
    return out


def broadcasts_of(df: DataFrame) -> list:
    """The JVM's broadcasts of the joins of df's own plan, which has run."""
    found, rest = {}, [df._jdf.queryExecution().executedPlan()]
    if "BroadcastExchange" not in rest[0].toString():
        return []
    while rest:
        node = rest.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            rest.append(node.executedPlan())
        elif kind in ("BroadcastQueryStageExec", "BroadcastExchangeExec"):
            made = node.broadcast() if kind == "BroadcastQueryStageExec" else node
            b = made.relationFuture().get()
            found[b.id()] = b
            rest.append(made.child())
        elif kind.endswith("QueryStageExec"):
            rest.append(node.plan())
        else:
            children = node.children()
            rest += [children.apply(i) for i in range(children.size())]
    return list(found.values())


#: A key with more than one in so many rows, and with more rows than HOT_ROWS, is hot; so there are fewer hot keys than HOT_KEYS.
HOT_KEYS, HOT_ROWS = 4096, 256
#: Rows of a written small table that a task reads, at least, where it is shuffled anew.
ROWS_PER_TASK = 50_000


def fewer_parts(df: DataFrame, rows: int) -> DataFrame:
    """A written table of so many short rows in no more partitions than it needs; many small files cost more than they hold."""
    return df.coalesce(rows // ROWS_PER_TASK + 1)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], n_col: str, how: str = "inner") -> DataFrame:
    """left joined ("inner" or "left_semi") to right, a written table with one row a key and how many rows of left it meets in n_col.

    A hot key is broadcast (there are fewer than HOT_KEYS of them), so no task gathers its rows; the others
    are shuffled as Spark sees fit.
    """
    total, most, rows = right.agg(F.sum(n_col), F.max(n_col), F.count("*")).first()
    right, limit = fewer_parts(right, rows), max((total or 0) / max(HOT_KEYS, 1), HOT_ROWS)
    if (most or 0) <= limit:
        return left.join(right.drop(n_col), on, how)
    is_hot = F.col(n_col) > limit
    hot, rest = F.broadcast(right.where(is_hot).drop(n_col)), right.where(~is_hot).drop(n_col)
    # hot rows leave before the shuffle
    cold = left.join(F.broadcast(right.where(is_hot).select(*on)), on, "left_anti").join(rest, on, how)
    return left.join(hot, on, how).unionByName(cold)


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo; of a null, of the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts together stay near the limit; a text is never cut."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def runs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal runs (touching runs merge)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]


def give_back() -> None:
    """Returns freed memory to the system; allocators keep it otherwise, for as long as the process lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def lean(run):
    """run(batches) for mapInArrow, after which the worker gives its memory back: Spark keeps workers for later tasks, beside the JVM."""

    def lent(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return lent


def map_texts(df: DataFrame, fn, schema: str, id_col: str = "doc_id", text_col: str = "text", extra: Iterable[str] = ()) -> DataFrame:
    """mapInArrow over (id, text, extra...) with fn(ids: Array, texts: list[bytes], batch) -> RecordBatch."""
    workers_import(df.sparkSession)
    names = ["__id", "__text", *[f"__x{i}" for i, _ in enumerate(extra)]]
    cols = [F.col(f"`{c}`").alias(n) for c, n in zip([id_col, text_col, *extra], names, strict=True)]

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield fn(b.column(0), byte_texts(b.column(1)), b)

    return df.select(*cols).mapInArrow(lean(run), schema)


def filter_texts(df: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose whole text keep(list[bytes]) -> list[bool] holds for; a null text is empty. Narrow."""
    workers_import(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(byte_texts(b.column(at))), pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)
