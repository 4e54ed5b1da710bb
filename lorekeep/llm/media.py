"""Media columns: a Spark data source over directories of archives.

Archives are zip files of 8-bit grey PNG images, written by one task each and named in a manifest at
commit, so a task that runs twice adds nothing. The reader plans byte ranges of the archives without
opening them; a task takes the members whose headers start in its range, reads each by its own offset,
retries a member by itself, and hands payloads on in Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lorekeep.llm.common import byte_texts, filesystem, new_folder, put_bytes
from lorekeep.session import workers_import

#: Samples in a row of the image; payloads are padded to whole rows.
ROW = 576
PAD = b"\xff"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
RETRIES = 4
MANIFEST = "_members.json"

# fixed values of the PNG and zip formats
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
ZIP_END, ZIP_ENTRY, ZIP_MEMBER = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
ZIP64_END, ZIP64_LOCATOR = b"PK\x06\x06", b"PK\x06\x07"


def payload_of(text: bytes) -> bytes:
    """The text, padded with bytes 255 (which UTF-8 never has) to a positive multiple of ROW."""
    return text + PAD * (-len(text) % ROW if text else ROW)


def png(payload: bytes) -> bytes:
    """An 8-bit grey image, ROW samples wide, with the payload as its samples."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(lines), ROW + 1), np.uint8)  # each line begins with filter type 0
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def png_samples(image: bytes) -> bytes:
    """The samples of what png() wrote; ValueError on anything damaged."""
    if image[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, b""
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a filter that png() never uses")
    return raw[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation, mean step between samples, and share of each eighth of the range."""
    x = np.frombuffer(payload, np.uint8)
    steps = np.abs(np.diff(x.astype(np.int16)))
    shares = np.bincount(x >> 5, minlength=8) / len(x)
    return ";".join([f"mean={x.mean():.4f}", f"sd={x.std():.4f}", f"step={steps.mean():.4f}", "hist=" + ",".join(f"{s:.4f}" for s in shares)])


class ArchiveBuilder:
    """A zip archive of stored members, built in memory up to a bounded size."""

    def __init__(self):
        self.body, self.entries, self.size = [], [], 0

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        fixed = struct.pack("<HHHHIIIHH", 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), 0)
        self.entries.append(ZIP_ENTRY + struct.pack("<HH", 20, 20) + fixed + struct.pack("<HHHII", 0, 0, 0, 0, self.size) + raw)
        member = ZIP_MEMBER + struct.pack("<H", 20) + fixed + raw
        self.body += [member, data]
        self.size += len(member) + len(data)

    def bytes(self) -> bytes:
        """Always with the zip64 end, so the number of members has no limit."""
        listing = b"".join(self.entries)
        n, at = len(self.entries), self.size
        end64 = ZIP64_END + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(listing), at)
        locator = ZIP64_LOCATOR + struct.pack("<IQI", 0, at + len(listing), 1)
        end = ZIP_END + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(listing), 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)
        return b"".join([*self.body, listing, end64, locator, end])


def listing_of(handle, size: int) -> list[tuple[str, int, int, int]]:
    """(name, offset of the header, size, crc32) of each member, from the archive's directory."""
    tail = read_at(handle, max(0, size - 98), min(98, size))
    at = tail.rfind(ZIP64_END)
    if at < 0:
        raise ValueError("no archive directory")
    n, _, length, start = struct.unpack_from("<QQQQ", tail, at + 24)
    raw, found, at = read_at(handle, start, length), [], 0
    for _ in range(n):
        crc, stored, _, name, extra, note, _, _, _, offset = struct.unpack_from("<IIIHHHHHII", raw, at + 16)
        found.append((raw[at + 46 : at + 46 + name].decode(), offset, stored, crc))
        at += 46 + name + extra + note
    return found


def read_at(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    data = handle.read(length)
    if len(data) != length:
        raise OSError(f"{len(data)} of {length} bytes at {offset}")
    return data


def read_member(uri: str, handle, offset: int, size: int, crc: int, retries: int = RETRIES):
    """(handle, the member's bytes). A failed or damaged read of this member is done again from its offset, on a new handle."""
    for attempt in range(retries + 1):
        try:
            if handle is None:
                system, path = filesystem(uri)
                handle = system.open_input_file(path)
            head = read_at(handle, offset, 30)
            name, extra = struct.unpack_from("<HH", head, 26)
            data = read_at(handle, offset + 30 + name + extra, size)
            if head[:4] != ZIP_MEMBER or zlib.crc32(data) != crc:
                raise OSError(f"member at {offset} of {uri} is damaged")
            return handle, data
        except OSError:
            if attempt == retries:
                raise
            handle = None
            time.sleep(0.05 * 2**attempt)


@dataclass
class ByteRange(InputPartition):
    """The members of an archive whose headers start in [start, end)."""

    uri: str
    size: int
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, batch_bytes: int):
        self.folder, self.range_bytes, self.batch_bytes = folder, range_bytes, batch_bytes

    def partitions(self) -> list[InputPartition]:
        """From names and sizes alone: the archives aren't opened here."""
        system, path = filesystem(f"{self.folder}/{MANIFEST}")
        with system.open_input_file(path) as f:
            archives = json.loads(f.read())
        return [ByteRange(f"{self.folder}/{name}", size, at, min(size, at + self.range_bytes)) for name, size in archives for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        system, path = filesystem(partition.uri)
        handle = system.open_input_file(path)
        names, images, held = [], [], 0
        for name, offset, size, crc in listing_of(handle, partition.size):
            if partition.start <= offset < partition.end:
                handle, data = read_member(partition.uri, handle, offset, size, crc)
                names.append(name)
                images.append(data)
                held += len(data)
                if held >= self.batch_bytes:
                    yield as_batch(names, images)
                    names, images, held = [], [], 0
        if names:
            yield as_batch(names, images)


def as_batch(names: list[str], images: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names), pa.array(images, pa.binary())], names=["name", "media"])


@dataclass
class Written(WriterCommitMessage):
    archives: list


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        """Archives of bounded size under names of this attempt; only commit() makes them part of the directory."""
        task, written, build = uuid.uuid4().hex, [], ArchiveBuilder()

        def close():
            data, name = build.bytes(), f"part-{task}-{len(written):05d}.zip"
            put_bytes(f"{self.folder}/{name}", data)
            written.append([name, len(data)])

        for batch in iterator:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                build.add(name, data.as_py())
                if build.size >= ARCHIVE_BYTES:
                    close()
                    build = ArchiveBuilder()
        if build.entries:
            close()
        return Written(written)

    def commit(self, messages) -> None:
        put_bytes(f"{self.folder}/{MANIFEST}", json.dumps(sorted(a for m in messages if m for a in m.archives)).encode())

    def abort(self, messages) -> None:
        for name, _ in (a for m in messages if m for a in m.archives):
            system, path = filesystem(f"{self.folder}/{name}")
            system.delete_file(path)


class MediaArchives(DataSource):
    """format("media_archives"): option path, and for reading range_bytes and batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "name string, media binary"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("range_bytes", RANGE_BYTES)), int(o.get("batch_bytes", BATCH_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def store_texts(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each text's payload as an image member named "<row in its batch>_<id>"; a null id leaves the id empty."""

    def run(batches):
        n = 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), byte_texts(b.column(1))
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                yield as_batch([f"{n + i}_{'' if x is None else x}" for i, x in enumerate(ids[lo : lo + 256])], [png(payload_of(t)) for t in part])
                n += len(part)

    workers_import(docs.sparkSession)
    docs.sparkSession.dataSource.register(MediaArchives)
    docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, "name string, media binary").write.format("media_archives").mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(name, media) of every member of the archives in a folder."""
    workers_import(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("range_bytes", range_bytes).option("batch_bytes", batch_bytes).load(folder)


def media_columns(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each member.

    All come from the stored bytes. n_bytes is the payload without its padding. A damaged image raises.
    """

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for name, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = png_samples(image)
                id_ = name.split("_", 1)[1]
                for k, v in zip(out, (int(id_) if id_ else None, len(p.rstrip(PAD)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(p)), strict=True):
                    out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text in archives of the shared folder, reads them back, and gives media_columns().

    A null text is empty: one row of padding. Equal texts have equal values; rows that repeat and rows
    without an id each keep their row; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    store_texts(docs, folder, id_col, text_col)
    return media_columns(read_media(spark, folder))
