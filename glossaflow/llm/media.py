"""Media columns: payloads in archives, read back by a custom Spark data source.

An archive directory has ZIP files whose members are 8-bit grey PNG images, 192
samples wide and losslessly compressed; the central directory of each file tells
offset, size, CRC and, as a comment, the row's id and unpadded length. Files are
reached through URIs (file, hdfs, s3, gs), so executors need no common local folder.

The source ``media_archive`` plans byte ranges from file sizes alone. A task opens
the central directory of its file, takes the members that begin in its range and
streams them in small Arrow batches. Each member is read by offset and verified;
one that fails is read again on a new connection, and after ``retries`` attempts it
becomes a row with an error, while the others go on.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_path, small_batches, spread, stored

WIDTH = 192
_BATCH_BYTES = 4 << 20
SCHEMA = "member string, id string, n_bytes long, offset long, media binary, payload binary, error string"


def padded(data: bytes) -> bytes:
    """data and as many spaces as make it a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line has filter 0 before it
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of an 8-bit grey PNG with unfiltered lines."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey PNG")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def write_archives(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes one archive for each partition of docs to path; returns the stored manifest (file, members, bytes).

    A file gets its name only when it is complete, and a task that runs again puts
    the same file in its place.
    """
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder)
        name = f"part-{TaskContext.get().partitionId():08d}.zip"
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        members = 0
        with store.open_output_stream(part) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                for batch in batches:
                    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        data = (t or "").encode("utf-8", "surrogatepass")
                        info = zipfile.ZipInfo(f"{members:010d}.png")
                        info.comment = json.dumps([i, len(data)]).encode()
                        archive.writestr(info, encode(padded(data)))
                        members += 1
        size = store.get_file_info(part).size
        if not members:  # an archive without members has no directory to plan by
            store.delete_file(part)
            return
        store.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "members": [members], "bytes": [size]})

    slim = spread(docs.select(F.col(f"`{doc_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")))
    return stored(slim.mapInArrow(write, "file string, members long, bytes long"), "media-manifest")


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 16 << 20)))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        store, folder = pafs.FileSystem.from_uri(self.path)
        files = [f for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith(".")]
        made = [ByteRange(f.path, a, min(f.size, a + self.split)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.split)]
        return made or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as f, zipfile.ZipFile(f) as archive:
            infos = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        rows: list[tuple] = []
        size = 0
        handle = [store.open_input_file(partition.file)]
        try:
            for info in infos:
                rows.append(self._member(store, partition.file, handle, info))
                size += sum(len(x or b"") for x in rows[-1][4:6])
                if size >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        finally:
            handle[0].close()

    def _member(self, store, file: str, handle: list, info: zipfile.ZipInfo) -> tuple:
        name, n = json.loads(info.comment or b"[null, null]")
        error = ""
        for attempt in range(self.retries + 1):
            try:
                if attempt:
                    handle[0].close()
                    handle[0] = store.open_input_file(file)
                media = read_member(handle[0], info)
                return (info.filename, name, n, info.header_offset, media, decode(media), None)
            except Exception as e:  # noqa: BLE001  one bad member must not end the others
                error = f"{type(e).__name__}: {e}"
        return (info.filename, name, n, info.header_offset, None, None, error)


def read_member(f, info: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, by its offset alone."""
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    f.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    data = f.read(info.compress_size)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise ValueError("damaged member")
    return data


_FIELDS = [("member", pa.string()), ("id", pa.string()), ("n_bytes", pa.int64()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("error", pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)], [n for n, _ in _FIELDS])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("path", uri).load()"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per member: member, id, n_bytes, offset, media (as stored), payload (its samples), error."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archive").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


@F.pandas_udf(T.StringType())
def feature(payloads: pd.Series) -> pd.Series:
    """Mean, deviation, entropy, sign changes about the mean and a histogram of 8 bins of the samples."""

    def one(p: bytes | None) -> str | None:
        if p is None:
            return None
        x = np.frombuffer(p, np.uint8)
        n = np.bincount(x, minlength=256)
        q = n[n > 0] / len(x)
        above = x > x.mean()
        turns = int((above[1:] != above[:-1]).sum())
        bins = "/".join(map(str, n.reshape(8, 32).sum(1).tolist()))
        return f"mean={x.mean():.4f};std={x.std():.4f};entropy={abs(-(q * np.log2(q)).sum()):.4f};turns={turns};hist={bins}"

    return payloads.map(one)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, **options) -> DataFrame:
    """Stores each text as an image in archives and returns, read back, a row for each:

    doc_id, n_bytes, payload, media, feature, error. Null texts count as empty and
    are padded to one line; ids may be null or repeated. An empty table gives an
    empty one. Only doc_id and text are stored, so extra columns can't clash. Equal texts
    give equal media, whatever their length; a text of any length is one member, held
    whole by the task that writes or reads it.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "media")
    write_archives(docs, path, doc_id, text)
    rows = read_archives(spark, path, **options)
    kind = docs.schema[doc_id].dataType
    return rows.select(F.col("id").cast(kind).alias("doc_id"), "n_bytes", "payload", "media", feature("payload").alias("feature"), "error")
