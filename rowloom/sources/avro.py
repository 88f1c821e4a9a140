"""Avro object-container files of all-string records, as a Python data source.

Used where the Avro module is not on the class path. Every task writes one
file; each write adds a manifest that names its files, so earlier writes stay and
leftovers of failed or repeated tasks are never read. Files are read one per task.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

FORMAT = "avro_text"
MAGIC = b"Obj\x01"
BLOCK_ROWS = 1000
MANIFEST = "_files-"


def _files(path: str):
    """File system and plain path; schemes such as hdfs and s3 go through Arrow."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    # a local master's own folder
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def _long(n: int) -> bytes:
    """Zig-zag variable-length integer."""
    z, out = (n << 1) ^ (n >> 63), bytearray()
    while z > 0x7F:
        out.append((z & 0x7F) | 0x80)
        z >>= 7
    out.append(z)
    return bytes(out)


def _bytes(data: bytes) -> bytes:
    return _long(len(data)) + data


def _read_long(stream) -> int:
    shift = value = 0
    while True:
        byte = stream.read(1)[0]
        value |= (byte & 0x7F) << shift
        if not byte & 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _read_bytes(stream) -> bytes:
    return stream.read(_read_long(stream))


def avro_schema(name: str, columns: list[str]) -> str:
    fields = [{"name": c, "type": "string"} for c in columns]
    return json.dumps({"type": "record", "name": name, "fields": fields})


def encode(rows: Iterator, columns: list[str], out, name: str = "row") -> int:
    """Write a container file; returns the number of rows."""
    sync, total = uuid.uuid4().bytes, 0
    meta = {"avro.schema": avro_schema(name, columns).encode(), "avro.codec": b"null"}
    out.write(MAGIC + _long(len(meta)))
    for key, value in meta.items():
        out.write(_bytes(key.encode()) + _bytes(value))
    out.write(_long(0) + sync)
    block, count = io.BytesIO(), 0

    def flush():
        data = block.getvalue()
        out.write(_long(count) + _bytes(data) + sync)

    for row in rows:
        for value in row:
            block.write(_bytes(("null" if value is None else str(value)).encode()))
        count, total = count + 1, total + 1
        if count == BLOCK_ROWS:
            flush()
            block, count = io.BytesIO(), 0
    if count:
        flush()
    return total


def decode(stream) -> Iterator[tuple]:
    """Rows of a container file of string records."""
    if stream.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = {}
    while (n := _read_long(stream)) != 0:
        for _ in range(n):
            key = _read_bytes(stream).decode()
            meta[key] = _read_bytes(stream)
    sync = stream.read(16)
    width = len(json.loads(meta["avro.schema"])["fields"])
    while head := stream.read(1):
        count = _read_long(_Prefixed(head, stream))
        block = io.BytesIO(_read_bytes(stream))
        for _ in range(count):
            yield tuple(_read_bytes(block).decode() for _ in range(width))
        if stream.read(16) != sync:
            raise ValueError("damaged Avro block")


class _Prefixed:
    """A stream with one byte put back."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.rest.read(n)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class AvroTextWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], zipped: bool):
        self.path, self.columns, self.zipped = path, columns, zipped

    def write(self, iterator):
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.avro" + (".gz" if self.zipped else "")
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            sink = gzip.GzipFile(fileobj=out, mode="wb") if self.zipped else out
            rows = encode(iterator, self.columns, sink)
            if self.zipped:
                sink.close()
        return Written(name, rows)

    def commit(self, messages):
        system, root = _files(self.path)
        listed = [{"file": m.file, "rows": m.rows} for m in messages if m is not None]
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages):
        system, root = _files(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/{m.file}")


class AvroFile(InputPartition):
    def __init__(self, file: str):
        self.file = file


class AvroTextReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        system, root = _files(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(MANIFEST):
                with system.open_input_stream(info.path) as f:
                    found += [AvroFile(m["file"]) for m in json.loads(f.read()) if m["rows"]]
        return found

    def read(self, partition):
        system, root = _files(self.path)
        with system.open_input_stream(f"{root}/{partition.file}", compression=None) as f:
            stream = gzip.GzipFile(fileobj=f) if partition.file.endswith(".gz") else f
            yield from decode(stream)


class AvroTextSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])])

    def reader(self, schema):
        return AvroTextReader(self.options["path"])

    def writer(self, schema, overwrite):
        return AvroTextWriter(self.options["path"], schema.fieldNames(), self.options.get("gzip", "false") == "true")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the session's file system, so that all executors mean the same place."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def write_avro(df: DataFrame, path: str, zipped: bool = False) -> None:
    """All columns as strings; one container file per task. Adds to what was written before."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in df.columns])
    df.sparkSession.dataSource.register(AvroTextSource)
    path = _qualified(df.sparkSession, path)
    text.write.format(FORMAT).option("path", path).option("gzip", str(zipped).lower()).mode("append").save()


def read_avro(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    spark.dataSource.register(AvroTextSource)
    return spark.read.format(FORMAT).option("path", _qualified(spark, path)).option("columns", json.dumps(columns)).load()
