"""A data source for compressed dumps of JSON lines, of any size.

    spark.dataSource.register(Dump)
    spark.read.format("dump").schema(...).option("keep", '["canada"]').load("/path/of/dumps")

Each file is one task, which decompresses it as a stream (windows of up to 2**31 bytes, which the built-in reader refuses)
and gives Arrow batches of the schema's fields, so neither the file nor its lines are ever held whole. Rows of other
communities are dropped as they are read: those named by `keep`, and those that a filter of the query excludes where
spark.sql.python.filterPushdown.enabled is set. Lines that are no JSON objects are left out; missing fields and values of another type are null.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

BATCH = 10_000
ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
PYTHON = {T.StringType: str, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float), T.BooleanType: bool}


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def lines(raw: Iterable[bytes]) -> Iterator[bytes]:
    """Lines of a stream of blocks."""
    rest = b""
    for block in raw:
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def blocks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    import zstandard

    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as raw:
        stream = zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(raw, read_across_frames=True)
        while block := stream.read(size):
            yield block


class DumpReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, suffix: str, field: str, keep: set | None) -> None:
        self.schema, self.path, self.suffix, self.field, self.keep = schema, path, suffix, field, keep

    def partitions(self) -> list[FilePartition]:
        fs, at = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(at).type == pafs.FileType.File:
            return [FilePartition(self.path)]
        base = self.path.rstrip("/")
        found = fs.get_file_info(pafs.FileSelector(at))
        return [FilePartition(f"{base}/{x.base_name}") for x in sorted(found, key=lambda x: x.base_name) if x.type == pafs.FileType.File and x.base_name.endswith(self.suffix)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        types = [ARROW[type(f.dataType)] for f in self.schema]
        kinds = [PYTHON[type(f.dataType)] for f in self.schema]
        columns: list[list] = [[] for _ in names]
        for line in lines(blocks(partition.path)):
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if not isinstance(x, dict) or (self.keep is not None and x.get(self.field) not in self.keep):
                continue
            for c, n, k in zip(columns, names, kinds, strict=True):
                v = x.get(n)
                c.append(v if isinstance(v, k) and (k is bool or not isinstance(v, bool)) else None)
            if len(columns[0]) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                columns = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class FilteringReader(DumpReader):
    """For sessions that push filters down; Spark refuses a reader with pushFilters in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.field,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keep = wanted if self.keep is None else self.keep & wanted
            else:
                yield f


class Dump(DataSource):
    """Options: path, suffix (.zst), field (subreddit), keep (a JSON list of its values), pushdown (true in sessions that push
    filters down to Python sources)."""

    @classmethod
    def name(cls) -> str:
        return "dump"

    def reader(self, schema: T.StructType) -> DumpReader:
        path = self.options["path"]
        keep = self.options.get("keep")
        kind = FilteringReader if self.options.get("pushdown") == "true" else DumpReader
        return kind(schema, path if "://" in path or path.startswith("file:") else f"file://{path}", self.options.get("suffix", ".zst"), self.options.get("field", "subreddit"), None if keep is None else set(json.loads(keep)))


def read_dumps(spark: SparkSession, path: str, schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(Dump)
    reader = spark.read.format("dump").schema(schema).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    return (reader if keep is None else reader.option("keep", json.dumps(keep))).load(path)
