"""The data source `swf`: spark.read.format("swf").option("table", "code").load(path).

A partition is a file.  Register it once per session with `register(spark)`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..codec import classes as C
from ..operators.model import CLASSES, CODE, FIELDS, METHODS
from . import files

TABLES = {
    "parts": (None, files.PARTS), "rows": (files.raw_rows, files.ROWS), "classes": (C.class_rows, CLASSES), "fields": (C.field_rows, FIELDS), "methods": (C.method_rows, METHODS),
    "code": (lambda b, _: C.code_rows(b), CODE), "strings": (lambda b, _: C.string_rows(b), files.STRINGS), "names": (lambda b, _: C.name_rows(b), files.NAMES),
    "bodies": (lambda b, _: C.body_rows(b), files.BODIES), "handlers": (lambda b, _: C.handler_rows(b), files.HANDLERS),
}


def filesystem(path: str):
    """An Arrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SwfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "swf"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "code")][1]

    def reader(self, schema) -> DataSourceReader:
        return SwfReader(self.options)


class File(InputPartition):
    def __init__(self, resource_id: int, path: str):
        self.resource_id, self.path = resource_id, path


class SwfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.path = options.get("table", "code"), options["path"]

    def partitions(self) -> list[File]:
        from pyarrow import fs

        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        found = [info.path] if info.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.lower().endswith((".swf", ".swz"))]
        return [File(i, p) for i, p in enumerate(sorted(found))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        with system.open_input_stream(partition.path) as f:
            data = f.read()
        parts = files.batched(files.parts_of(partition.resource_id, partition.path, data), files.PARTS)
        make, ddl = TABLES[self.table]
        if make is None:
            return parts
        abc = (b.filter(pa.array([t in (72, 82) for t in b["tag_type"].to_pylist()])) for b in parts)
        return files.rows_of(make, ddl)(files.blocks_of(abc))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SwfSource)
