"""Containers as a stream: every new file is unpacked once, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def content(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """resource_id (a hash of the path), path, content of the files that arrive in a folder."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_at_once).load(path)
    return stream.select(F.xxhash64("path").alias("resource_id"), "path", "content")


def tables(spark: SparkSession, path: str, files_at_once: int = 1000) -> files.Files:
    """The same tables as for a batch, as streams."""
    return files.Files(content(spark, path, files_at_once))


def append(table: DataFrame, to: str, checkpoint: str):
    """Write a streamed table as Parquet; returns the started query."""
    return table.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(to)
