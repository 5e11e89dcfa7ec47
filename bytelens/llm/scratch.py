"""Shared intermediate tables and small cluster helpers."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: Rows of an Arrow batch sent to Python; whole texts travel, so fewer than Spark's default.
BATCH_ROWS = 1024


def root(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without one."""
    folder = spark.conf.get(KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="bytelens-checkpoints-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set(KEY, folder)
    return folder


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._bytelens_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that no later step reads."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._bytelens_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def aside(docs: DataFrame, *keep: str):
    """`docs` with all columns but `keep` renamed, so that none clashes, and a function that undoes it."""
    names = [c if c in keep else f"_c{i}" for i, c in enumerate(docs.columns)]

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))

    return docs.toDF(*names), back


def flag_twins(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` with _twin: false for one of the rows that are equal in `by`, which hold no null, and true for the others.

    Only rows that have twins are moved; a group is numbered within input partitions first, so that
    no task gets a whole group, however large.
    """
    counts = table(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").select(*by))
    if counts.isEmpty():
        discard(counts)
        return rows.withColumn("_twin", F.lit(False))
    counts = few(counts)
    own = rows.join(counts, list(by), "left_semi").withColumn("_pid", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy(*by, "_pid").orderBy("_pid"))
    own = own.withColumn("_first", number == 1).withColumn("_pid", F.when(F.col("_first"), -1).otherwise(F.col("_pid")))
    number = F.row_number().over(Window.partitionBy(*by, "_pid").orderBy("_pid"))
    own = own.withColumn("_twin", ~(F.col("_first") & (number == 1))).drop("_pid", "_first")
    return rows.join(counts, list(by), "left_anti").withColumn("_twin", F.lit(False)).unionByName(own)


def few(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A written table with a broadcast hint, if its files hold no more than `most` / 4 bytes."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._bytelens_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if size > most // 4:  # Parquet's bytes are several times as many in memory
        return df
    out = F.broadcast(df)
    out._bytelens_path = df._bytelens_path
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bitmap(keys: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """A Bloom filter (two probes) of the int64 keys in `column`: 2**bits bits, whatever their number.

    The keys are hashes already.  The words of the bitmap are OR-ed on the executors; the driver
    gets at most 2**(bits-6) of them.
    """
    k, mask = F.col(column), (1 << bits) - 1
    probes = F.explode(F.array(k.bitwiseAND(F.lit(mask)), F.shiftright(k, 32).bitwiseAND(F.lit(mask))))
    words = (
        keys.select(probes.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
    )
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got["w"].to_numpy()] = got["m"].to_numpy()
    return out


def seen(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys may be in the bitmap."""
    mask = np.int64(len(words) * 64 - 1)
    out = np.ones(len(keys), dtype=bool)
    for p in (keys & mask, (keys >> np.int64(32)) & mask):
        out &= (words[p >> np.int64(6)] >> (p & np.int64(63))) & np.int64(1) == 1
    return out


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
