"""Reads and writes of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .model import Model

WRITES = ("write", "init")


def accesses(m: Model) -> DataFrame:
    """class_name (of the accessing method), method_name, field_name, access_type, offset."""
    rows = m.scanned.filter(F.col("mnemonic").isin(*fixed.ACCESS_TYPES) & C.named(F.col("target")))
    return rows.select(
        "class_name", F.col("member_name").alias("method_name"), "method_index", F.col("target").alias("field_name"),
        C.either(F.col("mnemonic"), fixed.ACCESS_TYPES).alias("access_type"), "offset", "resource_id", "abc_id", "body_index", "seq",
    )


def _methods(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class_name", "field_name").agg(F.array_sort(F.collect_set("method_name")).alias("methods"))


def writers(acc: DataFrame) -> DataFrame:
    """class_name, field_name, methods (distinct, sorted) that write or initialise the field."""
    return _methods(acc.filter(F.col("access_type").isin(*WRITES)))


def readers(acc: DataFrame) -> DataFrame:
    return _methods(acc.filter("access_type = 'read'"))


def access_counts(acc: DataFrame) -> DataFrame:
    return acc.groupBy("class_name", "field_name").agg(F.count("*").alias("n"))


def by_method(acc: DataFrame) -> DataFrame:
    """class_name, method_name and the distinct sorted fields it reads, writes and accesses."""
    of = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("field_name"))))
    return acc.groupBy("class_name", "method_name").agg(
        of(F.col("access_type") == "read").alias("read"), of(F.col("access_type").isin(*WRITES)).alias("written"), of(F.lit(True)).alias("accessed")
    )


def constructor_assignments(acc: DataFrame, constructor: str = "<init>") -> DataFrame:
    """class_name, fields that its constructor assigns, in code order, repeats kept."""
    rows = acc.filter((F.col("method_name") == constructor) & F.col("access_type").isin(*WRITES))
    ordered = F.array_sort(F.collect_list(F.struct("method_index", "offset", "field_name")))
    return rows.groupBy("class_name").agg(ordered.alias("x")).select("class_name", F.transform("x", lambda s: s["field_name"]).alias("fields"))


def constructor_reads(acc: DataFrame, constructor: str = "<init>") -> DataFrame:
    rows = acc.filter((F.col("method_name") == constructor) & (F.col("access_type") == "read"))
    return rows.groupBy("class_name").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))


def in_class(acc: DataFrame) -> DataFrame:
    return acc.select("class_name", "field_name").distinct()


def summary(acc: DataFrame) -> DataFrame:
    """class_name, field_name, readers, writers."""
    of = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("method_name"))))
    return acc.groupBy("class_name", "field_name").agg(of(F.col("access_type") == "read").alias("readers"), of(F.col("access_type").isin(*WRITES)).alias("writers"))


def totals(acc: DataFrame) -> DataFrame:
    """accesses, reads and writes (inits count as writes)."""
    return acc.agg(F.count("*").alias("accesses"), F.count_if(F.col("access_type") == "read").alias("reads"), F.count_if(F.col("access_type").isin(*WRITES)).alias("writes"))


def resolve_key(keys: DataFrame, name: str) -> DataFrame:
    """The key equal to `name`, else the first (by first_seq) that ends with it after a dot."""
    hit = keys.filter((F.col("key") == name) | F.col("key").endswith("." + name))
    return hit.orderBy((F.col("key") != name).cast("int"), "first_seq").limit(1)
