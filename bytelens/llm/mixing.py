"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Null or empty texts have size 0, a null source is a source of its own (the last), an empty table
gives an empty result, repeated rows are each a document. A source without words gets target 0.
Documents are put in order by a seeded digest of the doc_id, null ones by their text's digest, then
by size; which of several equal rows is taken once more is arbitrary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import few, prepare, table
from .textops import NOT_SPACE, column, part, slices, utf8, word_counts

MAX_EPOCHS = 3
#: Fine buckets of the seeded order within a source: hexadecimal digits of the order key.
BUCKET_DIGITS = 3
SIZES = "doc_id long, source string, name string, size long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with `_size`, the number of words of `_text`, instead of `_text`."""
    for batch in batches:
        data, offsets = utf8(column(batch, "_text"))
        size = np.zeros(batch.num_rows, np.int64)
        for i, j in slices(offsets):
            size[i:j] = word_counts(*part(data, offsets, i, j), NOT_SPACE)
        rest = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in rest), pa.array(size)], names=[*rest, "_size"])


def sized_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """_source, _name (what orders the row) and _size of every whole text, and the columns to keep."""
    prepare(docs.sparkSession)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("string")
    name = F.coalesce(doc_id, F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    rows = docs.select(*keep, F.col("source").cast("string").alias("_source"), name.alias("_name"), text.alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(count_words, f"{kinds}, _size long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, name and the number of words of every whole text."""
    rows = sized_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), "doc_id")
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_name").alias("name"), F.col("_size").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: share all sizes by weight, no source above `max_epochs` times its size.

    The level of the water is found in closed form: with the sources by cap / weight, the first k
    are full, where k is the least for which the level of the rest is not above the next cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(past), F.lit(0))) / F.sum("w").over(rest))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("w"), F.col("level")))).over(whole))
    )
    level = F.col("at")["level"]
    full = level.isNull() | (F.col("cap") <= level * F.col("w"))
    return per.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("target"))


def order_key(name, seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def bucket_plan(sized: DataFrame, aim: DataFrame, seed: str) -> DataFrame:
    """source, bucket and what is taken of it: the whole repeats, the rest, and the words in and before the bucket."""
    rows = sized.withColumn("bucket", F.substring(order_key(F.col("name"), seed), 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        buckets.alias("b")
        .join(aim.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")))
        .select("b.source", "bucket", "in_bucket", "before", "source_size", "target", whole.cast("long").alias("whole"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    )


def taken(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """`rows` (_source, _name, _size, ...) with source_size, target and _repeats; of a source, only rows of one bucket are moved."""
    plan = plan.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), *(F.col(c).alias(f"_{c}") for c in ("in_bucket", "before", "source_size", "target", "whole", "extra")))
    key = order_key(F.col("_name"), seed)
    rows = rows.withColumn("_key", key).join(few(table(plan)), F.col("_source").eqNullSafe(F.col("_s")) & (F.substring(key, 1, BUCKET_DIGITS) == F.col("_b")))
    cut = (F.col("_before") < F.col("_extra")) & (F.col("_before") + F.col("_in_bucket") > F.col("_extra"))
    inner = Window.partitionBy("_source", "_b").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    clear = rows.filter(~cut).withColumn("_more", ((F.col("_extra") > 0) & (F.col("_before") + F.col("_in_bucket") <= F.col("_extra"))).cast("long"))
    edge = rows.filter(cut).withColumn("_passed", F.col("_before") + F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    edge = edge.withColumn("_more", (2 * F.col("_passed") + F.col("_size") < 2 * F.col("_extra")).cast("long")).drop("_passed")
    return clear.unionByName(edge).withColumn("_repeats", F.col("_whole") + F.col("_more"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """Per document: size, its source's size and target, and the words taken, repeats counted.

    Every document is taken floor(target / source size) times; then documents in a seeded order
    are taken once more until the rest of the target is met to the nearest document.  The order is
    cut by fine buckets first, so that only one bucket of a source is sorted.
    """
    sized = table(sizes(docs))
    plan = bucket_plan(sized, targets(sized, weights, max_epochs), seed)
    rows = taken(sized.select("doc_id", "source", F.col("source").alias("_source"), F.col("name").alias("_name"), F.col("size").alias("_size")), plan, seed)
    return rows.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_repeats")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """`docs` with size, source_size, target, taken and repeats, how often the mix takes the document (0 to `max_epochs`).

    Columns of `docs` of these names are replaced.  `repeat_documents` makes the copies.
    """
    sized = table(sizes(docs))
    plan = bucket_plan(sized, targets(sized, weights, max_epochs), seed)
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "repeats")]
    rows = taken(sized_rows(docs, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(names))), plan, seed)
    return rows.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_repeats")).alias("taken"), F.col("_repeats").alias("repeats"),
    )


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """As many rows of every document as its `repeats`, numbered by `epoch` from 0."""
    return mixed.filter("repeats > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
