"""Chat formatting: collapse cumulative snapshots, then render what is left.

A logged conversation that is a prefix of a longer one is a snapshot of it.  Every turn gets the
hash of its conversation's prefix up to it; a conversation whose last hash is an inner prefix hash
of another one goes; of equal conversations the least conv_id stays.  DataFrame functions only.

The rolling hash is an XOR over (position, role, text) hashes, two of 64 bits each, so it is a
window sum that needs no array.  Null roles and texts are values of their own; turns are ordered by
turn, ties by role and text; repeated rows of a turn are one turn; null conv_ids are dropped (no
conversation can be told); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (from 1) and the prefix hashes p, q of every turn."""
    rows = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    for name, seed in (("p", 1), ("q", 2)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64("pos", marked("role"), marked("text"), F.lit(seed))).over(so_far))
    return rows


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no prefix of another, and n_collapsed into them by equality."""
    ends = rows.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    last = rows.join(ends, "conv_id").filter(F.col("pos") == F.col("n_turns")).select("conv_id", "n_turns", "p", "q")
    keepers = last.groupBy("p", "q", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    inner = rows.join(ends, "conv_id").filter(F.col("pos") < F.col("n_turns")).groupBy("p", "q", F.col("pos").alias("n_turns")).agg(F.count("*").alias("_"))
    return keepers.join(inner.drop("_"), ["p", "q", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(rows: DataFrame, kept: DataFrame, open_tag: str = "<|im_start|>", close_tag: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, n_equal and the rendered chat of the kept conversations."""
    turn = F.concat(F.lit(open_tag), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(close_tag + "\n"))
    chat = rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_equal")
    chat = chat.agg(F.sort_array(F.collect_list(F.struct("pos", turn.alias("t")))).alias("ts"))
    return chat.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("chat"))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations of `turns` (conv_id, turn, role, text), rendered."""
    rows = prefixes(turns)
    return render(rows, maximal(rows))
