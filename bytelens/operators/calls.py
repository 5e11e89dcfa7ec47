"""The call graph and constant arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .model import BODY, Model


def edges(m: Model) -> DataFrame:
    """caller, caller_method_index, target, opcode, mnemonic, offset, edge_type."""
    rows = m.scanned.filter(F.col("mnemonic").isin(*fixed.EDGE_TYPES) & C.named(F.col("target")))
    return rows.select(
        F.col("cg_name").alias("caller"), F.col("method_index").alias("caller_method_index"), "target", "opcode", "mnemonic", "offset",
        C.either(F.col("mnemonic"), fixed.EDGE_TYPES).alias("edge_type"),
    )


def callers(e: DataFrame, target: str) -> DataFrame:
    return e.filter(F.col("target") == target)


def callees(e: DataFrame, caller: str) -> DataFrame:
    return e.filter(F.col("caller") == caller)


def of_type(e: DataFrame, edge_type: str) -> DataFrame:
    return e.filter(F.col("edge_type") == edge_type)


def unique_callers(e: DataFrame) -> DataFrame:
    """target, callers (distinct, sorted) over call edges."""
    return of_type(e, "call").groupBy("target").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def unique_callees(e: DataFrame) -> DataFrame:
    return of_type(e, "call").groupBy("caller").agg(F.array_sort(F.collect_set("target")).alias("callees"))


def instantiators(e: DataFrame) -> DataFrame:
    return of_type(e, "construct").groupBy("target").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def stats(e: DataFrame) -> DataFrame:
    return e.agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"), F.count_distinct("caller").alias("callers"))


def const_args(m: Model) -> DataFrame:
    """source_class, source_member, offset, target, arg_count, args (null: unknown) of every call site.

    The arguments are the pushes right before the call, as far as they run without a break.  In
    blocks they are found as the code is read; without blocks, windows over the body find the run: the
    last instruction that is no push, and the literals since then.
    """
    unknown = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"))
    blank = lambda n: F.array_repeat(unknown, (F.col("arg_count") - n).cast("int"))
    if m.sites is not None:
        return m.sites.select(F.col("class_name").alias("source_class"), F.col("ca_name").alias("source_member"), "offset", "target", "arg_count", F.concat(blank(F.size("known")), "known").alias("args"))
    order = Window.partitionBy(*BODY).orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    code = m.code.select(*BODY, "seq", "offset", "mnemonic", "target", "arg_count", "literal", "class_name", "ca_name")
    pushes = F.col("literal").isNotNull()
    # pushes are numbered within the body, so that a call reads its last ones from a compact table
    code = code.withColumns({"n": F.count(F.when(pushes, 1)).over(before), "broken": F.max(F.when(~pushes, F.col("seq"))).over(before)})
    code = code.withColumn("run", F.col("seq") - F.coalesce("broken", F.lit(-1)) - 1)
    sites = code.filter(F.col("mnemonic").isin(*fixed.ARG_OPS) & ~F.col("target").startswith("multiname["))
    take = F.least("run", "arg_count")
    keyed = sites.withColumn("take", take)
    wanted = keyed.select(F.col("seq").alias("site"), *BODY, F.explode(F.when(F.col("take") > 0, F.sequence(F.col("n") - F.col("take"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("n"))
    pushed = code.filter(pushes).select(*BODY, "n", "literal")
    got = wanted.join(pushed, [*BODY, "n"]).groupBy(*BODY, F.col("site").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("n", "literal"))).alias("xs"))
    known = F.transform("xs", lambda x: x["literal"])
    missing = blank(F.greatest(F.col("take"), F.lit(0)))
    args = F.when(F.col("xs").isNull(), missing).otherwise(F.concat(missing, known))
    return keyed.join(got, [*BODY, "seq"], "left").select(F.col("class_name").alias("source_class"), F.col("ca_name").alias("source_member"), "offset", "target", "arg_count", args.alias("args"))


def observations_for(args: DataFrame, target: str) -> DataFrame:
    """The call sites of one target."""
    return args.filter(F.col("target") == target)


def literal_key(x):
    """Literals that compare equal have one key: numbers and booleans by value, strings, null."""
    number = F.coalesce(x["d"], x["i"].cast("double"), x["b"].cast("int").cast("double"))
    return F.when(x["kind"] == "str", F.concat(F.lit("s:"), x["s"])).when(x["kind"] == "null", "null").otherwise(F.concat(F.lit("n:"), number.cast("string")))


def distinct_values(observations: DataFrame) -> DataFrame:
    """target, slot, key: the distinct known values of each argument slot."""
    flat = observations.select("target", F.posexplode("args").alias("slot", "x")).filter("x.kind != 'unknown'")
    return flat.select("target", "slot", literal_key(F.col("x")).alias("value")).distinct()
