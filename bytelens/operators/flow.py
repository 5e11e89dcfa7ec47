"""Control flow and registers as relations: leaders, blocks, edges, complexity, liveness, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .model import BODY

TERMINATORS = ("returnvoid", "returnvalue", "throw")


def _jump_targets(code: DataFrame) -> DataFrame:
    """BODY, offset (of the branch), pos, to: where branches and switches go."""
    base = F.col("offset") + F.col("size")
    jumps = code.filter(F.col("mnemonic").isin(*fixed.BRANCHES)).select(*BODY, "offset", F.lit(1).alias("pos"), (base + F.get("operands", F.lit(0))).alias("to"))
    # a switch is its default, a count and its cases, all relative to its own offset
    deltas = F.concat(F.slice("operands", 1, 1), F.slice("operands", F.lit(3), F.greatest(F.size("operands") - 2, F.lit(0))))
    switches = code.filter("mnemonic = 'lookupswitch'").select(*BODY, "offset", F.posexplode(deltas).alias("pos", "d"))
    return jumps.unionByName(switches.select(*BODY, "offset", "pos", (F.col("offset") + F.col("d")).alias("to")))


def blocks(code: DataFrame, handlers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, edges, handler coverage) of every body.

    Leaders are first instructions, valid targets, and what follows a branch or terminator; a running
    count of leaders numbers the blocks; edges join the last instruction of a block to its targets.
    `handlers`: BODY, seq, from_offset, to_offset, target.
    """
    order = Window.partitionBy(*BODY).orderBy("seq")
    code = code.select(*BODY, "seq", "offset", "size", "mnemonic", "operands")
    ends = F.col("mnemonic").isin(*fixed.BRANCHES, "lookupswitch", *TERMINATORS)
    marks = _jump_targets(code).select(*BODY, F.col("to").alias("offset"))
    if handlers is not None:
        marks = marks.unionByName(handlers.select(*BODY, F.explode(F.array("from_offset", "to_offset", "target")).alias("offset")))
    marks = marks.distinct().withColumn("marked", F.lit(True))
    rows = code.join(marks, [*BODY, "offset"], "left")
    leads = F.coalesce("marked", F.lit(False)) | F.coalesce(F.lag(ends).over(order), F.lit(True))
    rows = rows.withColumn("lead", leads).withColumn("block", F.sum(F.col("lead").cast("int")).over(order) - 1)
    last = F.max_by(F.struct("mnemonic", "offset", "size", "operands"), "seq").alias("last")
    out = rows.groupBy(*BODY, "block").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("size")).alias("end"), F.count("*").alias("n"), last)
    out = out.withColumn("terminator", F.when(F.col("last.mnemonic").isin(*fixed.BRANCHES, "lookupswitch", *TERMINATORS), F.col("last.mnemonic")).otherwise("fallthrough"))
    starts = out.select(*BODY, F.col("block").alias("dst"), F.col("start").alias("to"))
    last_of = out.select(*BODY, F.col("block").alias("src"), F.col("last.offset").alias("offset"))
    taken = last_of.join(_jump_targets(code), [*BODY, "offset"]).select(*BODY, "src", "pos", "to")
    falls = ~F.col("terminator").isin(*TERMINATORS, "jump", "lookupswitch")
    next_to = out.filter(falls).select(*BODY, F.col("block").alias("src"), F.lit(0).alias("pos"), F.col("end").alias("to"))
    edges = next_to.unionByName(taken).join(starts, [*BODY, "to"]).groupBy(*BODY, "src", "dst").agg(F.min("pos").alias("pos"))
    if handlers is None:
        cover = None
        out = out.withColumn("kind", F.when(F.col("terminator") == "lookupswitch", "switch").otherwise("normal"))
    else:
        h = handlers.select(*BODY, F.col("seq").alias("handler"), "from_offset", "to_offset", F.col("target").alias("catch_at"))
        cover = out.join(h, BODY).filter("from_offset <= start and start < to_offset and end <= to_offset").select(*BODY, "block", "handler")
        catches = h.select(*BODY, F.col("catch_at").cast("long").alias("start"), F.lit(True).alias("is_catch")).distinct()
        out = out.join(catches, [*BODY, "start"], "left")
        out = out.withColumn("kind", F.when(F.coalesce("is_catch", F.lit(False)), "catch_entry").when(F.col("terminator") == "lookupswitch", "switch").otherwise("normal")).drop("is_catch")
    return out.drop("last"), edges, cover


def complexity(blocks_: DataFrame, edges: DataFrame) -> DataFrame:
    """BODY, blocks, edges, complexity = max(1, edges - blocks + 2)."""
    b = blocks_.groupBy(*BODY).agg(F.count("*").alias("n_blocks"))
    e = edges.groupBy(*BODY).agg(F.count("*").alias("n_edges"))
    n = F.coalesce("n_edges", F.lit(0))
    return b.join(e, BODY, "left").select(*BODY, "n_blocks", n.alias("n_edges"), F.greatest(F.lit(1), n - F.col("n_blocks") + 2).alias("complexity"))


def register_accesses(code: DataFrame) -> DataFrame:
    """BODY, seq, offset, reg, is_read, is_write of every register access."""
    name, ops = F.col("mnemonic"), F.col("operands")
    first = F.get(ops, F.lit(0))
    short = F.regexp_extract(name, "^[gs]etlocal_([0-3])$", 1)
    regs = F.when(short != "", F.array(F.try_to_number(short, F.lit("9")).cast("bigint"))).when(name == "hasnext2", F.slice(ops, 1, 2)).when(name.isin("getlocal", "setlocal", "kill", "inclocal", "declocal", "inclocal_i", "declocal_i"), F.array(first))
    both = name.isin("inclocal", "declocal", "inclocal_i", "declocal_i", "hasnext2")
    rows = code.withColumn("regs", regs).filter("regs is not null and regs[0] is not null")
    return rows.select(*BODY, "seq", "offset", F.explode("regs").alias("reg"), (name.startswith("getlocal") | both).alias("is_read"), (name.startswith("setlocal") | (name == "kill") | both).alias("is_write"))


def liveness(accesses: DataFrame) -> DataFrame:
    """BODY, reg, reads, writes, first_write (in code order), last_read."""
    return accesses.groupBy(*BODY, "reg").agg(
        F.count_if("is_read").alias("reads"), F.count_if("is_write").alias("writes"),
        F.min_by(F.when(F.col("is_write"), F.col("offset")), F.when(F.col("is_write"), F.col("seq"))).alias("first_write"),
        F.max_by(F.when(F.col("is_read"), F.col("offset")), F.when(F.col("is_read"), F.col("seq"))).alias("last_read"),
    )


def register_use(live: DataFrame) -> DataFrame:
    """BODY, reg, is_unused, is_write_only, is_read_only; only registers that some instruction names have a row."""
    return live.select(*BODY, "reg", ((F.col("writes") == 0) & (F.col("reads") == 0)).alias("is_unused"), ((F.col("writes") > 0) & (F.col("reads") == 0)).alias("is_write_only"), ((F.col("reads") > 0) & (F.col("writes") == 0)).alias("is_read_only"))


def bigrams(code: DataFrame, top: int = 15, category: str = "category") -> DataFrame:
    """BODY, a, b, n, rank: the most frequent pairs of neighbouring categories, ties by first place."""
    order = Window.partitionBy(*BODY).orderBy("seq")
    pairs = code.select(*BODY, "seq", F.col(category).alias("a"), F.lead(category).over(order).alias("b")).filter("b is not null")
    counted = pairs.groupBy(*BODY, "a", "b").agg(F.count("*").alias("n"), F.min("seq").alias("at"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*BODY).orderBy(F.col("n").desc(), "at")))
    return ranked.filter(F.col("rank") <= top).drop("at")


def op_counts(code: DataFrame) -> DataFrame:
    """BODY and the counts of a method's fingerprint; an instruction counts in one family at most."""
    name = F.col("mnemonic")
    family = (
        F.when(name.isin(*fixed.BRANCHES), "branch").when(name == "lookupswitch", "switch").when(name.isin(*fixed.CALLS), "call").when(name.isin(*fixed.CONSTRUCTS), "construct")
        .when(name == "getproperty", "getprop").when(name.isin("setproperty", "initproperty"), "setprop").when(name == "getlex", "getlex").when(name == "newarray", "newarray")
        .when(name == "newobject", "newobject").when(name.isin(*fixed.ARITHMETIC), "arithmetic").when(name.isin(*fixed.COMPARISONS), "comparison").when(name.isin(*fixed.BITWISE), "bitwise")
        .when(name.isin(*fixed.COERCIONS), "coerce").when(name == "returnvalue", "returnvalue").when(name == "throw", "throw")
    )
    rows = code.withColumn("family", family)
    n = lambda f, alias: F.count_if(F.col("family") == f).alias(alias)
    listed = lambda *ops: F.sort_array(F.collect_list(F.when(name.isin(*ops), F.col("constant"))))
    # pushbyte and pushshort count raw, other constants by their pool value
    raw = name.isin("pushbyte", "pushshort")
    rows = rows.withColumn("constant", F.when(raw, F.get("operands", F.lit(0)).cast("string")).when(name.isin("pushint", "pushuint"), F.col("literal.i").cast("string")).when(name == "pushdouble", F.col("literal.d").cast("string")).when(name == "pushstring", F.col("string_value")))
    ints = F.sort_array(F.collect_list(F.when(name.isin("pushbyte", "pushshort", "pushint"), F.col("constant").cast("bigint"))))
    uints = F.sort_array(F.collect_list(F.when(name == "pushuint", F.col("constant").cast("bigint"))))
    doubles = F.sort_array(F.collect_list(F.when(name == "pushdouble", F.col("literal.d"))))
    cases = F.sort_array(F.collect_list(F.when(F.col("family") == "switch", F.get("operands", F.lit(1)))))
    return rows.groupBy(*BODY).agg(
        F.count("*").alias("instr_count"), n("branch", "branch_count"), cases.alias("switch_cases"), n("call", "call_count"), n("construct", "construct_count"),
        n("getprop", "getprop_count"), n("setprop", "setprop_count"), n("getlex", "getlex_count"), n("newarray", "newarray_count"), n("newobject", "newobject_count"),
        n("arithmetic", "arithmetic_ops"), n("comparison", "comparison_ops"), n("bitwise", "bitwise_ops"), n("coerce", "coerce_count"),
        (F.count_if(F.col("family") == "returnvalue") == 0).alias("return_void"), n("throw", "throw_count"),
        ints.alias("int_constants"), uints.alias("uint_constants"), doubles.alias("double_constants"), listed("pushstring").alias("string_constants"),
    )


def normal_type(t):
    return F.when(t.isin(*fixed.BUILTIN_TYPES), t).otherwise("?")


def fingerprints(code: DataFrame, methods: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row per method or constructor with a body and instructions: signature, sizes, counts, bigrams.

    `methods`: resource_id, abc_id, class_name, method_name, is_constructor, param_types, return_type,
    is_static, is_getter, is_setter, body_index.  `bodies`: BODY, code_size, max_stack, local_count, exception_count.
    """
    top = bigrams(code.withColumn("category", C.category(F.col("mnemonic"))))
    top = top.groupBy(*BODY).agg(F.array_sort(F.collect_list(F.struct("rank", "a", "b", "n"))).alias("opcode_bigrams"))
    rows = methods.join(bodies, BODY).join(op_counts(code), BODY).join(top, BODY, "left")
    return rows.withColumns({"param_count": F.size("param_types"), "param_types_builtin": F.transform("param_types", normal_type), "return_type": normal_type(F.col("return_type"))}).drop("param_types")


def increments(code: DataFrame) -> DataFrame:
    """BODY, seq, reg, op: a register read, incremented or decremented, and written back."""
    order = Window.partitionBy(*BODY).orderBy("seq")
    reg = lambda prefix: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("mnemonic", f"^{prefix}_([0-3])$", 1), F.lit("")), F.lit("9")).cast("bigint"), F.when(F.col("mnemonic") == prefix, F.get("operands", F.lit(0))))
    rows = code.select(*BODY, "seq", reg("getlocal").alias("reg"), F.lead("mnemonic", 1).over(order).alias("op"), F.lead(reg("setlocal"), 2).over(order).alias("into"))
    return rows.filter(F.col("reg").isNotNull() & (F.col("reg") == F.col("into")) & F.col("op").isin("increment", "increment_i", "decrement", "decrement_i")).drop("into")
