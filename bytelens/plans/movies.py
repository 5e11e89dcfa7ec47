"""Containers around the blocks of `archive`: written, read, taken apart and built again.

A movie holds the block of 64 customers, a small second block and a symbol table; every block is
also a bundle.  Queries run from container bytes to answers that SQL gives from the tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec import block as B
from ..codec import container
from ..codec.builder import BlockBuilder
from ..codec.names import dotted
from ..functions.fixed import TAGS
from ..kernels import decompile
from ..session import Workspace
from ..sources import files, pools
from ..sources.files import Files, arrow_schema
from .archive import CLASSES_PER_BLOCK, class_blocks

CONTENT = "resource_id long, path string, content binary"
VERSION = 40
ATTRIBUTES, BACKGROUND, FRAME = 69, 9, 1
#: Bundles start with so many bytes before their compressed block.
LEAD = b"\1\2\3"


def extra_block() -> bytes:
    b = BlockBuilder()
    b.klass("extra.Extra")
    return b.build()


def movie_of(number: int, block: bytes) -> bytes:
    """Every second movie is compressed."""
    parsed = B.parse(block)
    names = [dotted(parsed, c.name) for c in parsed.instances]
    m = container.MovieBuilder(version=VERSION)
    m.add_tag(container.Tag(ATTRIBUTES, b"\x08\0\0\0")).add_tag(container.Tag(BACKGROUND, b"\xff\xff\xff"))
    m.add_block(block, f"frame_{number}").add_block(extra_block(), "extra").add_tag(container.Tag(FRAME, b""))
    for k, name in enumerate(names):
        m.add_symbol(k + 1, name)
    return m.set_document_class(names[0]).build(compress=number % 2 == 0)


def bundle_of(number: int, block: bytes) -> bytes:
    return (block, zlib.compress(block), LEAD + zlib.compress(block))[number % 3]


def packed(make, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch["resource_id"].to_pylist(), batch["data"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"resource_id": number, "path": path.format(number), "content": make(number, data)}], arrow_schema(CONTENT))

    return run


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_blocks(spark, sf_dir).mapInArrow(packed(movie_of, "movie_{}.swf"), CONTENT)


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_blocks(spark, sf_dir).mapInArrow(packed(bundle_of, "bundle_{}.swz"), CONTENT)


def paths(df: DataFrame, f: Files) -> DataFrame:
    """`df` with the path of its resource instead of the number."""
    return df.join(f.resources.select("resource_id", "path"), "resource_id").drop("resource_id")


# --- queries --------------------------------------------------------------------------------------


def mov_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies and bundles together: the kind follows the path."""
    both = Files(movies(spark, sf_dir).unionByName(bundles(spark, sf_dir)))
    return both.resources.select("path", "kind", "version", F.col("error").isNotNull().alias("unreadable"))


def mov_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of damaged files, an error each, and nothing else."""
    bad = movies(spark, sf_dir).withColumn("content", F.concat(F.lit("XYZ").cast("binary"), F.substring("content", 4, 40)))
    f = Files(bad)
    return f.resources.select("path", F.col("error").isNotNull().alias("unreadable"))


def mov_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Files(movies(spark, sf_dir))
    return paths(f.tags, f).select("path", "tag_seq", "tag_type", "type_name", F.coalesce("name", F.lit("")).alias("name"))


def mov_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Files(movies(spark, sf_dir))
    return paths(f.symbols, f).select("path", "char_id", "class_name", "is_document")


def mov_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytecode tags of the movies, and whether their block is the one that was put in."""
    f = Files(movies(spark, sf_dir))
    put = class_blocks(spark, sf_dir).select("resource_id", F.sha2("data", 256).alias("want"))
    rows = f.blocks.join(put, "resource_id")
    extra = F.sha2(F.lit(bytearray(extra_block())), 256)
    return rows.select("path", "abc_id", "name", (F.sha2("data", 256) == F.when(F.col("abc_id") == 2, F.col("want")).otherwise(extra)).alias("same"))


def mov_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Files(bundles(spark, sf_dir))
    return f.model().classes.groupBy("resource_id").agg(F.count("*").alias("n_classes")).join(f.resources, "resource_id").select("path", "n_classes")


def mov_first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompile.first_blocks(Files(movies(spark, sf_dir)).blocks).select("path", "abc_id", "name")


def mov_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies built again from their parts, compressed or not: the number of tags, and whether every payload is as before."""
    f = Files(movies(spark, sf_dir))
    out = None
    for compress in (True, False):
        again = Files(files.rebuild(f.parts, compress=compress).withColumnRenamed("data", "content"))
        both = f.tags.select("resource_id", "tag_seq", "payload").join(again.tags.select("resource_id", "tag_seq", F.col("payload").alias("new")), ["resource_id", "tag_seq"], "full")
        rows = both.groupBy("resource_id").agg(F.count("*").alias("n_tags"), F.every(F.col("payload").eqNullSafe(F.col("new"))).alias("same"))
        rows = paths(rows, f).withColumn("compressed", F.lit(compress))
        out = rows if out is None else out.unionByName(rows)
    return out


def mov_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to rows, strings changed there, rows to blocks, blocks into the movies, movies to classes."""
    f = Files(movies(spark, sf_dir)).kept()
    files.sweep(spark)
    blocks = files.patch(f.blocks, f.rows_of("string").filter(F.col("s") == "extra").withColumn("s", F.lit("changed")))
    again = Files(files.rebuild(f.parts, blocks).withColumnRenamed("data", "content"))
    return paths(again.model().classes.select("resource_id", "qualified_name"), f)


def mov_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools' strings that name methods."""
    return Files(movies(spark, sf_dir)).model().pool_strings.filter(F.col("string").startswith("m_")).select("string")


def mov_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the pools' names of customers, and of their namespaces."""
    names = Files(movies(spark, sf_dir)).names
    return names.filter(F.col("package").startswith("crm.")).select("full_name", "kind", "ns_kind").distinct()


def mov_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the pools of names, as the command line shows them, without their numbers."""
    lines = pools.pools(Files(movies(spark, sf_dir)))
    rows = lines.filter((F.col("pool") == "multinames") & F.col("key").contains("Customer#"))
    return rows.select(F.regexp_replace("line", r"^\[\d+\] ", "").alias("line")).distinct()


def mov_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class summaries of all movies, the second block's class of each among them."""
    rows = Workspace(Files(movies(spark, sf_dir))).class_summaries()
    return rows.groupBy("full_name", "super", "is_interface", "trait_count").agg(F.count("*").alias("n"))


def mov_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Files(movies(spark, sf_dir)).model().methods
    return rows.select("class_name", "name", "trait_index", "is_static", "is_getter", "is_setter", "is_override", F.array_join("param_types", ",").alias("params"), (F.col("body_index") >= 0).alias("has_body"))


def mov_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of methods and constructors."""
    rows = Workspace(Files(movies(spark, sf_dir))).fingerprints().filter(F.col("class_name").startswith("crm."))
    return rows.select("class_name", "method_name", "is_constructor", "param_count", "exception_count", "instr_count", "call_count", "construct_count", "getprop_count", "setprop_count", "branch_count", "return_void", F.array_join("int_constants", ",").alias("ints"))


def mov_decompile_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of every method, one a row."""
    rows = decompile.methods(Files(movies(spark, sf_dir)).blocks).filter(F.col("method_name").startswith("m_"))
    line = F.explode(F.split("source", "\n")).alias("line")
    return rows.select("class_name", "method_name", line).select("class_name", "method_name", F.trim("line").alias("line")).filter(F.col("line").contains(" = ")).groupBy("class_name", "method_name", "line").agg(F.count("*").alias("n"))


def mov_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as SQL views: classes and members by package."""
    ws = Workspace(Files(movies(spark, sf_dir)))
    ws.view_all("mov_")
    return spark.sql("SELECT c.package, count(DISTINCT c.qualified_name) AS n_classes, count(m.name) AS n_methods FROM mov_classes c LEFT JOIN mov_methods m ON m.class_name = c.qualified_name WHERE c.package LIKE 'crm.%' GROUP BY c.package")


QUERIES = {f.__name__: f for f in (mov_resources, mov_broken, mov_tags, mov_symbols, mov_blocks, mov_bundles, mov_first_blocks, mov_rebuild, mov_edit, mov_strings, mov_names, mov_pool, mov_summaries, mov_members, mov_fingerprints, mov_decompile_methods, mov_views)}

OWN = f""", own AS (
  SELECT c_custkey, c_custkey // {CLASSES_PER_BLOCK} AS block, name, package, qualified_name, super_qualified FROM customer JOIN classes ON name = c_name AND starts_with(package, 'crm.')
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY c_custkey) AS k FROM own
), movie AS (
  SELECT DISTINCT block, 'movie_' || block || '.swf' AS path FROM own
)"""
KINDS = ", ".join(f"({k}, {kind}, '{TAGS[kind]}')" for k, kind in enumerate((ATTRIBUTES, BACKGROUND, container.DO_ABC2, container.DO_ABC2, FRAME, container.SYMBOLS, container.END)))
ORACLES = {
    "mov_resources": f"SELECT path, 'swf' AS kind, {VERSION} AS version, false AS unreadable FROM movie UNION ALL SELECT 'bundle_' || block || '.swz', 'swz', NULL, false FROM movie",
    "mov_broken": "SELECT path, true AS unreadable FROM movie",
    "mov_tags": f"SELECT path, CAST(k AS INTEGER) AS tag_seq, kind AS tag_type, type AS type_name, CASE k WHEN 2 THEN 'frame_' || block WHEN 3 THEN 'extra' ELSE '' END AS name FROM movie, (VALUES {KINDS}) t(k, kind, type)",
    "mov_symbols": "SELECT path, CAST(k AS INTEGER) AS char_id, qualified_name AS class_name, false AS is_document FROM numbered JOIN movie USING (block) UNION ALL SELECT path, 0, qualified_name, true FROM numbered JOIN movie USING (block) WHERE k = 1",
    "mov_blocks": "SELECT path, 2 AS abc_id, 'frame_' || block AS name, true AS same FROM movie UNION ALL SELECT path, 3, 'extra', true FROM movie",
    "mov_bundles": "SELECT 'bundle_' || block || '.swz' AS path, count(*) AS n_classes FROM own GROUP BY block",
    "mov_first_blocks": "SELECT path, 2 AS abc_id, 'frame_' || block AS name FROM movie",
    "mov_rebuild": "SELECT path, CAST(7 AS BIGINT) AS n_tags, true AS same, compressed FROM movie, (VALUES (true), (false)) t(compressed)",
    "mov_edit": "SELECT path, qualified_name FROM own JOIN movie USING (block) UNION ALL SELECT path, 'changed.Extra' FROM movie",
    "mov_strings": "SELECT 'm_' || o_orderkey AS string FROM orders JOIN own ON o_custkey = c_custkey",
    "mov_names": "SELECT qualified_name AS full_name, 7 AS kind, 22 AS ns_kind FROM own",
    "mov_pool": "SELECT '0x07 ' || qualified_name AS line FROM own",
    "mov_summaries": (
        "SELECT qualified_name AS full_name, super_qualified AS super, false AS is_interface, count(o_orderkey) AS trait_count, CAST(1 AS BIGINT) AS n FROM own LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL "
        "UNION ALL SELECT 'extra.Extra', 'Object', false, 0, count(*) FROM movie"
    ),
    "mov_members": (
        "SELECT qualified_name AS class_name, 'm_' || o_orderkey AS name, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS trait_index, false AS is_static, false AS is_getter, false AS is_setter, "
        "false AS is_override, o_orderpriority AS params, o_orderkey IN (SELECT l_orderkey FROM items) AS has_body FROM own JOIN orders ON o_custkey = c_custkey"
    ),
    "mov_fingerprints": (
        "SELECT class_name, member_name AS method_name, false AS is_constructor, 1 AS param_count, CAST(0 AS BIGINT) AS exception_count, 3 * count(*) AS instr_count, count(*) FILTER (WHERE mnemonic = 'callproperty') AS call_count, "
        "count(*) FILTER (WHERE mnemonic = 'constructprop') AS construct_count, count(*) FILTER (WHERE mnemonic = 'getproperty') AS getprop_count, count(*) FILTER (WHERE mnemonic = 'setproperty') AS setprop_count, "
        "CAST(0 AS BIGINT) AS branch_count, true AS return_void, string_agg(qty, ',' ORDER BY qty) AS ints FROM items GROUP BY class_name, member_name "
        "UNION ALL SELECT qualified_name, '<constructor>', true, 0, 0, 5, 0, 1, 0, 0, 0, true, '' FROM own"
    ),
    "mov_decompile_methods": "SELECT class_name, member_name AS method_name, '\"' || p_name || '\".' || target || ' = ' || qty || ';' AS line, count(*) AS n FROM items WHERE mnemonic = 'setproperty' GROUP BY ALL",
    "mov_views": "SELECT package, count(DISTINCT qualified_name) AS n_classes, count(o_orderkey) AS n_methods FROM own LEFT JOIN orders ON o_custkey = c_custkey GROUP BY package",
}
ORACLES = {name: f"{OWN} {sql}" for name, sql in ORACLES.items()}
