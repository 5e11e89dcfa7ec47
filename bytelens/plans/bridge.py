"""The star schema as a code model, so that every operator can be checked against SQL on Parquet.

Regions, nations, customers and suppliers are classes; orders are methods of their customer's class;
line items are instructions of their order's body.  `SQL` states the same tables in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.model import CLASSES, CODE, FIELDS, LITERAL, METHODS, Model, schema


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """`df` with exactly the columns of a schema; those that it lacks are null."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(ddl)))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = F.concat(F.lit("geo."), F.lower("r_name"))
    none = F.array().cast("array<string>")

    def rows(df, level, key, name, package, super_name, super_package, interfaces):
        return df.select(
            (F.lit(level * 1_000_000_000) + key).cast("long").alias("load_seq"), name.alias("name"), package.alias("package"), super_name.alias("super_name"), super_package.alias("super_package"),
            interfaces.alias("interfaces"), F.lit(False).alias("is_interface"), F.lit(False).alias("is_sealed"), F.lit(False).alias("is_final"),
        )

    regions = rows(region, 0, F.col("r_regionkey"), F.col("r_name"), F.lit("geo"), F.lit("Object"), F.lit(""), none)
    nations = rows(places, 1, F.col("n_nationkey"), F.col("n_name"), geo, F.col("r_name"), F.lit("geo"), none)
    small = F.broadcast(places.select("n_nationkey", "n_name", "r_name"))
    customers = read(spark, sf_dir, "customer").join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    crm = F.concat(F.lit("crm."), F.lower("c_mktsegment"))
    customers = rows(customers, 2, F.col("c_custkey"), F.col("c_name"), crm, F.col("n_name"), geo, F.array(F.concat(F.lit("I"), "c_mktsegment")))
    suppliers = read(spark, sf_dir, "supplier").join(small, F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = rows(suppliers, 3, F.col("s_suppkey"), F.col("s_name"), F.lit("sup"), F.col("n_name"), geo, none)
    out = regions.unionByName(nations).unionByName(customers).unionByName(suppliers)
    dotted = lambda p, n: F.when(p == "", n).otherwise(F.concat(p, F.lit("."), n))
    out = out.withColumns({"qualified_name": dotted(F.col("package"), F.col("name")), "super_qualified": dotted(F.col("super_package"), F.col("super_name")), "resource_id": F.lit(0), "abc_id": F.lit(0)})
    return shaped(out, CLASSES)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, its customer's class and the names of its method."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("crm."), F.lower("c_mktsegment"), F.lit("."), "c_name").alias("class_name"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    member = F.concat(F.lit("m_"), F.col("o_orderkey").cast("string"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("member_name", member)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    made = items.select("l_suppkey", "p_brand", "p_type").distinct().join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.concat(F.lit("f_"), "p_brand")
    made = made.select(F.concat(F.lit("sup."), "s_name").alias("class_name"), name.alias("name"), F.col("p_type").alias("type_name"), F.lit(False).alias("is_static"), F.lit(False).alias("is_const"), F.lit(0).alias("resource_id"), F.lit(0).alias("abc_id"))
    return shaped(made, FIELDS)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("o_orderstatus") == "F", "void").when(F.col("o_orderstatus") == "O", "int").when(F.col("o_orderstatus") == "P", "String")
    rows = owners(spark, sf_dir).select(
        "class_name", F.col("c_name").alias("simple_class"), F.col("member_name").alias("name"), kinds.alias("return_type"), F.array("o_orderpriority").alias("param_types"),
        F.col("o_orderkey").alias("method_index"), F.col("o_orderkey").cast("int").alias("body_index"), F.lit(0).alias("resource_id"), F.lit(0).alias("abc_id"),
        *(F.lit(False).alias(c) for c in ("is_static", "is_getter", "is_setter", "is_override")),
    )
    return shaped(rows, METHODS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, rn, p_name, l_quantity, mnemonic, target: line items in order, with what they push and how they use it."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.row_number().over(order).alias("rn"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    items = items.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    flag, used = F.col("l_returnflag"), F.lit("constructprop")
    name = F.when(flag == "A", "callproperty").when(flag == "N", "getproperty").when(F.col("l_linestatus") == "F", "setproperty").otherwise(used)
    target = F.when(flag == "A", F.col("p_type")).when(flag == "N", F.col("p_brand")).when(F.col("l_linestatus") == "F", F.col("p_brand")).otherwise(F.col("s_name"))
    return items.select("l_orderkey", "rn", "p_name", "l_quantity", name.alias("mnemonic"), target.alias("target"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three instructions a line item: its part's name and quantity are pushed, then used."""
    found = items(spark, sf_dir).withColumnsRenamed({"mnemonic": "name", "target": "used"}).join(owners(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    name, target = F.col("name"), F.col("used")
    none = lambda t: F.lit(None).cast(t)
    text = F.struct(F.lit("str").alias("kind"), F.col("p_name").alias("s"), none("bigint").alias("i"), none("double").alias("d"), none("boolean").alias("b"))
    number = F.struct(F.lit("int").alias("kind"), none("string").alias("s"), F.col("l_quantity").cast("bigint").alias("i"), none("double").alias("d"), none("boolean").alias("b"))
    step = lambda k, mnemonic, tgt, string, lit, args: F.struct(F.lit(k).alias("k"), mnemonic.alias("mnemonic"), tgt.alias("target"), string.alias("string_value"), lit.alias("literal"), args.alias("arg_count"))
    nothing = F.lit(None).cast(LITERAL)
    args = F.when(name.isin("callproperty", "constructprop"), F.lit(2).cast("bigint"))
    steps = F.array(
        step(0, F.lit("pushstring"), none("string"), F.col("p_name"), text, none("bigint")),
        step(1, F.lit("pushbyte"), none("string"), none("string"), number, none("bigint")),
        step(2, name, target, none("string"), nothing, args),
    )
    rows = found.select("l_orderkey", "rn", "class_name", "member_name", "c_name", F.explode(steps).alias("x")).select("*", "x.*")
    opcode = F.element_at(F.create_map(*(F.lit(v) for k in ("pushstring", "pushbyte", "callproperty", "getproperty", "setproperty", "constructprop") for v in (k, fixed.OP[k]))), F.col("mnemonic"))
    seq = (3 * (F.col("rn") - 1) + F.col("k")).cast("long")
    rows = rows.select(
        F.lit(0).alias("resource_id"), F.lit(0).alias("abc_id"), F.col("l_orderkey").alias("body_index"), F.col("l_orderkey").alias("method_index"), seq.alias("seq"), seq.alias("offset"), opcode.alias("opcode"),
        "mnemonic", F.lit(1).alias("size"), F.lit(False).alias("after_unknown"), "target", "string_value", "literal", "arg_count", "class_name", "member_name",
        F.concat("c_name", F.lit("."), "member_name").alias("cg_name"), F.concat("class_name", F.lit("."), "member_name").alias("ca_name"),
    )
    return shaped(rows, CODE)


def model(spark: SparkSession, sf_dir: str) -> Model:
    strings = read(spark, sf_dir, "part").select(F.col("p_name").alias("string")).distinct()
    return Model(classes(spark, sf_dir), fields(spark, sf_dir), methods(spark, sf_dir), code(spark, sf_dir), strings)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings: document and benchmark texts, URLs, part names, and markers of every part."""
    part = read(spark, sf_dir, "part").select("p_name")
    sources = (("documents", "text"), ("pages", "url"), ("benchmark", "text"))
    out = part.select(F.col("p_name").alias("string")).unionByName(part.select(F.concat(F.lit("["), "p_name", F.lit("]")).alias("string")))
    for name, column in sources:
        out = out.unionByName(read(spark, sf_dir, name).select(F.col(column).alias("string")))
    return out


def event_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bodies: a user is a body, an event type a category and a register."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.lit(0).alias("resource_id"), F.lit(0).alias("abc_id"), F.col("user_id").alias("body_index"), (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "event_type",
    )


SQL = """
classes AS (
  SELECT r_regionkey AS load_seq, r_name AS name, 'geo' AS package, 'geo.' || r_name AS qualified_name, 'Object' AS super_name, 'Object' AS super_qualified, NULL AS iface FROM region
  UNION ALL SELECT 1000000000 + n_nationkey, n_name, 'geo.' || lower(r_name), 'geo.' || lower(r_name) || '.' || n_name, r_name, 'geo.' || r_name, NULL
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 2000000000 + c_custkey, c_name, 'crm.' || lower(c_mktsegment), 'crm.' || lower(c_mktsegment) || '.' || c_name, n_name, 'geo.' || lower(r_name) || '.' || n_name, 'I' || c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 3000000000 + s_suppkey, s_name, 'sup', 'sup.' || s_name, n_name, 'geo.' || lower(r_name) || '.' || n_name, NULL
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), fields AS (
  SELECT DISTINCT 'sup.' || s_name AS class_name, 'f_' || p_brand AS name, p_type AS type_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
), methods AS (
  SELECT 'crm.' || lower(c_mktsegment) || '.' || c_name AS class_name, c_name AS simple_class, 'm_' || o_orderkey AS name, o_orderkey AS method_index,
    CASE o_orderstatus WHEN 'F' THEN 'void' WHEN 'O' THEN 'int' WHEN 'P' THEN 'String' END AS return_type, o_orderpriority AS param
  FROM orders JOIN customer ON o_custkey = c_custkey
), items AS (
  SELECT l_orderkey, p_name, CAST(l_quantity AS BIGINT) AS qty, m.class_name, m.simple_class, m.name AS member_name, rn,
    CASE WHEN l_returnflag = 'A' THEN 'callproperty' WHEN l_returnflag = 'N' THEN 'getproperty' WHEN l_linestatus = 'F' THEN 'setproperty' ELSE 'constructprop' END AS mnemonic,
    CASE WHEN l_returnflag = 'A' THEN p_type WHEN l_returnflag = 'N' THEN p_brand WHEN l_linestatus = 'F' THEN p_brand ELSE s_name END AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem)
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN methods m ON m.method_index = l_orderkey
), code AS (
  SELECT l_orderkey AS method_index, CAST(3 * (rn - 1) AS BIGINT) AS seq, 'pushstring' AS mnemonic, CAST(NULL AS VARCHAR) AS target, p_name AS string, class_name, simple_class, member_name FROM items
  UNION ALL SELECT l_orderkey, CAST(3 * (rn - 1) + 1 AS BIGINT), 'pushbyte', NULL, NULL, class_name, simple_class, member_name FROM items
  UNION ALL SELECT l_orderkey, CAST(3 * (rn - 1) + 2 AS BIGINT), mnemonic, target, NULL, class_name, simple_class, member_name FROM items
), refs AS (
  SELECT class_name AS source_class, name AS source_member, type_name AS target, 'field_type' AS ref_kind, CAST(-1 AS BIGINT) AS method_index, CAST(-1 AS BIGINT) AS offset_ FROM fields
  UNION ALL SELECT class_name, name, return_type, 'return_type', -1, -1 FROM methods WHERE return_type IS NOT NULL
  UNION ALL SELECT class_name, name, param, 'param_type', -1, -1 FROM methods WHERE param IS NOT NULL
  UNION ALL SELECT qualified_name, '<extends>', super_qualified, 'extends', -1, -1 FROM classes WHERE super_name <> 'Object'
  UNION ALL SELECT qualified_name, '<implements>', iface, 'implements', -1, -1 FROM classes WHERE iface IS NOT NULL
  UNION ALL SELECT class_name, member_name, target, CASE mnemonic WHEN 'constructprop' THEN 'instantiation' ELSE 'call' END, method_index, seq FROM code WHERE mnemonic IN ('callproperty', 'constructprop')
  UNION ALL SELECT class_name, member_name, string, 'string_use', method_index, seq FROM code WHERE mnemonic = 'pushstring'
), acc AS (
  SELECT class_name, member_name AS method_name, target AS field_name, CASE mnemonic WHEN 'getproperty' THEN 'read' ELSE 'write' END AS access_type, method_index, seq
  FROM code WHERE mnemonic IN ('getproperty', 'setproperty')
), edges AS (
  SELECT simple_class || '.' || member_name AS caller, method_index, target, mnemonic, seq,
    CASE mnemonic WHEN 'callproperty' THEN 'call' WHEN 'constructprop' THEN 'construct' WHEN 'getproperty' THEN 'read' ELSE 'write' END AS edge_type
  FROM code WHERE target IS NOT NULL
), texts AS (
  SELECT text AS string FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM benchmark UNION ALL SELECT '[' || p_name || ']' FROM part
), events_seq AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events
)
"""
