"""The graph of classes with typed edges, dead code and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from . import calls, inheritance
from .model import Model
from .references import references


def normal_super(name):
    """Built-in superclasses by name, others as ?."""
    return F.when(name.isin(*fixed.BUILTIN_TYPES), name).otherwise("?")


def nodes(m: Model) -> DataFrame:
    """One node per simple class name (the class loaded last wins) with its intrinsic features."""
    last = m.classes.groupBy("name").agg(F.max_by(F.struct("qualified_name", "package", "super_name", "is_interface", "is_sealed", "resource_id", "abc_id"), "load_seq").alias("x")).select("name", "x.*")
    methods = m.methods.groupBy("resource_id", "abc_id", F.col("class_name").alias("qualified_name")).agg(F.count_if(~F.col("is_static")).alias("method_count"), F.count_if(F.col("is_static")).alias("static_method_count"))
    fields = m.fields.groupBy("resource_id", "abc_id", F.col("class_name").alias("qualified_name")).agg(F.count_if(~F.col("is_static")).alias("field_count"), F.count_if(F.col("is_static")).alias("static_field_count"))
    key = ["resource_id", "abc_id", "qualified_name"]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("method_count", "static_method_count", "field_count", "static_field_count")]
    rows = last.join(methods, key, "left").join(fields, key, "left")
    return rows.select("name", "package", *counts, normal_super(F.col("super_name")).alias("super_name"), "is_interface", "is_sealed")


def _targets(m: Model) -> DataFrame:
    """target, node: qualified and simple names of loaded classes and their simple name."""
    both = m.classes.select(F.col("qualified_name").alias("target"), F.col("name").alias("node"), "load_seq").unionByName(m.classes.select(F.col("name").alias("target"), F.col("name").alias("node"), "load_seq"))
    return both.groupBy("target").agg(F.max_by("node", "load_seq").alias("node"))


def edges(m: Model, refs: DataFrame | None = None) -> DataFrame:
    """source, target (simple names), kind: with multiplicity; no framework types, no self edges."""
    refs = references(m) if refs is None else refs
    sources = m.classes.select(F.col("qualified_name").alias("source_class"), F.col("name").alias("source"))
    rows = refs.filter(F.col("ref_kind").isin(*fixed.CLASS_EDGE_KINDS)).join(sources, "source_class").join(_targets(m), "target")
    rows = rows.filter(~F.col("node").isin(*fixed.FRAMEWORK_TYPES) & (F.col("node") != F.col("source")))
    return rows.select("source", F.col("node").alias("target"), F.col("ref_kind").alias("kind"))


def degrees(e: DataFrame) -> DataFrame:
    """name, kind, out_degree, in_degree."""
    out = e.groupBy(F.col("source").alias("name"), "kind").agg(F.count("*").alias("out_degree"), F.lit(0).cast("long").alias("in_degree"))
    into = e.groupBy(F.col("target").alias("name"), "kind").agg(F.lit(0).cast("long").alias("out_degree"), F.count("*").alias("in_degree"))
    return out.unionByName(into).groupBy("name", "kind").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))


def total_degrees(m: Model, e: DataFrame) -> DataFrame:
    """name, degree: of every node, 0 without edges."""
    ends = e.select(F.col("source").alias("name")).unionByName(e.select(F.col("target").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))
    return m.classes.select("name").distinct().join(ends, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("degree"))


def string_pool(m: Model, refs: DataFrame | None = None) -> DataFrame:
    """string, classes: the simple names of the classes that use each string, sorted."""
    refs = references(m) if refs is None else refs
    rows = refs.filter("ref_kind = 'string_use'").join(m.classes.select(F.col("qualified_name").alias("source_class"), "name"), "source_class")
    return rows.groupBy(F.col("target").alias("string")).agg(F.array_sort(F.collect_set("name")).alias("classes"))


def code_sizes(m: Model, fingerprints: DataFrame) -> DataFrame:
    """class_name, code_size: summed over the fingerprints of its methods."""
    return fingerprints.groupBy("class_name").agg(F.sum("code_size").alias("code_size"))


def entrypoints(m: Model) -> DataFrame:
    """name: classes that are or descend from a base that the player instantiates."""
    own = m.classes.select(F.col("qualified_name").alias("name")).filter(F.col("name").isin(*fixed.ENTRYPOINT_BASES))
    below = inheritance.ancestors(m).filter(F.col("ancestor").isin(*fixed.ENTRYPOINT_BASES)).select("name")
    return own.unionByName(below).distinct()


def dead_classes(m: Model, refs: DataFrame | None = None) -> DataFrame:
    """name: classes that nothing refers to, without children, that are no entry points."""
    refs = references(m) if refs is None else refs
    rows = m.classes.select("qualified_name", "name").distinct()
    for used in (refs.select(F.col("target").alias("u")).distinct(), inheritance.child_edges(m).select(F.col("parent").alias("u")).distinct()):
        rows = rows.join(used, F.col("qualified_name") == F.col("u"), "left_anti").join(used, F.col("name") == F.col("u"), "left_anti")
    rows = rows.join(entrypoints(m).select(F.col("name").alias("u")), F.col("qualified_name") == F.col("u"), "left_anti")
    return rows.select(F.col("qualified_name").alias("name"))


def dead_methods(m: Model, e: DataFrame | None = None) -> DataFrame:
    """class_name, method_name, reason, is_override: no edge targets the name; accessors and life-cycle names left out."""
    e = calls.edges(m) if e is None else e
    rows = m.methods.filter(~F.col("is_getter") & ~F.col("is_setter") & ~F.col("name").isin(*fixed.LIFECYCLE_NAMES))
    rows = rows.join(e.select(F.col("target").alias("name")).distinct(), "name", "left_anti")
    return rows.select("class_name", F.col("name").alias("method_name"), F.lit("no callgraph edge targets this name").alias("reason"), "is_override")


def dead_code(m: Model, refs: DataFrame | None = None, e: DataFrame | None = None) -> DataFrame:
    """kind (class or method), class_name, method_name (null for a class): both kinds of dead code."""
    classes = dead_classes(m, refs).select(F.lit("class").alias("kind"), F.col("name").alias("class_name"), F.lit(None).cast("string").alias("method_name"))
    return classes.unionByName(dead_methods(m, e).select(F.lit("method").alias("kind"), "class_name", "method_name"))


def class_names(m: Model) -> DataFrame:
    """name: every simple and qualified name of a loaded class, once."""
    return m.classes.select(F.col("name")).unionByName(m.classes.select(F.col("qualified_name").alias("name"))).distinct()


def package(m: Model, name: str) -> DataFrame:
    """The row of `packages` of one package."""
    return packages(m).filter(F.col("package") == name)


def packages(m: Model) -> DataFrame:
    """package, classes (sorted simple names), class_count, interface_count."""
    return m.classes.groupBy("package").agg(F.array_sort(F.collect_list("name")).alias("classes"), F.count("*").alias("class_count"), F.count_if("is_interface").alias("interface_count"))
