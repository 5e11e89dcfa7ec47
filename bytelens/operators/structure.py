"""Lookups and filters over classes, fields and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Model


def get_class(m: Model, name: str) -> DataFrame:
    """The class of a simple or qualified name; the one loaded last wins."""
    return m.classes.filter((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy(F.col("load_seq").desc()).limit(1)


def winners(m: Model) -> DataFrame:
    """key, qualified_name: what every simple and qualified name stands for."""
    both = m.classes.select(F.col("name").alias("key"), "qualified_name", "load_seq").unionByName(m.classes.select(F.col("qualified_name").alias("key"), "qualified_name", "load_seq"))
    return both.groupBy("key").agg(F.max_by("qualified_name", "load_seq").alias("qualified_name"))


def find_classes(m: Model, name: str | None = None, extends: str | None = None, implements: str | None = None, package: str | None = None, is_interface: bool | None = None) -> DataFrame:
    """Classes that meet all conditions; `name` is a case-sensitive part of the simple name."""
    rows = m.classes
    if name is not None:
        rows = rows.filter(F.col("name").contains(name))
    if extends is not None:
        rows = rows.filter(F.col("super_name") == extends)
    if implements is not None:
        rows = rows.filter(F.array_contains("interfaces", implements))
    if package is not None:
        rows = rows.filter(F.col("package") == package)
    if is_interface is not None:
        rows = rows.filter(F.col("is_interface") == is_interface)
    return rows


def search_classes(m: Model, text: str) -> DataFrame:
    """Classes whose qualified name contains the text, whatever the case."""
    return m.classes.filter(F.lower("qualified_name").contains(text.lower()))


def find_fields(m: Model, name: str | None = None, type_name: str | None = None, is_static: bool | None = None) -> DataFrame:
    rows = m.fields
    if name is not None:
        rows = rows.filter(F.col("name").contains(name))
    if type_name is not None:
        rows = rows.filter(F.col("type_name") == type_name)
    if is_static is not None:
        rows = rows.filter(F.col("is_static") == is_static)
    return rows


def find_methods(m: Model, name: str | None = None, return_type: str | None = None, param_type: str | None = None, is_static: bool | None = None) -> DataFrame:
    rows = m.methods
    if name is not None:
        rows = rows.filter(F.col("name").contains(name))
    if return_type is not None:
        rows = rows.filter(F.col("return_type") == return_type)
    if param_type is not None:
        rows = rows.filter(F.array_contains("param_types", param_type))
    if is_static is not None:
        rows = rows.filter(F.col("is_static") == is_static)
    return rows


def with_field_type(m: Model, type_name: str) -> DataFrame:
    """The classes that have a field of the type."""
    users = m.fields.filter(F.col("type_name") == type_name).select(F.col("class_name").alias("qualified_name"))
    return m.classes.join(users, "qualified_name", "left_semi")


def with_method_returning(m: Model, type_name: str) -> DataFrame:
    users = m.methods.filter(F.col("return_type") == type_name).select(F.col("class_name").alias("qualified_name"))
    return m.classes.join(users, "qualified_name", "left_semi")


def lookup(m: Model, name: str) -> DataFrame:
    """The classes that a name may stand for: those of that qualified or simple name, else all whose qualified name contains it."""
    rows = m.classes.withColumn("exact", (F.col("qualified_name") == name) | (F.col("name") == name))
    rows = rows.filter(F.col("exact") | F.col("qualified_name").contains(name))
    best = rows.agg(F.max("exact").alias("best"))
    return rows.crossJoin(F.broadcast(best)).filter(F.col("exact") == F.col("best")).drop("exact", "best")


def member(rows: DataFrame, class_name: str, name: str) -> DataFrame:
    """The first member of that name: instance before static, then by trait order."""
    return rows.filter((F.col("class_name") == class_name) & (F.col("name") == name)).orderBy("is_static", "trait_index").limit(1)
