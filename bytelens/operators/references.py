"""Cross references from traits and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .model import Model

TYPE_KINDS = ("field_type", "param_type", "return_type")


def _typed(name: Column) -> Column:
    return name.isNotNull() & (name != "") & (name != "*")


def _rows(df: DataFrame, source: str, member: Column, target: Column, kind: Column, method=None, offset=None) -> DataFrame:
    none = F.lit(-1).cast("long")
    return df.select(
        F.col(source).alias("source_class"), member.alias("source_member"), target.alias("target"), kind.alias("ref_kind"),
        (none if method is None else method.cast("long")).alias("method_index"), (none if offset is None else offset.cast("long")).alias("offset"),
    )


def trait_refs(m: Model) -> DataFrame:
    """Types of fields, returns and parameters, superclasses (qualified, Object left out) and interfaces."""
    name = F.col("name")
    fields = _rows(m.fields.filter(_typed(F.col("type_name"))), "class_name", name, F.col("type_name"), F.lit("field_type"))
    returns = _rows(m.methods.filter(_typed(F.col("return_type"))), "class_name", name, F.col("return_type"), F.lit("return_type"))
    params = m.methods.select("class_name", "name", F.explode("param_types").alias("t")).filter(_typed(F.col("t")))
    supers = m.classes.filter(_typed(F.col("super_name")) & (F.col("super_name") != "Object"))
    faces = m.classes.select("qualified_name", F.explode("interfaces").alias("t"))
    return (
        fields.unionByName(returns)
        .unionByName(_rows(params, "class_name", name, F.col("t"), F.lit("param_type")))
        .unionByName(_rows(supers, "qualified_name", F.lit("<extends>"), F.col("super_qualified"), F.lit("extends")))
        .unionByName(_rows(faces, "qualified_name", F.lit("<implements>"), F.col("t"), F.lit("implements")))
    )


def body_refs(m: Model) -> DataFrame:
    """Calls, instantiations, class and string uses in code."""
    kind = C.either(F.col("mnemonic"), fixed.REF_KINDS)
    code = m.scanned
    named = code.filter(F.col("mnemonic").isin(*fixed.REF_KINDS) & C.named(F.col("target")))
    strings = code.filter((F.col("mnemonic") == "pushstring") & F.col("string_value").isNotNull())
    at = (F.col("method_index"), F.col("offset"))
    return _rows(named, "class_name", F.col("member_name"), F.col("target"), kind, *at).unionByName(
        _rows(strings, "class_name", F.col("member_name"), F.col("string_value"), F.lit("string_use"), *at)
    )


def references(m: Model) -> DataFrame:
    return trait_refs(m).unionByName(body_refs(m))


def to_target(refs: DataFrame, target: str) -> DataFrame:
    return refs.filter(F.col("target") == target)


def from_class(refs: DataFrame, name: str) -> DataFrame:
    return refs.filter(F.col("source_class") == name)


def of_kind(refs: DataFrame, *kinds: str) -> DataFrame:
    return refs.filter(F.col("ref_kind").isin(*kinds))


def type_users(refs: DataFrame, target: str | None = None) -> DataFrame:
    """Users of a type as a field, parameter or return type (of every type if none is named)."""
    users = of_kind(refs, *TYPE_KINDS)
    return users if target is None else to_target(users, target)


def instantiators(refs: DataFrame, target: str | None = None) -> DataFrame:
    users = of_kind(refs, "instantiation")
    return users if target is None else to_target(users, target)


def string_users(refs: DataFrame, target: str | None = None) -> DataFrame:
    users = of_kind(refs, "string_use")
    return users if target is None else to_target(users, target)


def counts(refs: DataFrame) -> DataFrame:
    """ref_kind, n."""
    return refs.groupBy("ref_kind").agg(F.count("*").alias("n"))
