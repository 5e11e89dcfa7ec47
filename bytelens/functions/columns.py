"""Column functions: name resolution, classification and rendering as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def either(name: Column, values: dict[str, str]) -> Column:
    """A CASE over literal names; null for others."""
    out = None
    for value in sorted(set(values.values())):
        keys = [k for k, v in values.items() if v == value]
        out = F.when(name.isin(keys), value) if out is None else out.when(name.isin(keys), value)
    return out


def category(name: Column) -> Column:
    """The family of an opcode for bigrams; the order of the tests matters."""
    starts = lambda *p: name.rlike("^(" + "|".join(p) + ")")
    return (
        F.when(starts("get", "find"), "READ")
        .when(starts("set", "init"), "WRITE")
        .when(starts("push") | (name == "dup"), "PUSH")
        .when(starts("call"), "CALL")
        .when(name.isin(*fixed.BRANCHES, "lookupswitch"), "BRANCH")
        .when(name.isin(*fixed.ARITHMETIC), "MATH")
        .when(name.isin(*fixed.COMPARISONS), "CMP")
        .when(name.isin(*fixed.BITWISE), "BIT")
        .when(starts("return"), "RET")
        .when(name.isin(*fixed.COERCIONS), "COERCE")
        .when(starts("construct", "new"), "NEW")
        .otherwise("OTHER")
    )


def named(target: Column) -> Column:
    """Whether a resolved target is a real name."""
    return (target != "*") & ~target.startswith("multiname[")


def qualified(package: Column, name: Column) -> Column:
    return F.when(F.coalesce(package, F.lit("")) != "", F.concat(package, F.lit("."), name)).otherwise(name)


def simple(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def access_modifier(ns_kind: Column) -> Column:
    return F.when(ns_kind == fixed.NS_PRIVATE, "private").when(ns_kind.isin(fixed.NS_PROTECTED, fixed.NS_STATIC_PROTECTED), "protected").when(ns_kind == fixed.NS_INTERNAL, "internal").otherwise("public")


def is_debug_marker(s: Column) -> Column:
    return s.endswith(".hx") | s.endswith(".as") | (s.startswith("[") & s.endswith("]"))


def is_url(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://") | s.startswith("file://") | s.startswith("/") | s.contains(".xml") | s.contains(".json") | s.contains(".swf")


def is_ui_text(s: Column) -> Column:
    return s.contains(" ") & (F.length(s) > 3) & ~s.startswith("http") & ~s.endswith(".hx") & ~s.endswith(".as")


def offset_text(offset: Column) -> Column:
    """0x and at least four hexadecimal digits."""
    h = F.hex(offset)
    return F.concat(F.lit("0x"), F.lpad(h, F.greatest(F.lit(4), F.length(h)), F.lit("0")))


def joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(values, sep)
