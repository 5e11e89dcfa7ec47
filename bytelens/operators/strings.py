"""String usage, search and classification."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .model import Model


def usages(m: Model) -> DataFrame:
    """string, class_name, method_name, method_index, offset, opcode of every string in code."""
    rows = m.scanned.filter(F.col("mnemonic").isin(*fixed.STRING_OPS) & F.col("string_value").isNotNull())
    return rows.select(F.col("string_value").alias("string"), "class_name", F.col("member_name").alias("method_name"), "method_index", "offset", "opcode", "resource_id", "abc_id", "body_index")


def used(m: Model) -> DataFrame:
    """The distinct strings of the code."""
    return usages(m).select("string").distinct()


def matching(strings: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """Distinct strings that contain the pattern, or match the regular expression, whatever the case.

    An invalid expression matches nothing.
    """
    if regex:
        try:
            re.compile(pattern)
        except re.error:
            return strings.limit(0)
        hit = F.col("string").rlike("(?iu)" + pattern)
    else:
        hit = F.lower("string").contains(F.lower(F.lit(pattern)))
    return strings.filter(hit).select("string").distinct()


def search(m: Model, pattern: str, regex: bool = False) -> DataFrame:
    return matching(used(m), pattern, regex)


def search_pool(m: Model, pattern: str, regex: bool = False) -> DataFrame:
    return matching(m.pool_strings.filter("string != ''"), pattern, regex)


def in_class(m: Model) -> DataFrame:
    """class_name, string: the distinct strings that each class uses."""
    return usages(m).filter("class_name != ''").select("class_name", "string").distinct()


def classes_using(m: Model) -> DataFrame:
    """string, class_name: the classes that use each string, those without an owner left out."""
    return in_class(m).select("string", "class_name")


def debug_markers(strings: DataFrame) -> DataFrame:
    return strings.filter(C.is_debug_marker(F.col("string"))).select("string").distinct()


def urls(strings: DataFrame) -> DataFrame:
    return strings.filter(C.is_url(F.col("string"))).select("string").distinct()


def ui_texts(strings: DataFrame) -> DataFrame:
    return strings.filter(C.is_ui_text(F.col("string"))).select("string").distinct()


def counts(m: Model) -> DataFrame:
    """unique_strings, total_usages."""
    return usages(m).agg(F.count_distinct("string").alias("unique_strings"), F.count("*").alias("total_usages"))
