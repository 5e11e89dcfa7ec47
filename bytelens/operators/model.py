"""The tables every operator works on, whether parsed from containers or bridged from other data.

A `Model` holds DataFrames.  Operators are functions of a model; none collects anything.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LITERAL = "struct<kind:string,s:string,i:bigint,d:double,b:boolean>"

CLASSES = (
    "resource_id long, abc_id int, class_idx int, load_seq long, name string, package string, qualified_name string, super_name string, super_package string, "
    "super_qualified string, interfaces array<string>, is_interface boolean, is_sealed boolean, is_final boolean, constructor_index int, static_init_index int"
)
FIELDS = "resource_id long, abc_id int, load_seq long, class_name string, name string, type_name string, is_static boolean, is_const boolean, slot_id long, trait_index int"
METHODS = (
    "resource_id long, abc_id int, load_seq long, class_name string, simple_class string, name string, param_names array<string>, param_types array<string>, return_type string, "
    "is_static boolean, is_getter boolean, is_setter boolean, is_override boolean, method_index long, body_index int, trait_index int"
)
#: One row per instruction, its first operand resolved and its method's owner beside it.
CODE = (
    "resource_id long, abc_id int, body_index long, method_index long, seq long, offset long, opcode int, mnemonic string, operands array<bigint>, size int, after_unknown boolean, "
    f"target string, string_value string, literal {LITERAL}, arg_count long, class_name string, member_name string, cg_name string, ca_name string"
)
SITES = f"resource_id long, abc_id int, body_index long, seq long, offset long, target string, arg_count long, known array<{LITERAL}>, class_name string, ca_name string"
BODY = ["resource_id", "abc_id", "body_index"]


@dataclass
class Model:
    """Resolved tables, and what is derived from them, each built once."""

    classes: DataFrame
    fields: DataFrame
    methods: DataFrame
    code: DataFrame
    pool_strings: DataFrame
    bodies: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
    #: Call sites read from blocks (SITES); without blocks `code` is searched for them.
    sites: DataFrame | None = None

    @property
    def scanned(self) -> DataFrame:
        """The instructions that index scans see: none after an unknown opcode."""
        return self.code.filter("not after_unknown")

    def views(self, prefix: str = "") -> None:
        """Publish all tables as temporary views."""
        for name in ("classes", "fields", "methods", "code", "pool_strings"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
        for name, df in self.extra.items():
            df.createOrReplaceTempView(prefix + name)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
