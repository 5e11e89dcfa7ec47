"""Fingerprints of a block's methods and constructors, in one pass over its code.

A body is whole within its block, so nothing is moved: these are the rows that `flow.fingerprints`
joins and aggregates from tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..codec import classes as C
from ..codec.block import Block, Body
from ..codec.code import decode
from ..functions import fixed
from ..sources.files import BIGRAMS, rows_of

TOP = 15
COUNTS = ("branch", "call", "construct", "getprop", "setprop", "getlex", "newarray", "newobject", "arithmetic", "comparison", "bitwise", "coerce", "throw")
NAMED = {"arithmetic": "arithmetic_ops", "comparison": "comparison_ops", "bitwise": "bitwise_ops"}
FINGERPRINTS = (
    "resource_id long, abc_id int, body_index long, class_name string, method_name string, is_constructor boolean, return_type string, is_static boolean, is_getter boolean, is_setter boolean, "
    "code_size long, max_stack long, local_count long, exception_count long, instr_count long, branch_count long, switch_cases array<bigint>, call_count long, construct_count long, getprop_count long, "
    "setprop_count long, getlex_count long, newarray_count long, newobject_count long, arithmetic_ops long, comparison_ops long, bitwise_ops long, coerce_count long, return_void boolean, throw_count long, "
    "int_constants array<bigint>, uint_constants array<bigint>, double_constants array<double>, string_constants array<string>, "
    f"opcode_bigrams {BIGRAMS}, param_count int, param_types_builtin array<string>"
)


def _family(name: str) -> str | None:
    """As in `flow.op_counts`."""
    groups = ((fixed.BRANCHES, "branch"), (("lookupswitch",), "switch"), (fixed.CALLS, "call"), (fixed.CONSTRUCTS, "construct"), (("getproperty",), "getprop"), (("setproperty", "initproperty"), "setprop"),
              (("getlex",), "getlex"), (("newarray",), "newarray"), (("newobject",), "newobject"), (fixed.ARITHMETIC, "arithmetic"), (fixed.COMPARISONS, "comparison"), (fixed.BITWISE, "bitwise"),
              (fixed.COERCIONS, "coerce"), (("returnvalue",), "returnvalue"), (("throw",), "throw"))
    return next((family for names, family in groups if name in names), None)


def _category(name: str) -> str:
    """As `columns.category`."""
    groups = ((name.startswith(("get", "find")), "READ"), (name.startswith(("set", "init")), "WRITE"), (name.startswith("push") or name == "dup", "PUSH"), (name.startswith("call"), "CALL"),
              (name in fixed.BRANCHES or name == "lookupswitch", "BRANCH"), (name in fixed.ARITHMETIC, "MATH"), (name in fixed.COMPARISONS, "CMP"), (name in fixed.BITWISE, "BIT"),
              (name.startswith("return"), "RET"), (name in fixed.COERCIONS, "COERCE"), (name.startswith(("construct", "new")), "NEW"))
    return next((category for holds, category in groups if holds), "OTHER")


FAMILY = {name: _family(name) for name in fixed.OP}
CATEGORY = {name: _category(name) for name in fixed.OP}
ZERO = {NAMED.get(family, f"{family}_count"): 0 for family in COUNTS}


def counts(b: Block, body: Body) -> dict | None:
    """The counts, constants and bigrams of one body; None if it has no instructions."""
    found = decode(body.code)
    if not found:
        return None
    out = {**ZERO, "instr_count": len(found), "return_void": True}
    cases, ints, uints, doubles, strings = [], [], [], [], []
    for i in found:
        family, x = FAMILY.get(i.mnemonic), i.operands[0] if i.operands else None
        if family == "switch":
            if len(i.operands) > 1:
                cases.append(i.operands[1])
        elif family == "returnvalue":
            out["return_void"] = False
        elif family is not None:
            out[NAMED.get(family, f"{family}_count")] += 1
        elif x is None:
            continue
        elif i.mnemonic in ("pushbyte", "pushshort"):
            ints.append(x)
        elif i.mnemonic == "pushstring":
            if 0 < x < len(b.strings):
                strings.append(b.strings[x])
        elif i.mnemonic in ("pushint", "pushuint", "pushdouble"):
            values, pool = {"pushint": (ints, b.ints), "pushuint": (uints, b.uints), "pushdouble": (doubles, b.doubles)}[i.mnemonic]
            if 0 < x < len(pool):
                values.append(pool[x])
    kinds = [CATEGORY.get(i.mnemonic, "OTHER") for i in found]
    pairs = Counter(zip(kinds, kinds[1:]))  # of equally frequent pairs the one that comes first leads
    top = [{"rank": k, "a": a, "b": z, "n": n} for k, ((a, z), n) in enumerate(pairs.most_common(TOP), 1)]
    doubles.sort(key=lambda d: (math.isnan(d), d))
    return out | {
        "switch_cases": sorted(cases), "int_constants": sorted(ints), "uint_constants": sorted(uints), "double_constants": doubles,
        "string_constants": sorted(strings, key=lambda s: s.encode("utf-8", "replace")), "opcode_bigrams": top or None,
    }


def _normal(name: str) -> str:
    return name if name in fixed.BUILTIN_TYPES else "?"


def fingerprint_rows(b: Block, base: int) -> Iterator[dict]:
    of_method: dict[int, list[int]] = {}
    for k, body in enumerate(b.bodies):
        of_method.setdefault(body.method, []).append(k)
    owned = [(c.iinit, C.dotted(b, c.name)) for c in b.instances]
    made = ((k, name, "<constructor>", True, [], "void", False, False, False) for iinit, name in owned for k in of_method.get(iinit, ()))
    own = (
        (r["body_index"], r["class_name"], r["name"], False, r["param_types"], r["return_type"], r["is_static"], r["is_getter"], r["is_setter"])
        for r in C.method_rows(b, base) if r["body_index"] != C.NONE
    )
    known: dict[int, dict | None] = {}
    for rows in (made, own):
        for k, class_name, name, constructor, params, returns, static, getter, setter in rows:
            if k not in known:
                known[k] = counts(b, b.bodies[k])
            if known[k] is None:
                continue
            body = b.bodies[k]
            yield {
                "body_index": k, "class_name": class_name, "method_name": name, "is_constructor": constructor, "return_type": _normal(returns), "is_static": static, "is_getter": getter, "is_setter": setter,
                "code_size": len(body.code), "max_stack": body.max_stack, "local_count": body.local_count, "exception_count": len(body.handlers), "param_count": len(params),
                "param_types_builtin": [_normal(p) for p in params], **known[k],
            }


def fingerprints(blocks: DataFrame) -> DataFrame:
    """One row per method or constructor with a body and instructions, as `flow.fingerprints` gives them."""
    return blocks.mapInArrow(rows_of(fingerprint_rows, FINGERPRINTS), FINGERPRINTS)
