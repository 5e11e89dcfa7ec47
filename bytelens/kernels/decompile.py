"""Source text of methods, classes and scripts."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec.block import Block, Body, Method, Trait
from ..codec.code import decode
from ..codec.names import dotted, full, ns_kind, package, resolve
from ..functions import fixed as K
from ..sources.files import rows_of
from . import ast as A
from .graph import graph_of
from .printer import INDENT, Printer, quoted
from .rewrite import polished
from .simulate import Machine, run_all
from .structure import Structurer

ACCESS = {K.NS_PRIVATE: "private", K.NS_PROTECTED: "protected", K.NS_STATIC_PROTECTED: "protected", K.NS_INTERNAL: "internal"}
#: Packages that imports put first, if they are imported as a whole.
WILD_FIRST = ("flash.display", "flash.events", "flash.utils", "flash.geom", "flash.net", "flash.text")
NO_IMPORT = ("__AS3__",)
MOST_NESTED = 8


def bodies_by_method(b: Block) -> dict[int, Body]:
    return {x.method: x for x in b.bodies}


def param_names(b: Block, m: Method) -> tuple[str, ...]:
    names = [b.strings[n] if 0 < n < len(b.strings) else "" for n in m.names] + [""] * len(m.params)
    return tuple(names[i] or f"_arg_{i + 1}" for i in range(len(m.params)))


def method_tree(b: Block, index: int, self_name: str = "this", index_access: bool = False, nested: int = 0, raw: bool = False) -> A.BlockStmt:
    """The statements of a method; an empty block without a body.  Registers of parameters are _arg_N."""
    body = bodies_by_method(b).get(index)
    if body is None or not body.code:
        return A.BlockStmt()
    m = b.methods[index] if index < len(b.methods) else Method()
    params = tuple(f"_arg_{i + 1}" for i in range(len(m.params)))

    def closure(k: int) -> A.Expression:
        if not index_access or nested >= MOST_NESTED or k >= len(b.methods):
            return A.Identifier(f"_func{k}_")
        inner = b.methods[k]
        kinds = [resolve(b, p) for p in inner.params]
        names = [f"_arg_{i + 1}" for i in range(len(kinds))]
        return A.FunctionExpr(None, tuple(zip(names, kinds)), resolve(b, inner.return_type), method_tree(b, k, "this", True, nested + 1))

    g = graph_of(decode(body.code), body.handlers)
    tree = Structurer(g, run_all(g, Machine(b, self_name, params, index_access, closure))).body()
    return tree if raw else polished(tree)


def method_body(b: Block, index: int, self_name: str = "this", indent: str = INDENT, index_access: bool = False) -> str:
    """The lines of a method without its braces; what fails is a comment."""
    try:
        text = Printer(indent).source(method_tree(b, index, self_name, index_access))
    except Exception as e:  # one bad method must not lose its class
        return f"// decompile error: {e}"
    lines = text.split("\n")[1:-1]
    return "\n".join(x.removeprefix(indent) for x in lines)


# --- values and signatures ------------------------------------------------------------------------


def number(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    return f"{int(x)}.0" if x == int(x) and abs(x) < 1e15 else f"{x:.15g}"


def default_value(b: Block, kind: int, index: int) -> str:
    """A constant as text."""
    at = lambda pool, other: pool[index] if 0 < index < len(pool) else other
    fixed_texts = {0x00: "undefined", 0x0A: "false", 0x0B: "true", 0x0C: "null"}
    if kind in fixed_texts:
        return fixed_texts[kind]
    if kind == 0x01:
        return quoted(at(b.strings, ""))
    if kind == 0x03:
        return str(at(b.ints, 0))
    if kind == 0x04:
        return str(at(b.uints, 0))
    if kind == 0x06:
        return number(at(b.doubles, 0.0))
    ns = at(b.namespaces, (0, 0))
    return quoted(b.strings[ns[1]] if ns[1] < len(b.strings) else "")


def hex_number(x: int) -> str:
    return f"0x{x:04X}"


def field_default(b: Block, t: Trait) -> str:
    kind, value = resolve(b, t.type), default_value(b, t.vkind, t.vindex)
    pool = {(0x03, "int"): b.ints, (0x04, "uint"): b.uints}.get((t.vkind, kind))
    if pool and t.vindex < len(pool) and pool[t.vindex] >= 256:
        return hex_number(pool[t.vindex])
    return value + ".0" if kind == "Number" and value.lstrip("-").isdigit() else value


def parameters(b: Block, m: Method) -> str:
    names, kinds = param_names(b, m), [resolve(b, p) for p in m.params]
    first = len(kinds) - len(m.options)
    out = [f"{n}:{k}" + (f"={default_value(b, m.options[i - first][1], m.options[i - first][0])}" if i >= first else "") for i, (n, k) in enumerate(zip(names, kinds))]
    return ", ".join([*out, "...rest"] if m.flags & K.NEED_REST else out)


def access(b: Block, name: int) -> str:
    return ACCESS.get(ns_kind(b, name), "public")


def indented(text: str, deep: int) -> list[str]:
    return [INDENT * deep + x if x else "" for x in text.split("\n")] if text else []


def field_line(b: Block, t: Trait, static: bool, value: str | None = None) -> str:
    kind = "const" if t.kind == K.CONST else "var"
    value = field_default(b, t) if t.vindex else value
    return f"{access(b, t.name)} {'static ' if static else ''}{kind} {resolve(b, t.name)}:{resolve(b, t.type)}{f' = {value}' if value is not None else ''};"


def method_lines(b: Block, t: Trait, static: bool, interface: bool, class_name: str) -> list[str]:
    m = b.methods[t.method] if t.method < len(b.methods) else Method()
    words = ["final"] if t.attr & K.ATTR_FINAL and not static else []
    words += ["override"] if t.attr & K.ATTR_OVERRIDE else []
    words += [] if interface else [access(b, t.name)]
    words += ["static"] if static else []
    words += [{K.GETTER: "function get", K.SETTER: "function set"}.get(t.kind, "function")]
    returns = "void" if t.kind == K.SETTER else resolve(b, m.return_type)
    head = f"{' '.join(words)} {resolve(b, t.name)}({parameters(b, m)}):{returns}"
    if interface:
        return [f"{head};"]
    return [head, "{", *indented(method_body(b, t.method, class_name if static else "this"), 1), "}"]


# --- imports --------------------------------------------------------------------------------------


def used_names(b: Block, index: int) -> list[int]:
    """Name indexes that a class refers to: super, interfaces, signatures, members, bodies, closures."""
    c = b.instances[index]
    out, methods, todo = [c.super_name, *c.interfaces], set(), [c.iinit, c.cinit]
    for t in (*c.traits, *c.statics):
        out.append(t.type)
        if t.kind in (K.METHOD, K.GETTER, K.SETTER):
            todo.append(t.method)
        elif t.kind == K.FUNCTION:
            todo.append(t.function)
    found = bodies_by_method(b)
    while todo:
        k = todo.pop(0)
        if k in methods or k >= len(b.methods):
            continue
        methods.add(k)
        out += [*b.methods[k].params, b.methods[k].return_type]
        body = found.get(k)
        if body is None:
            continue
        out += [x for h in body.handlers for x in (h.type,)] + [t.type for t in body.traits]
        for i in decode(body.code):
            if i.truncated or not i.operands:
                continue
            if i.mnemonic in K.MULTINAME_OPS:
                out.append(i.operands[0])
            elif i.mnemonic == "newfunction":
                todo.append(i.operands[0])
    flat = []
    for x in out:  # the parameters of type names count as well
        flat.append(x)
        if 0 < x < len(b.multinames) and b.multinames[x].kind == K.TYPENAME:
            flat += [b.multinames[x].base, *b.multinames[x].params]
    return flat


def imports(b: Block, index: int) -> list[str]:
    """Explicit imports, sorted, after whole packages that unqualified names are looked up in."""
    own = package(b, b.instances[index].name)
    explicit, wild = set(), []
    local = {resolve(b, c.name) for c in b.instances if package(b, c.name) == own}
    for x in used_names(b, index):
        p, n = full(b, x)
        if p and p != own and ":" not in p and p not in NO_IMPORT and n != "*":
            explicit.add(f"{p}.{n}")
        elif 0 < x < len(b.multinames) and b.multinames[x].kind in (K.MULTINAME, K.MULTINAME_A):
            home = [c for c in b.instances if resolve(b, c.name) == n]
            if home:
                q = package(b, home[0].name)
                if q and q != own:
                    explicit.add(f"{q}.{n}")
                continue
            for ns in b.ns_sets[b.multinames[x].ns_set] if b.multinames[x].ns_set < len(b.ns_sets) else ():
                kind, name = b.namespaces[ns] if ns < len(b.namespaces) else (0, 0)
                text = b.strings[name] if 0 < name < len(b.strings) else ""
                if kind in (K.NS_PACKAGE, K.NS_NAMESPACE) and text and text != own and ":" not in text and text not in NO_IMPORT and n not in local:
                    wild.append(text)
    kept = [w for w in dict.fromkeys(wild) if not any(e.rpartition(".")[0] == w for e in explicit)]
    ranked = sorted(kept, key=lambda w: WILD_FIRST.index(w) if w in WILD_FIRST else len(WILD_FIRST))
    return [*(f"import {w}.*;" for w in ranked), *(f"import {e};" for e in sorted(explicit))]


# --- classes and scripts --------------------------------------------------------------------------


def static_values(b: Block, index: int) -> tuple[dict[str, str], list[str]]:
    """Values that the static initialiser gives to static fields, and its other statements."""
    c = b.instances[index]
    names = {resolve(b, t.name): t for t in c.statics if t.kind in (K.SLOT, K.CONST)}
    me = resolve(b, c.name)
    try:
        tree = method_tree(b, c.cinit, me)
    except Exception as e:
        return {}, [f"// decompile error: {e}"]
    values: dict[str, str] = {}
    rest: list[str] = []
    for s in tree.statements:
        e = s.expression if isinstance(s, A.ExpressionStmt) else None
        name = None
        if isinstance(e, A.AssignExpr):
            target = e.target
            if isinstance(target, A.Identifier):
                name = target.name
            elif isinstance(target, A.MemberAccess) and isinstance(target.target, A.Identifier) and target.target.name in (me, "this"):
                name = target.name
        if name in names and name not in values:
            if not names[name].vindex:
                values[name] = Printer().source(e.value)
        else:
            rest += Printer().source(s).split("\n")
    return values, rest


def constructor_lines(b: Block, index: int) -> list[str]:
    """Nothing for a constructor that only does what every one does."""
    c = b.instances[index]
    m = b.methods[c.iinit] if c.iinit < len(b.methods) else Method()
    lines = [x for x in method_body(b, c.iinit).split("\n")]
    first = next((i for i, x in enumerate(lines) if x.strip()), None)
    if first is not None and lines[first].strip() == "super();" and (not c.super_name or resolve(b, c.super_name) in ("Object", "*")):
        lines.pop(first)
    text = "\n".join(lines)
    if not m.params and not text.strip():
        return []
    returns = resolve(b, m.return_type)
    head = f"public function {resolve(b, c.name)}({parameters(b, m)})" + (f":{returns}" if returns != "*" else "")
    return [head, "{", *indented(text, 1), "}"]


def class_source(b: Block, index: int) -> str:
    """A class in its package, with its imports and the other classes of its script."""
    c = b.instances[index]
    own, name = full(b, c.name)
    interface = bool(c.flags & K.INTERFACE)
    words = ["public", *(["final"] if c.flags & K.FINAL and not interface else []), *(["dynamic"] if not c.flags & K.SEALED and not interface else []), "interface" if interface else "class", name]
    parent = resolve(b, c.super_name) if c.super_name else "*"
    if parent not in ("Object", "*") and not interface:
        words += ["extends", parent]
    if c.interfaces:
        words += ["extends" if interface else "implements", ", ".join(resolve(b, i) for i in c.interfaces)]
    values, static_code = static_values(b, index)
    is_field = lambda t: t.kind in (K.SLOT, K.CONST)
    is_method = lambda t: t.kind in (K.METHOD, K.GETTER, K.SETTER)
    ordered = sorted((t for t in c.statics if is_field(t)), key=lambda t: t.kind != K.CONST)
    groups = [
        [x for t in ordered for x in field_line(b, t, True, values.get(resolve(b, t.name))).split("\n")],
        [field_line(b, t, False) for t in c.traits if is_field(t)],
        ["{", *indented("\n".join(static_code), 1), "}"] if static_code else [],
        [] if interface else constructor_lines(b, index),
        *(method_lines(b, t, True, interface, name) for t in c.statics if is_method(t)),
        *(method_lines(b, t, False, interface, name) for t in c.traits if is_method(t)),
    ]
    body: list[str] = []
    for group in groups:
        if group:
            body += [*([""] if body else []), *group]
    used = imports(b, index)
    inner = [*used, *([""] if used else []), " ".join(words), "{", *(INDENT + x if x else "" for x in body), "}"]
    lines = [f"package {own}".rstrip(), "{", *(INDENT + x if x else "" for x in inner), "}"]
    return "\n".join([*lines, *beside(b, index)]) + "\n"


def beside(b: Block, index: int) -> list[str]:
    """The other classes of the same script, with their fields."""
    for s in b.scripts:
        found = [t.klass for t in s.traits if t.kind == K.CLASS]
        if index in found:
            out = []
            for k in found:
                # a class with a package of its own has a file of its own
                if k != index and k < len(b.instances) and not package(b, b.instances[k].name) and package(b, b.instances[index].name):
                    c = b.instances[k]
                    out += ["", f"class {resolve(b, c.name)}", "{", *(INDENT + field_line(b, t, False) for t in c.traits if t.kind in (K.SLOT, K.CONST)), "}"]
            return out
    return []


def script_source(b: Block, index: int) -> str:
    """The functions and variables of a script that belong to no class."""
    out = []
    for t in b.scripts[index].traits:
        if t.kind in (K.SLOT, K.CONST):
            out.append(field_line(b, t, False))
        elif t.kind in (K.METHOD, K.GETTER, K.SETTER, K.FUNCTION):
            k = t.function if t.kind == K.FUNCTION else t.method
            m = b.methods[k] if k < len(b.methods) else Method()
            out += [f"function {resolve(b, t.name)}({parameters(b, m)}):{resolve(b, m.return_type)}", "{", *indented(method_body(b, k), 1), "}"]
    return "\n".join(out) + ("\n" if out else "")


CLASSES = "resource_id long, abc_id int, class_idx int, package string, name string, source string, error string"
METHODS = "resource_id long, abc_id int, class_name string, method_name string, method_index long, source string"
SCRIPTS = "resource_id long, abc_id int, script_idx int, functions int, variables int, classes int, source string"


def class_sources(b: Block, _: int) -> Iterator[dict]:
    for i, c in enumerate(b.instances):
        p, n = full(b, c.name)
        try:
            text, error = class_source(b, i), None
        except Exception as e:  # the others must not fail with it
            text, error = None, f"{type(e).__name__}: {e}"
        yield {"class_idx": i, "package": p, "name": n, "source": text, "error": error}


def method_sources(b: Block, _: int) -> Iterator[dict]:
    for c in b.instances:
        owner, simple = dotted(b, c.name), resolve(b, c.name)
        own = [("<init>", c.iinit, "this"), ("<cinit>", c.cinit, simple)]
        for static, traits in ((False, c.traits), (True, c.statics)):
            own += [(resolve(b, t.name), t.method, simple if static else "this") for t in traits if t.kind in (K.METHOD, K.GETTER, K.SETTER)]
        for name, k, me in own:
            yield {"class_name": owner, "method_name": name, "method_index": k, "source": method_body(b, k, me)}


def script_sources(b: Block, _: int) -> Iterator[dict]:
    for i, s in enumerate(b.scripts):
        kinds = [t.kind for t in s.traits]
        yield {
            "script_idx": i, "functions": sum(k in (K.METHOD, K.GETTER, K.SETTER, K.FUNCTION) for k in kinds), "variables": sum(k in (K.SLOT, K.CONST) for k in kinds),
            "classes": kinds.count(K.CLASS), "source": script_source(b, i),
        }


def classes(blocks: DataFrame) -> DataFrame:
    return blocks.mapInArrow(rows_of(class_sources, CLASSES), CLASSES)


def methods(blocks: DataFrame) -> DataFrame:
    return blocks.mapInArrow(rows_of(method_sources, METHODS), METHODS)


def scripts(blocks: DataFrame) -> DataFrame:
    return blocks.mapInArrow(rows_of(script_sources, SCRIPTS), SCRIPTS)


def first_blocks(blocks: DataFrame) -> DataFrame:
    """The first block of every resource, which single-class requests are answered from."""
    return blocks.join(blocks.groupBy("resource_id").agg(F.min("abc_id").alias("abc_id")), ["resource_id", "abc_id"])


def contained(outdir: str, folders: list[str], name: str) -> str:
    """The path of a class below `outdir`, whatever the names of an untrusted file are."""
    plain = [re.sub(r'[\\/:*?"<>|\0]', "_", p) for p in [*folders, name]]
    plain = ["_" if p in ("", ".", "..") else p for p in plain]
    path = os.path.join(outdir, *plain[:-1], f"{plain[-1]}.as")
    if os.path.commonpath([os.path.realpath(outdir), os.path.realpath(path)]) != os.path.realpath(outdir):
        raise ValueError(f"{path} is outside {outdir}")
    return path


def write_tree(blocks: DataFrame, outdir: str) -> DataFrame:
    """Write every class to a file under its package, on this machine; returns the paths.

    Rows arrive one partition after the other.  A class whose path another one has goes to a folder
    of its resource and block.
    """
    rows = classes(blocks).filter("source is not null")
    paths: dict[str, None] = {}
    for r in rows.select("resource_id", "abc_id", "package", "name", "source").toLocalIterator():
        folders = r.package.split(".") if r.package else []
        path = contained(outdir, folders, r.name)
        if path in paths:
            path = contained(outdir, [f"resource_{r.resource_id}_{r.abc_id}", *folders], r.name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(r.source)
        paths[path] = None
    return blocks.sparkSession.createDataFrame([(x,) for x in paths], "path string")
