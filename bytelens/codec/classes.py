"""Classes, members and instructions of a block with names resolved: the rows of the model's tables."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions import fixed as K
from .block import Block, Instance, Trait
from .code import Instruction, decode
from .names import dotted, full, ns_kind, resolve

NONE = -1


def text(b: Block, i: int) -> str:
    return b.strings[i] if 0 < i < len(b.strings) else ""


def class_rows(b: Block, load_base: int) -> Iterator[dict]:
    for i, c in enumerate(b.instances):
        package, name = full(b, c.name)
        super_package, super_name = full(b, c.super_name) if c.super_name else ("", "")
        yield {
            "class_idx": i, "load_seq": load_base + i, "name": name, "package": package, "qualified_name": dotted(b, c.name), "super_name": super_name, "super_package": super_package,
            "super_qualified": dotted(b, c.super_name) if c.super_name else "", "interfaces": [resolve(b, x) for x in c.interfaces], "is_interface": bool(c.flags & K.INTERFACE),
            "is_sealed": bool(c.flags & K.SEALED), "is_final": bool(c.flags & K.FINAL), "constructor_index": c.iinit, "static_init_index": c.cinit,
        }


def members(c: Instance) -> Iterator[tuple[bool, int, Trait]]:
    """(static, trait index, trait): instance members before static ones."""
    for static, traits in ((False, c.traits), (True, c.statics)):
        for k, t in enumerate(traits):
            yield static, k, t


def field_rows(b: Block, load_base: int) -> Iterator[dict]:
    for i, c in enumerate(b.instances):
        owner = dotted(b, c.name)
        for static, k, t in members(c):
            if t.kind in (K.SLOT, K.CONST):
                yield {
                    "load_seq": load_base + i, "class_name": owner, "name": resolve(b, t.name), "type_name": resolve(b, t.type), "is_static": static, "is_const": t.kind == K.CONST,
                    "slot_id": t.slot, "trait_index": k,
                }


def method_rows(b: Block, load_base: int) -> Iterator[dict]:
    body_of = {x.method: i for i, x in enumerate(b.bodies)}
    for i, c in enumerate(b.instances):
        owner, simple = dotted(b, c.name), resolve(b, c.name)
        for static, k, t in members(c):
            if t.kind not in (K.METHOD, K.GETTER, K.SETTER):
                continue
            m = b.methods[t.method] if 0 <= t.method < len(b.methods) else None
            yield {
                "load_seq": load_base + i, "class_name": owner, "simple_class": simple, "name": resolve(b, t.name), "param_names": [text(b, x) for x in m.names] if m else [],
                "param_types": [resolve(b, x) for x in m.params] if m else [], "return_type": resolve(b, m.return_type) if m else "*", "is_static": static, "is_getter": t.kind == K.GETTER,
                "is_setter": t.kind == K.SETTER, "is_override": bool(t.attr & K.ATTR_OVERRIDE), "method_index": t.method, "body_index": body_of.get(t.method, NONE), "trait_index": k,
            }


def summary_rows(b: Block, _: int) -> Iterator[dict]:
    """Classes with their numbers of fields and methods; classes of one name share them."""
    kept = (K.SLOT, K.CONST, K.METHOD, K.GETTER, K.SETTER)
    rows = list(class_rows(b, 0))
    traits: dict[str, int] = {}
    for c, r in zip(b.instances, rows, strict=True):
        traits[r["qualified_name"]] = traits.get(r["qualified_name"], 0) + sum(t.kind in kept for _, _, t in members(c))
    for r in rows:
        yield {
            "class_idx": r["class_idx"], "name": r["name"], "package": r["package"], "full_name": r["qualified_name"], "super": r["super_qualified"], "is_interface": r["is_interface"],
            "trait_count": traits[r["qualified_name"]],
        }


def owners(b: Block) -> dict[int, tuple[str, str, str, str]]:
    """Method index -> (class, member, call-graph name, const-args name).

    Where an index is used twice, members win over initialisers, but for the const-args name.
    """
    out: dict[int, list[str]] = {}
    for c in b.instances:
        owner, simple = dotted(b, c.name), full(b, c.name)[1]
        for index, label in ((c.iinit, "<init>"), (c.cinit, "<cinit>")):
            out[index] = [owner, label, f"{simple}.{label}", f"{owner}.{label}"]
        for static, _, t in members(c):
            if t.kind not in (K.METHOD, K.GETTER, K.SETTER):
                continue
            name = resolve(b, t.name)
            prefix = "static " if static else "get " if t.kind == K.GETTER else "set " if t.kind == K.SETTER else ""
            args_name = out[t.method][3] if t.method in (c.iinit, c.cinit) else f"{owner}.{name}"
            out[t.method] = [owner, name, f"{simple}.{prefix}{name}", args_name]
    return {k: tuple(v) for k, v in out.items()}


def literal(b: Block, i: Instruction) -> dict | None:
    """What a push leaves on the stack; kind unknown for undefined or a bad index; None for anything else."""
    blank = {"kind": "unknown", "s": None, "i": None, "d": None, "b": None}
    x = i.operands[0] if i.operands else 0
    pools = {"pushint": ("int", "i", b.ints), "pushuint": ("int", "i", b.uints), "pushdouble": ("double", "d", b.doubles), "pushstring": ("str", "s", b.strings)}
    if i.mnemonic == "pushbyte" and i.operands:
        return blank | {"kind": "int", "i": x - 0x100 if x >= 0x80 else x}
    if i.mnemonic == "pushshort" and i.operands:
        return blank | {"kind": "int", "i": x}
    if i.mnemonic in pools:
        kind, slot, pool = pools[i.mnemonic]
        return blank | {"kind": kind, slot: pool[x]} if 0 < x < len(pool) else blank
    if i.mnemonic in ("pushtrue", "pushfalse"):
        return blank | {"kind": "bool", "b": i.mnemonic == "pushtrue"}
    if i.mnemonic == "pushnull":
        return blank | {"kind": "null"}
    return blank if i.mnemonic == "pushundefined" else None


def code_rows(b: Block) -> Iterator[dict]:
    """One row per instruction of every body."""
    who = owners(b)
    named = {*K.MULTINAME_OPS}
    for k, body in enumerate(b.bodies):
        owner, member, cg_name, ca_name = who.get(body.method, ("", f"method_{body.method}", f"method_{body.method}", f"method_{body.method}"))
        for seq, i in enumerate(decode(body.code)):
            target = string = None
            if i.mnemonic in named and i.operands:
                target = resolve(b, i.operands[0])
            elif i.mnemonic == "newclass" and i.operands:
                x = i.operands[0]
                target = resolve(b, b.instances[x].name) if x < len(b.instances) else f"multiname[{x}]"
            elif i.mnemonic in K.STRING_OPS and i.operands and 0 < i.operands[0] < len(b.strings):
                string = b.strings[i.operands[0]]
            yield {
                "body_index": k, "method_index": body.method, "seq": seq, "offset": i.offset, "opcode": i.opcode, "mnemonic": i.mnemonic, "operands": i.operands, "size": i.size,
                "after_unknown": i.after_unknown, "target": target, "string_value": string, "literal": literal(b, i),
                "arg_count": i.operands[1] if i.mnemonic in K.ARG_OPS and len(i.operands) > 1 else None, "class_name": owner, "member_name": member, "cg_name": cg_name, "ca_name": ca_name,
            }


PUSHES = {"pushint", "pushuint", "pushdouble", "pushstring", "pushtrue", "pushfalse", "pushnull", "pushundefined"}


def site_rows(b: Block) -> Iterator[dict]:
    """One row per call with a named target, and the literals pushed right before it, its number of arguments at most."""
    who = owners(b)
    known: dict[tuple, dict] = {}
    for k, body in enumerate(b.bodies):
        owner, _, _, ca_name = who.get(body.method, ("", "", "", f"method_{body.method}"))
        run: list[Instruction] = []
        for seq, i in enumerate(decode(body.code)):
            if i.mnemonic in PUSHES or i.mnemonic in ("pushbyte", "pushshort") and i.operands:
                run.append(i)
                continue
            target = resolve(b, i.operands[0]) if i.mnemonic in K.ARG_OPS and i.operands else None
            if target is not None and not target.startswith("multiname["):
                count = i.operands[1] if len(i.operands) > 1 else None
                pushed = run if count is None else run[max(len(run) - count, 0) :]
                values = []
                for x in pushed:
                    key = (x.opcode, *x.operands)
                    if key not in known:
                        known[key] = literal(b, x)
                    values.append(known[key])
                yield {"body_index": k, "seq": seq, "offset": i.offset, "target": target, "arg_count": count, "known": values, "class_name": owner, "ca_name": ca_name}
            run = []


def body_rows(b: Block) -> Iterator[dict]:
    for k, x in enumerate(b.bodies):
        yield {"body_index": k, "method_index": x.method, "code_size": len(x.code), "max_stack": x.max_stack, "local_count": x.local_count, "exception_count": len(x.handlers)}


def handler_rows(b: Block) -> Iterator[dict]:
    for k, x in enumerate(b.bodies):
        for seq, h in enumerate(x.handlers):
            yield {"body_index": k, "seq": seq, "from_offset": h.start, "to_offset": h.end, "target": h.target, "exc_type": resolve(b, h.type), "var_name": resolve(b, h.var)}


def name_rows(b: Block) -> Iterator[dict]:
    for i, m in enumerate(b.multinames):
        package, name = full(b, i)
        yield {"idx": i, "name": resolve(b, i), "package": package, "full_name": f"{package}.{name}" if package else name, "kind": m.kind, "ns_kind": ns_kind(b, i)}


def string_rows(b: Block) -> Iterator[dict]:
    for i, s in enumerate(b.strings):
        if i:
            yield {"idx": i, "string": s}
