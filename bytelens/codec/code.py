"""Instructions: decode, resolve, assemble."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.fixed import MULTINAME_OPS, OP, OPCODES
from .block import Block
from .errors import BlockError, CodeError
from .names import resolve
from .numbers import read_s24, read_u30, write_s24, write_u30


#: Opcode -> mnemonic and the kinds of its operands.
FORMS = {op: (name, {"": [], "special": ["s24", "u30"] if name == "lookupswitch" else ["u8", "u30", "u8", "u30"]}.get(form, form.split())) for op, (name, form) in OPCODES.items()}


@dataclass(slots=True)
class Instruction:
    offset: int
    opcode: int
    mnemonic: str
    operands: list[int]
    size: int
    after_unknown: bool = False
    truncated: bool = False


def _operand(kind: str, code: bytes, at: int) -> tuple[int, int]:
    if kind == "u8":
        if at >= len(code):
            raise BlockError(f"cut off at {at}")
        return code[at], at + 1
    return read_s24(code, at) if kind == "s24" else read_u30(code, at)


def decode(code: bytes, strict: bool = False) -> list[Instruction]:
    """All instructions.  An unknown opcode is one byte; a cut-off operand ends the list.

    In strict mode either raises.  Scans that stop at an unknown opcode leave out what is marked
    `after_unknown` (and the unknown opcode itself, which is marked too).
    """
    out, at, lost = [], 0, False
    while at < len(code):
        start, op = at, code[at]
        at += 1
        if op not in FORMS:
            if strict:
                raise CodeError(f"unknown opcode 0x{op:02X} at {start}")
            lost = True
            out.append(Instruction(start, op, f"unknown_0x{op:02X}", [], 1, True))
            continue
        name, kinds = FORMS[op]
        operands: list[int] = []
        try:
            k = 0
            while k < len(kinds):
                if kinds[k] == "u30" and at < len(code) and code[at] < 0x80:  # most are one byte
                    value, at = code[at], at + 1
                else:
                    value, at = _operand(kinds[k], code, at)
                operands.append(value)
                k += 1
                if name == "lookupswitch" and k == 2:
                    if value + 1 > len(code) - at:
                        raise BlockError("too many cases")
                    kinds = [*kinds, *["s24"] * (value + 1)]
        except BlockError as e:
            if strict:
                raise CodeError(f"{name} at {start}: {e}") from e
            out.append(Instruction(start, op, name, operands, len(code) - start, lost, True))
            break
        out.append(Instruction(start, op, name, operands, at - start, lost))
    return out


def resolved(b: Block, i: Instruction) -> list[str]:
    """The operands as text: names, quoted strings and numbers; the index where there is none."""
    out = [str(x) for x in i.operands]
    if not out:
        return out
    x = i.operands[0]
    pools = {"pushint": ("int", b.ints), "pushuint": ("uint", b.uints), "pushdouble": ("double", b.doubles)}
    if i.mnemonic in MULTINAME_OPS:
        out[0] = resolve(b, x)
    elif i.mnemonic == "pushstring":
        out[0] = f'"{b.strings[x]}"' if 0 < x < len(b.strings) else f"string[{x}]"
    elif i.mnemonic in pools:
        label, pool = pools[i.mnemonic]
        out[0] = str(pool[x]) if 0 < x < len(pool) else f"{label}[{x}]"
    elif i.mnemonic == "newclass":
        out[0] = resolve(b, b.instances[x].name) if 0 <= x < len(b.instances) else f"class[{x}]"
    return out


def assemble(*steps: tuple | str) -> bytes:
    """Code from steps like ("pushbyte", 7), "returnvoid", (":loop",) and ("jump", ":loop")."""
    parts: list[tuple[str, list]] = []
    labels: dict[str, int] = {}
    at = 0
    placed = []
    for step in steps:
        name, *args = (step,) if isinstance(step, str) else step
        if name.startswith(":"):
            labels[name] = at
            continue
        placed.append(at)
        at += len(_encode(name, [0 if isinstance(a, str) else a for a in args]))
        parts.append((name, args))
    out = b""
    for start, (name, args) in zip(placed, parts):
        if any(isinstance(a, str) for a in args):
            base = start if name == "lookupswitch" else start + 4
            args = [labels[a] - base if isinstance(a, str) else a for a in args]
        out += _encode(name, args)
    return out


def _encode(name: str, args: list[int]) -> bytes:
    form = OPCODES[OP[name]][1]
    out = bytes([OP[name]])
    if name == "lookupswitch":  # default, case, case, ...
        return out + write_s24(args[0]) + write_u30(len(args) - 2) + b"".join(map(write_s24, args[1:]))
    kinds = ["u8", "u30", "u8", "u30"] if form == "special" else form.split()
    for kind, value in zip(kinds, args, strict=True):
        out += bytes([value & 0xFF]) if kind == "u8" else write_s24(value) if kind == "s24" else write_u30(value)
    return out
