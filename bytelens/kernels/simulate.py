"""Blocks of instructions to statements, by running them on a stack of expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from ..codec.block import Block
from ..codec.code import Instruction
from ..codec.names import resolve
from . import ast as A
from .graph import Graph, Node, reverse_postorder

BINARY = {
    "add": "+", "subtract": "-", "multiply": "*", "divide": "/", "modulo": "%", "lshift": "<<", "rshift": ">>", "urshift": ">>>", "bitand": "&", "bitor": "|", "bitxor": "^",
    "equals": "==", "strictequals": "===", "lessthan": "<", "lessequals": "<=", "greaterthan": ">", "greaterequals": ">=", "add_i": "+", "subtract_i": "-", "multiply_i": "*",
    "instanceof": "instanceof",
}
UNARY = {"negate": "-", "negate_i": "-", "not": "!", "bitnot": "~"}
STEPS = {"increment": "+", "increment_i": "+", "decrement": "-", "decrement_i": "-"}
CASTS = {
    "convert_s": "String", "convert_i": "int", "convert_u": "uint", "convert_d": "Number", "convert_b": "Boolean", "coerce_b": "Boolean", "coerce_i": "int", "coerce_d": "Number",
    "coerce_s": "String", "coerce_u": "uint",
}
COMPARES = {
    "ifeq": "==", "ifne": "!=", "iflt": "<", "ifle": "<=", "ifgt": ">", "ifge": ">=", "ifstricteq": "===", "ifstrictne": "!==",
    "ifnlt": "!<", "ifnle": "!<=", "ifngt": "!>", "ifnge": "!>=",
}
ITERATION = {"hasnext": "_hasnext", "nextname": "_nextname", "nextvalue": "_nextvalue"}
UNKNOWN = A.Identifier("_unknown")
MOST_PASSES = 8


@dataclass
class Result:
    """What a block does: statements, the stack it leaves, and how it ends."""

    statements: list[A.Statement] = field(default_factory=list)
    stack: list[A.Expression] = field(default_factory=list)
    ends: str = "fall"
    cond: A.Expression | None = None
    targets: list[int] = field(default_factory=list)


@dataclass
class Machine:
    """Names of a method's registers, and the pools of its block."""

    block: Block
    self_name: str = "this"
    params: tuple[str, ...] = ()
    index_access: bool = False
    function: Callable[[int], A.Expression] | None = None

    def local(self, reg: int) -> A.Identifier:
        if reg == 0:
            return A.Identifier(self.self_name)
        return A.Identifier(self.params[reg - 1] if reg <= len(self.params) else f"_loc{reg}_")

    def constant(self, name: str, x: int) -> A.Expression:
        pool, other = {"pushint": (self.block.ints, 0), "pushuint": (self.block.uints, 0), "pushdouble": (self.block.doubles, 0.0), "pushstring": (self.block.strings, "")}[name]
        return A.Literal(pool[x] if 0 < x < len(pool) else other)

    def run(self, node: Node, entry: list[A.Expression] = ()) -> Result:
        r = Result(stack=list(entry))
        for i in node.code:
            if not i.truncated:
                Step(self, r, i).take()
        return r


class Step:
    """One instruction on one state.  Without enough operands an instruction does nothing."""

    def __init__(self, machine: Machine, state: Result, i: Instruction):
        self.m, self.r, self.i, self.s = machine, state, i, state.stack

    # the parts of an effect

    def push(self, e: A.Expression) -> None:
        self.s.append(e)

    def emit(self, e: A.Expression) -> None:
        self.r.statements.append(A.ExpressionStmt(e))

    def pop(self, other: A.Expression = UNKNOWN) -> A.Expression:
        return self.s.pop() if self.s else other

    def args(self, n: int) -> tuple[A.Expression, ...]:
        n = min(n, len(self.s))
        out = tuple(self.s[len(self.s) - n :])
        del self.s[len(self.s) - n :]
        return out

    def name(self) -> str:
        return resolve(self.m.block, self.i.operands[0])

    def member(self, target: A.Expression, name: str) -> A.Expression:
        """A member; a name found in scope stands for itself."""
        return target if target == A.Identifier(name) else A.MemberAccess(target, name)

    def late(self) -> A.Expression | None:
        """The index of an access whose name is on the stack, where that is asked for."""
        x = self.i.operands[0]
        is_late = self.m.index_access and 0 < x < len(self.m.block.multinames) and self.m.block.multinames[x].kind in (0x1B, 0x1C)
        return self.s.pop() if is_late and len(self.s) > 1 else None

    # instructions

    def take(self) -> None:
        name, ops = self.i.mnemonic, self.i.operands
        if name in BINARY:
            if len(self.s) > 1:
                right, left = self.s.pop(), self.s.pop()
                self.push(A.BinaryOp(BINARY[name], left, right))
        elif name in COMPARES or name in ("iftrue", "iffalse"):
            self.branch(name)
        elif name in CASTS:
            self.replace(lambda x: A.CastExpr(CASTS[name], x))
        elif name in UNARY:
            self.replace(lambda x: A.UnaryOp(UNARY[name], x))
        elif name in STEPS:
            self.replace(lambda x: A.BinaryOp(STEPS[name], x, A.Literal(1)))
        elif name in ITERATION:
            if len(self.s) > 1:
                self.push(A.MethodCall(A.Identifier(ITERATION[name]), self.args(2)))
        elif name.startswith(("getlocal", "setlocal")):
            reg = int(name[-1]) if name[-1].isdigit() else ops[0]
            if name.startswith("get"):
                self.push(self.m.local(reg))
            elif self.s:
                self.emit(A.AssignExpr(self.m.local(reg), self.s.pop()))
        else:
            effect = getattr(self, f"do_{name}", None)
            if effect:
                effect(*ops)

    def replace(self, make: Callable[[A.Expression], A.Expression]) -> None:
        if self.s:
            self.s[-1] = make(self.s[-1])

    def branch(self, name: str) -> None:
        if name in COMPARES:
            right, left = self.pop(), self.pop()
            op = COMPARES[name]
            negated = op[0] == "!" and op[1] in "<>"
            cond = A.BinaryOp(op[1:] if negated else op, left, right)
        else:
            negated, cond = name == "iffalse", self.pop()
        self.r.ends, self.r.cond = "if", A.UnaryOp("!", cond) if negated else cond

    def do_pushbyte(self, x):
        self.push(A.Literal(x - 0x100 if x >= 0x80 else x))

    def do_pushshort(self, x):
        self.push(A.Literal(x))

    def do_pushint(self, x):
        self.push(self.m.constant(self.i.mnemonic, x))

    do_pushuint = do_pushdouble = do_pushstring = do_pushint

    def do_pushtrue(self):
        self.push(A.Literal(True))

    def do_pushfalse(self):
        self.push(A.Literal(False))

    def do_pushnull(self):
        self.push(A.Literal(None))

    def do_pushnan(self):
        self.push(A.Literal(math.nan))

    def do_pushundefined(self):
        self.push(A.Identifier("undefined"))

    def do_pushscope(self):
        if self.s:
            self.s.pop()

    do_pushwith = do_pushscope

    def do_getglobalscope(self):
        self.push(A.Identifier("global"))

    def do_getscopeobject(self, x):
        self.push(A.Identifier(f"_scope{x}_"))

    def do_pop(self):
        if self.s:
            value = self.s.pop()
            if acts(value):
                self.emit(value)

    def do_dup(self):
        if self.s:
            self.push(self.s[-1])

    def do_swap(self):
        if len(self.s) > 1:
            self.s[-1], self.s[-2] = self.s[-2], self.s[-1]

    def do_typeof(self):
        self.replace(A.TypeofExpr)

    def do_coerce(self, _):
        self.replace(lambda x: A.CastExpr(self.name(), x))

    def do_astype(self, _):
        self.replace(lambda x: A.AsExpr(x, A.Identifier(self.name())))

    def do_istype(self, _):
        self.replace(lambda x: A.IsExpr(x, A.Identifier(self.name())))

    def pair(self, make):
        if len(self.s) > 1:
            self.push(make(*self.args(2)))

    def do_astypelate(self):
        self.pair(A.AsExpr)

    def do_istypelate(self):
        self.pair(A.IsExpr)

    def do_in(self):
        self.pair(A.InExpr)

    def do_getlex(self, _):
        self.push(A.Identifier(self.name()))

    do_findproperty = do_findpropstrict = do_getlex

    def do_getproperty(self, _):
        index = self.late()
        self.replace(lambda x: A.IndexAccess(x, index) if index is not None else self.member(x, self.name()))

    def do_setproperty(self, _):
        if len(self.s) > 1:
            value = self.s.pop()
            index = self.late()
            target = self.s.pop()
            self.emit(A.AssignExpr(A.IndexAccess(target, index) if index is not None else self.member(target, self.name()), value))

    do_initproperty = do_setproperty

    def do_getslot(self, x):
        self.replace(lambda t: A.MemberAccess(t, f"_slot{x}_"))

    def do_setslot(self, x):
        if len(self.s) > 1:
            target, value = self.args(2)
            self.emit(A.AssignExpr(A.MemberAccess(target, f"_slot{x}_"), value))

    def do_getsuper(self, _):
        self.replace(lambda _: A.MemberAccess(A.Identifier("super"), self.name()))

    def called(self, n: int, callee: Callable[[A.Expression], A.Expression], void: bool = False) -> None:
        """A call whose receiver lies under its arguments."""
        args = self.args(n)
        if self.s:
            call = A.MethodCall(callee(self.s.pop()), args)
            self.emit(call) if void else self.push(call)

    def do_callproperty(self, _, n):
        self.called(n, lambda t: self.member(t, self.name()), self.i.mnemonic == "callpropvoid")

    do_callproplex = do_callpropvoid = do_callproperty

    def do_callsuper(self, _, n):
        self.called(n, lambda _: A.MemberAccess(A.Identifier("super"), self.name()), self.i.mnemonic == "callsupervoid")

    do_callsupervoid = do_callsuper

    def do_callmethod(self, x, n):
        self.called(n, lambda t: A.MemberAccess(t, f"_m{x}_"))

    def do_callstatic(self, x, n):
        args = self.args(n)
        self.pop()
        self.push(A.MethodCall(A.Identifier(f"_method{x}_"), args))

    def do_call(self, n):
        args = self.args(n)
        if len(self.s) > 1:
            callee, _ = self.args(2)
            self.push(A.MethodCall(callee, args))

    def do_construct(self, n):
        args = self.args(n)
        self.replace(lambda c: A.NewExpr(c, args))

    def do_constructprop(self, _, n):
        args = self.args(n)
        self.replace(lambda _: A.NewExpr(A.Identifier(self.name()), args))

    def do_constructsuper(self, n):
        self.called(n, lambda _: A.Identifier("super"), True)

    def do_newfunction(self, x):
        self.push(self.m.function(x) if self.m.function else A.Identifier(f"_func{x}_"))

    def do_newarray(self, n):
        self.push(A.ArrayLiteral(self.args(n)))

    def do_newobject(self, n):
        flat = self.args(2 * n)
        key = lambda k: k.value if isinstance(k, A.Literal) and isinstance(k.value, str) else str(getattr(k, "value", getattr(k, "name", k)))
        self.push(A.ObjectLiteral(tuple(A.ObjectProperty(key(k), v) for k, v in zip(flat[::2], flat[1::2]))))

    def do_newcatch(self, x):
        self.push(A.Identifier(f"_catch{x}_"))

    def do_hasnext2(self, a, b):
        self.push(A.MethodCall(A.Identifier("_hasnext2"), (self.m.local(a), self.m.local(b))))

    def do_returnvoid(self):
        self.r.statements.append(A.ReturnStmt())
        self.r.ends = "return"

    def do_returnvalue(self):
        self.r.statements.append(A.ReturnStmt(self.pop(A.Identifier("undefined"))))
        self.r.ends = "return"

    def do_throw(self):
        self.r.statements.append(A.ThrowStmt(self.pop(A.Identifier("undefined"))))
        self.r.ends = "throw"

    def do_jump(self, _):
        self.r.ends = "jump"

    def do_lookupswitch(self, default, _, *cases):
        self.r.targets = [self.i.offset + d for d in (default, *cases)]
        self.r.ends = "switch"
        if self.s:
            self.r.cond = self.s.pop()


def acts(e: A.Expression) -> bool:
    """Whether dropping an expression would drop an effect."""
    if isinstance(e, (A.MemberAccess, A.IndexAccess)):
        return acts(e.target)
    return isinstance(e, (A.MethodCall, A.NewExpr, A.AssignExpr))


def run_all(g: Graph, machine: Machine) -> dict[int, Result]:
    """All blocks; each starts with what its predecessors agree on, until nothing changes."""
    if not g.nodes:
        return {}
    left: dict[int, list[A.Expression]] = {}
    out: dict[int, Result] = {}
    order = reverse_postorder([n.out for n in g.nodes], 0)
    for _ in range(MOST_PASSES):
        moved = False
        for k in order:
            r = out[k] = machine.run(g.nodes[k], agreed(k, [left[p] for p in g.nodes[k].into if p in left]))
            if left.get(k) != r.stack:
                left[k], moved = list(r.stack), True
        if not moved:
            break
    return out | {n.index: machine.run(n) for n in g.nodes if n.index not in out}


def agreed(k: int, stacks: list[list[A.Expression]]) -> list[A.Expression]:
    """The common stack of the predecessors; a name for what they differ in."""
    return [level[0] if all(x == level[0] for x in level) else A.Identifier(f"_s{d}_b{k}") for d, level in enumerate(zip(*stacks))]
