"""Syntax trees to source text, with parentheses only where precedence asks for them."""

from __future__ import annotations

import math

from . import ast as A

INDENT = "    "
# How strongly expressions bind.
PRIMARY, POSTFIX, PREFIX, RELATION, TERNARY, ASSIGN = 20, 18, 16, 11, 4, 3
BINARY = {
    "*": 14, "/": 14, "%": 14, "+": 13, "-": 13, "<<": 12, ">>": 12, ">>>": 12, "<": 11, "<=": 11, ">": 11, ">=": 11, "is": 11, "as": 11, "in": 11,
    "==": 10, "!=": 10, "===": 10, "!==": 10, "&": 9, "^": 8, "|": 7, "&&": 6, "||": 5,
}
STRENGTH = {
    A.Literal: PRIMARY, A.Identifier: PRIMARY, A.ArrayLiteral: PRIMARY, A.ObjectLiteral: PRIMARY, A.FunctionExpr: PRIMARY, A.MemberAccess: POSTFIX, A.IndexAccess: POSTFIX,
    A.MethodCall: POSTFIX, A.NewExpr: POSTFIX, A.CastExpr: POSTFIX, A.UnaryOp: PREFIX, A.TypeofExpr: PREFIX, A.DeleteExpr: PREFIX, A.IsExpr: RELATION, A.AsExpr: RELATION,
    A.InExpr: RELATION, A.TernaryOp: TERNARY, A.AssignExpr: ASSIGN, A.CompoundAssignExpr: ASSIGN,
}
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(s: str) -> str:
    return '"' + "".join(ESCAPES.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 0x20 else c) for c in s) + '"'


def strength(e: A.Node) -> int:
    return BINARY.get(e.op, 0) if isinstance(e, A.BinaryOp) else STRENGTH.get(type(e), 0)


def literal(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        return repr(v).removesuffix(".0")
    return quoted(v) if isinstance(v, str) else str(v)


class Printer:
    """Renders one tree; `deep` is the current indentation."""

    def __init__(self, indent: str = INDENT):
        self.indent = indent

    def source(self, x: A.Node, deep: int = 0) -> str:
        return self.statement(x, deep) if isinstance(x, A.Statement) else self.expression(x, deep)

    def within(self, e: A.Node, least: int, deep: int, strict: bool = False) -> str:
        """An operand of a context that binds with `least`; `strict` also brackets equals."""
        text = self.expression(e, deep)
        return f"({text})" if strength(e) < least or (strict and strength(e) == least) else text

    def listed(self, items, deep: int) -> str:
        return ", ".join(self.expression(x, deep) for x in items)

    def expression(self, e: A.Node, deep: int = 0) -> str:
        part = lambda x, least, strict=False: self.within(x, least, deep, strict)
        match e:
            case A.Literal(value):
                return literal(value)
            case A.Identifier(name):
                return name
            case A.MemberAccess(target, name):
                return f"{part(target, POSTFIX)}.{name}"
            case A.IndexAccess(target, index):
                return f"{part(target, POSTFIX)}[{self.expression(index, deep)}]"
            case A.MethodCall(callee, args):
                return f"{part(callee, POSTFIX)}({self.listed(args, deep)})"
            case A.NewExpr(callee, args):
                return f"new {part(callee, POSTFIX)}({self.listed(args, deep)})"
            case A.BinaryOp(op, left, right):
                return f"{part(left, strength(e))} {op} {part(right, strength(e), True)}"
            case A.UnaryOp(op, operand):
                return op + part(operand, PREFIX)
            case A.TernaryOp(cond, yes, no):
                return f"{part(cond, TERNARY + 1)} ? {part(yes, TERNARY)} : {part(no, TERNARY)}"
            case A.AssignExpr(target, value):
                return f"{part(target, ASSIGN + 1)} = {part(value, ASSIGN)}"
            case A.CompoundAssignExpr(op, target, value):
                return f"{part(target, ASSIGN + 1)} {op.removesuffix('=')}= {part(value, ASSIGN)}"
            case A.CastExpr(name, value):
                return f"{name}({self.expression(value, deep)})"
            case A.IsExpr(value, ref):
                return f"{part(value, RELATION)} is {part(ref, RELATION, True)}"
            case A.AsExpr(value, ref):
                return f"{part(value, RELATION)} as {part(ref, RELATION, True)}"
            case A.InExpr(key, obj):
                return f"{part(key, RELATION)} in {part(obj, RELATION, True)}"
            case A.TypeofExpr(value):
                return f"typeof {part(value, PREFIX)}"
            case A.DeleteExpr(target):
                return f"delete {part(target, PREFIX)}"
            case A.ArrayLiteral(elements):
                return f"[{self.listed(elements, deep)}]"
            case A.ObjectLiteral(properties):
                return "{" + ", ".join(f"{p.key}: {self.expression(p.value, deep)}" for p in properties) + "}"
            case A.FunctionExpr(name, params, returns, body):
                signature = ", ".join(n if t is None else f"{n}:{t}" for n, t in params)
                return f"function{f' {name}' if name is not None else ''}({signature}){f':{returns}' if returns is not None else ''} {self.statement(body, deep)}"
        raise TypeError(f"no text for {type(e).__name__}")

    def declared(self, s: A.VarDeclStmt, deep: int) -> str:
        kind = f":{s.type_name}" if s.type_name is not None else ""
        return f"var {s.name}{kind}" + (f" = {self.expression(s.init, deep)}" if s.init is not None else "")

    def lines(self, statements, deep: int) -> str:
        return "".join(f"\n{self.indent * deep}{self.statement(s, deep)}" for s in statements)

    def statement(self, s: A.Node, deep: int = 0) -> str:
        ex, st, pad = lambda e: self.expression(e, deep), lambda x: self.statement(x, deep), self.indent * deep
        match s:
            case A.BlockStmt(statements):
                return "{" + self.lines(statements, deep + 1) + f"\n{pad}}}"
            case A.ExpressionStmt(expression):
                return f"{ex(expression)};"
            case A.ReturnStmt(value):
                return "return;" if value is None else f"return {ex(value)};"
            case A.ThrowStmt(value):
                return f"throw {ex(value)};"
            case A.BreakStmt(label):
                return f"break {label};" if label else "break;"
            case A.ContinueStmt(label):
                return f"continue {label};" if label else "continue;"
            case A.LabeledStmt(label, body):
                return f"{label}: {st(body)}"
            case A.VarDeclStmt():
                return f"{self.declared(s, deep)};"
            case A.IfStmt(cond, yes, no):
                return f"if ({ex(cond)}) {st(yes)}" + (f" else {st(no)}" if no is not None else "")
            case A.WhileStmt(cond, body):
                return f"while ({ex(cond)}) {st(body)}"
            case A.DoWhileStmt(body, cond):
                return f"do {st(body)} while ({ex(cond)});"
            case A.ForStmt(init, cond, step, body):
                head = "" if init is None else self.declared(init, deep) if isinstance(init, A.VarDeclStmt) else ex(init.expression)
                return f"for ({head}; {'' if cond is None else ex(cond)}; {'' if step is None else ex(step)}) {st(body)}"
            case A.ForInStmt(var, kind, iterable, body):
                each = "for each" if isinstance(s, A.ForEachStmt) else "for"
                return f"{each} (var {var}{f':{kind}' if kind is not None else ''} in {ex(iterable)}) {st(body)}"
            case A.SwitchStmt(value, cases):
                arms = ""
                for case in cases:
                    label = "default:" if case.label is None else f"case {ex(case.label)}:"
                    arms += f"\n{pad}{self.indent}{label}" + self.lines(case.body, deep + 2)
                return f"switch ({ex(value)}) {{{arms}\n{pad}}}"
            case A.TryStmt(body, catches, last):
                text = f"try {st(body)}"
                for c in catches:
                    text += f" catch ({c.var}{f':{c.var_type}' if c.var_type is not None else ''}) {st(c.body)}"
                return text + (f" finally {st(last)}" if last is not None else "")
        raise TypeError(f"no text for {type(s).__name__}")
