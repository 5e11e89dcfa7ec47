"""Syntax trees of decompiled code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Node:
    """Base of all nodes; nodes are values and are never changed."""


class Expression(Node):
    pass


class Statement(Node):
    pass


@dataclass(frozen=True)
class Literal(Expression):
    value: object

    def __eq__(self, other) -> bool:  # true isn't 1, and NaN is NaN
        return type(other) is Literal and type(self.value) is type(other.value) and repr(self.value) == repr(other.value)

    def __hash__(self) -> int:
        return hash(repr(self.value))


@dataclass(frozen=True)
class Identifier(Expression):
    name: str


@dataclass(frozen=True)
class MemberAccess(Expression):
    target: Expression
    name: str


@dataclass(frozen=True)
class IndexAccess(Expression):
    target: Expression
    index: Expression


@dataclass(frozen=True)
class MethodCall(Expression):
    callee: Expression
    args: tuple[Expression, ...] = ()


@dataclass(frozen=True)
class NewExpr(Expression):
    callee: Expression
    args: tuple[Expression, ...] = ()


@dataclass(frozen=True)
class BinaryOp(Expression):
    op: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class UnaryOp(Expression):
    op: str
    operand: Expression


@dataclass(frozen=True)
class TernaryOp(Expression):
    cond: Expression
    then_expr: Expression
    else_expr: Expression


@dataclass(frozen=True)
class AssignExpr(Expression):
    target: Expression
    value: Expression


@dataclass(frozen=True)
class CompoundAssignExpr(Expression):
    op: str
    target: Expression
    value: Expression


@dataclass(frozen=True)
class CastExpr(Expression):
    type_name: str
    value: Expression


@dataclass(frozen=True)
class IsExpr(Expression):
    value: Expression
    type_ref: Expression


@dataclass(frozen=True)
class AsExpr(Expression):
    value: Expression
    type_ref: Expression


@dataclass(frozen=True)
class TypeofExpr(Expression):
    value: Expression


@dataclass(frozen=True)
class DeleteExpr(Expression):
    target: Expression


@dataclass(frozen=True)
class InExpr(Expression):
    key: Expression
    obj: Expression


@dataclass(frozen=True)
class ArrayLiteral(Expression):
    elements: tuple[Expression, ...] = ()


@dataclass(frozen=True)
class ObjectProperty(Node):
    key: str
    value: Expression


@dataclass(frozen=True)
class ObjectLiteral(Expression):
    properties: tuple[ObjectProperty, ...] = ()


@dataclass(frozen=True)
class BlockStmt(Statement):
    statements: tuple[Statement, ...] = ()


@dataclass(frozen=True)
class FunctionExpr(Expression):
    name: str | None
    params: tuple[tuple[str, str | None], ...]
    return_type: str | None
    body: BlockStmt


@dataclass(frozen=True)
class IfStmt(Statement):
    cond: Expression
    then_body: Statement
    else_body: Statement | None = None


@dataclass(frozen=True)
class WhileStmt(Statement):
    cond: Expression
    body: Statement


@dataclass(frozen=True)
class DoWhileStmt(Statement):
    body: Statement
    cond: Expression


@dataclass(frozen=True)
class ForStmt(Statement):
    init: Statement | None
    cond: Expression | None
    step: Expression | None
    body: Statement


@dataclass(frozen=True)
class ForInStmt(Statement):
    var: str
    var_type: str | None
    iterable: Expression
    body: Statement


@dataclass(frozen=True)
class ForEachStmt(ForInStmt):
    pass


@dataclass(frozen=True)
class SwitchCase(Node):
    label: Expression | None
    body: tuple[Statement, ...] = ()


@dataclass(frozen=True)
class SwitchStmt(Statement):
    discriminant: Expression
    cases: tuple[SwitchCase, ...] = ()


@dataclass(frozen=True)
class CatchClause(Node):
    var: str
    var_type: str | None
    body: BlockStmt


@dataclass(frozen=True)
class TryStmt(Statement):
    try_body: BlockStmt
    catches: tuple[CatchClause, ...] = ()
    finally_body: BlockStmt | None = None


@dataclass(frozen=True)
class ReturnStmt(Statement):
    value: Expression | None = None


@dataclass(frozen=True)
class ThrowStmt(Statement):
    value: Expression


@dataclass(frozen=True)
class BreakStmt(Statement):
    label: str | None = None


@dataclass(frozen=True)
class ContinueStmt(Statement):
    label: str | None = None


@dataclass(frozen=True)
class LabeledStmt(Statement):
    label: str
    body: Statement


@dataclass(frozen=True)
class ExpressionStmt(Statement):
    expression: Expression


@dataclass(frozen=True)
class VarDeclStmt(Statement):
    name: str
    type_name: str | None = None
    init: Expression | None = None


@dataclass
class Rewriter:
    """Applies rules bottom-up: a rule gets a node whose children are done."""

    rules: dict[type, Callable[[Node], Node]] = field(default_factory=dict)

    def __call__(self, x):
        if isinstance(x, tuple):
            return tuple(map(self, x))
        if not isinstance(x, Node):
            return x
        new = {f.name: self(getattr(x, f.name)) for f in fields(x)}
        if any(new[k] is not getattr(x, k) and new[k] != getattr(x, k) for k in new):
            x = replace(x, **new)
        rule = self.rules.get(type(x))
        return rule(x) if rule else x


def nodes(x) -> list[Node]:
    """A node and all below it."""
    if isinstance(x, tuple):
        return [n for y in x for n in nodes(y)]
    if not isinstance(x, Node):
        return []
    return [x, *(n for f in fields(x) for n in nodes(getattr(x, f.name)))]
