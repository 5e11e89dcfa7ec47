"""Blocks to structured statements: if, while, switch, try."""

from __future__ import annotations

from . import ast as A
from .graph import Graph, Loop, Node, dominators, immediate_dominators, immediate_postdominators, loops
from .simulate import Result


def bare(cond: A.Expression) -> tuple[A.Expression, bool]:
    """A condition without its leading negations, and whether there was an odd number of them."""
    odd = False
    while isinstance(cond, A.UnaryOp) and cond.op == "!":
        cond, odd = cond.operand, not odd
    return cond, odd


def either(cond: A.Expression, yes: list[A.Statement], no: list[A.Statement]) -> A.IfStmt:
    if len(no) == 1 and isinstance(no[0], A.IfStmt):
        other = no[0]
    else:
        other = A.BlockStmt(tuple(no)) if no else None
    return A.IfStmt(cond, A.BlockStmt(tuple(yes)), other)


class Structurer:
    """Walks the graph once; every block is written in one place."""

    def __init__(self, g: Graph, results: dict[int, Result]):
        self.g, self.results = g, results
        self.post = immediate_postdominators(g)
        self.loops = {x.header: x for x in loops(g, immediate_dominators(g))}
        self.done: set[int] = set()
        self.wrapped: set[int] = set()
        self.open: list[tuple[Loop, int | None]] = []  # the loops around, and where a break of each goes
        self.within: dict[int, dict[int, int]] = {}
        self.catches = {h.target for n in g.nodes for h in (g.handlers[k] for k in n.handlers)}

    def body(self) -> A.BlockStmt:
        return A.BlockStmt(tuple(self.region(0, None)) if self.g.nodes else ())

    def merge(self, k: int) -> int | None:
        """Where the ways from a block meet; in a loop, those of its ways that stay in the same round."""
        if self.open:
            p = self.same_round(self.open[-1][0]).get(k, -1)
            return p if 0 <= p < len(self.g.nodes) else None
        p = self.post.get(k, -1)
        return p if p >= 0 else None

    def same_round(self, loop: Loop) -> dict[int, int]:
        """Immediate post-dominators within a loop's body: the way back to its header is the exit, ways out don't count."""
        if loop.header not in self.within:
            top = len(self.g.nodes)
            ahead: list[list[int]] = [[] for _ in range(top + 1)]
            back: list[list[int]] = [[] for _ in range(top + 1)]
            for b in loop.body:
                for x in {top if x == loop.header else x for x in self.g.nodes[b].out if x in loop.body}:
                    ahead[b].append(x)
                    back[x].append(b)
            self.within[loop.header] = dominators(back, ahead, top)
        return self.within[loop.header]

    def region(self, at: int | None, stop: int | None) -> list[A.Statement]:
        out: list[A.Statement] = []
        while at is not None and at != stop:
            if self.open and at in (self.open[-1][1], self.open[-1][0].header) and self.open[-1][1] is not None:
                out.append(A.BreakStmt() if at == self.open[-1][1] else A.ContinueStmt())
                break
            if at in self.done:
                break
            node, r = self.g.nodes[at], self.results[at]
            new = [k for k in node.handlers if k not in self.wrapped and self.g.handlers[k].start == node.start]
            if new:
                self.wrapped.update(new)
                statement, at = self.guarded(at, new)
                out.append(statement)
                continue
            self.done.add(at)
            if at in self.loops:
                statement, at = self.loop(self.loops[at])
                out.append(statement)
                continue
            out += r.statements
            if r.ends in ("return", "throw"):
                break
            if r.ends == "if" and len(node.out) > 1:
                meet = self.merge(at)
                until = stop if meet is None and self.open else meet
                falls, jumps = self.region(node.out[0], until), self.region(node.out[1], until)
                cond, negated = bare(r.cond)
                yes, no = (falls, jumps) if negated else (jumps, falls)
                leaves = [bool(x) and isinstance(x[-1], (A.BreakStmt, A.ContinueStmt)) for x in (yes, no)]
                if leaves == [True, False]:
                    out += [either(cond, yes, []), *no]
                elif leaves == [False, True]:
                    out += [either(A.UnaryOp("!", cond), no, []), *yes]
                else:
                    out.append(either(cond, yes, no))
                at = meet
            elif r.ends == "switch":
                out.append(self.switch(node, r))
                at = self.merge(at)
            else:
                at = node.out[0] if node.out else None
        return out

    def loop(self, loop: Loop) -> tuple[A.Statement, int | None]:
        """A loop, and where to go on: the exit of its header, if that is where the test is."""
        node, r = self.g.nodes[loop.header], self.results[loop.header]
        inside = [x for x in node.out if x in loop.body]
        if r.ends == "if" and len(node.out) == 2 and len(inside) == 1:
            (away,) = (x for x in node.out if x not in loop.body)
            cond, odd = bare(r.cond)
            if odd != (node.out[1] == away):  # the branch is taken to leave, or the test was negated
                cond = A.UnaryOp("!", cond)
            body = [*r.statements, *self.round(loop, away, inside[0])]
            return A.WhileStmt(cond, A.BlockStmt(tuple(body))), away
        after = self.post.get(loop.header, -1)
        after = after if after >= 0 and after not in loop.body else None
        body = [*r.statements, *self.round(loop, after, node.out[0] if node.out else None)]
        return A.WhileStmt(A.Literal(True), A.BlockStmt(tuple(body))), after

    def round(self, loop: Loop, away: int | None, first: int | None) -> list[A.Statement]:
        self.open.append((loop, away))
        out = self.region(first, loop.header)
        self.open.pop()
        return out

    def switch(self, node: Node, r: Result) -> A.SwitchStmt:
        """Cases by position; of cases that share a target the first has the body; the default is last."""
        meet = self.merge(node.index)
        starts = {n.start: n.index for n in self.g.nodes}
        cases, seen = [], set()
        if self.open:  # in a switch, a break is the switch's own
            self.open.append((self.open[-1][0], None))
        for label, offset in [*((A.Literal(i), t) for i, t in enumerate(r.targets[1:])), (None, r.targets[0])]:
            if offset in starts:
                body = () if offset in seen else tuple(self.region(starts[offset], meet))
                seen.add(offset)
                cases.append(A.SwitchCase(label, body))
        if self.open:
            self.open.pop()
        return A.SwitchStmt(r.cond if r.cond is not None else A.Identifier("_switch_value"), tuple(cases))

    def guarded(self, at: int, handlers: list[int]) -> tuple[A.Statement, int | None]:
        """A try statement, and where to go on: after its range, past the handlers."""
        end = self.g.handlers[handlers[0]].end
        after = [n for n in self.g.nodes if n.start >= end]
        stop = after[0].index if after else None
        body = A.BlockStmt(tuple(self.region(at, stop)))
        clauses = []
        for k in handlers:
            target = self.g.at(self.g.handlers[k].target)
            if target is not None:
                text = self.region(target.index, None if stop == target.index else stop)
                clauses.append(A.CatchClause(f"_catch{len(clauses)}_", None, A.BlockStmt(tuple(text))))
        return A.TryStmt(body, tuple(clauses)), next((n.index for n in after if n.start not in self.catches), None)
