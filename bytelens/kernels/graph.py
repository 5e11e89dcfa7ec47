"""Control-flow graphs of single bodies: blocks, orders, dominators, loops."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..codec.block import Block, Handler
from ..codec.code import Instruction, decode
from ..functions.fixed import BRANCHES
from ..sources.files import rows_of

ENDS = ("returnvoid", "returnvalue", "throw")


@dataclass(slots=True, eq=False)
class Node:
    index: int
    code: list[Instruction]
    out: list[int] = field(default_factory=list)
    into: list[int] = field(default_factory=list)
    handlers: list[int] = field(default_factory=list)
    kind: str = "normal"

    @property
    def start(self) -> int:
        return self.code[0].offset

    @property
    def end(self) -> int:
        return self.code[-1].offset + self.code[-1].size

    @property
    def last(self) -> Instruction:
        return self.code[-1]


@dataclass(slots=True)
class Graph:
    nodes: list[Node]
    handlers: list[Handler]

    def at(self, offset: int) -> Node | None:
        return next((n for n in self.nodes if n.start == offset), None)


def targets(i: Instruction) -> list[int]:
    """Where a branch or switch goes; a switch's default first."""
    if i.mnemonic in BRANCHES and i.operands:
        return [i.offset + i.size + i.operands[0]]
    if i.mnemonic == "lookupswitch" and len(i.operands) > 2:
        return [i.offset + d for d in (i.operands[0], *i.operands[2:])]
    return []


def graph_of(code: list[Instruction], handlers: list[Handler] = ()) -> Graph:
    """Blocks start at the first instruction, at targets, and after branches and ends."""
    offsets = {i.offset for i in code}
    leads = {i.offset for i in code[:1]}
    for k, i in enumerate(code):
        if i.mnemonic in BRANCHES or i.mnemonic == "lookupswitch" or i.mnemonic in ENDS:
            leads.update(t for t in targets(i) if t in offsets)
            leads.update(x.offset for x in code[k + 1 : k + 2])
    for h in handlers:
        leads.update(x for x in (h.start, h.end, h.target) if x in offsets)
    nodes: list[Node] = []
    for i in code:
        if i.offset in leads:
            nodes.append(Node(len(nodes), []))
        nodes[-1].code.append(i)
    starts = {n.start: n.index for n in nodes}
    for n in nodes:
        i = n.last
        out = []
        if i.mnemonic not in (*ENDS, "jump", "lookupswitch") and n.end in starts:
            out.append(starts[n.end])
        out += [starts[t] for t in targets(i) if t in starts]
        n.out = list(dict.fromkeys(out))
        if i.mnemonic == "lookupswitch":
            n.kind = "switch"
    for n in nodes:
        for x in n.out:
            nodes[x].into.append(n.index)
    for k, h in enumerate(handlers):
        for n in nodes:
            if h.start <= n.start < h.end and n.end <= h.end:
                n.handlers.append(k)
        if h.target in starts:
            nodes[starts[h.target]].kind = "catch_entry"
    return Graph(nodes, list(handlers))


def reverse_postorder(out: list[list[int]], entry: int) -> list[int]:
    """The nodes that can be reached, each before those it leads to but for back edges."""
    seen, order, stack = {entry}, [], [(entry, iter(out[entry]))]
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if x not in seen:
                seen.add(x)
                stack.append((x, iter(out[x])))
                break
        else:
            order.append(node)
            stack.pop()
    return order[::-1]


def dominators(out: list[list[int]], into: list[list[int]], entry: int) -> dict[int, int]:
    """Immediate dominators of the nodes that can be reached; the entry's is itself."""
    order = reverse_postorder(out, entry)
    rank = {n: k for k, n in enumerate(order)}
    idom = {entry: entry}
    moved = True
    while moved:
        moved = False
        for n in order[1:]:
            new = None
            for p in into[n]:
                if p not in idom:
                    continue
                if new is None:
                    new = p
                    continue
                a, b = p, new
                while a != b:  # climb from the later one until both meet
                    if rank[a] > rank[b]:
                        a = idom[a]
                    else:
                        b = idom[b]
                new = a
            if new is not None and idom.get(n) != new:
                idom[n] = new
                moved = True
    return idom


def immediate_dominators(g: Graph) -> dict[int, int]:
    """Of all blocks; one that can't be reached has itself."""
    if not g.nodes:
        return {}
    found = dominators([n.out for n in g.nodes], [n.into for n in g.nodes], 0)
    return {n.index: found.get(n.index, n.index) for n in g.nodes}


def immediate_postdominators(g: Graph) -> dict[int, int]:
    """Of all blocks: -1 where there is none; an exit has itself.

    With one exit, a block that can't reach it has itself; with several, they share a virtual one,
    which counts as none.
    """
    exits = [n.index for n in g.nodes if not n.out]
    if not exits:
        return {n.index: -1 for n in g.nodes}
    back, ahead = [list(n.into) for n in g.nodes], [list(n.out) for n in g.nodes]
    top = exits[0]
    if len(exits) > 1:
        top = len(g.nodes)
        back.append(list(exits))
        ahead.append([])
        for e in exits:
            ahead[e].append(top)
    found = dominators(back, ahead, top)
    out = {}
    for n in g.nodes:
        p = found.get(n.index)
        if n.index in exits:
            out[n.index] = n.index
        elif p is None:
            out[n.index] = n.index if len(exits) == 1 else -1
        else:
            out[n.index] = -1 if p == len(g.nodes) else p
    return out


@dataclass(slots=True)
class Loop:
    header: int
    body: set[int]
    tails: list[int]
    parent: int | None = None


def dominates(idom: dict[int, int], a: int, b: int) -> bool:
    while b != a:
        up = idom[b]
        if up == b:
            return False
        b = up
    return True


def loops(g: Graph, idom: dict[int, int] | None = None) -> list[Loop]:
    """Natural loops by header, back edges to one header merged, each under the smallest that holds it."""
    idom = immediate_dominators(g) if idom is None else idom
    found: dict[int, Loop] = {}
    for n in g.nodes:
        for x in n.out:
            if dominates(idom, x, n.index):
                loop = found.setdefault(x, Loop(x, {x}, []))
                loop.tails.append(n.index)
                todo = [n.index]
                while todo:
                    b = todo.pop()
                    if b not in loop.body:
                        loop.body.add(b)
                        todo.extend(g.nodes[b].into)
    out = [found[h] for h in sorted(found)]
    for inner in out:
        holds = [o for o in out if o is not inner and inner.body < o.body]
        inner.parent = min(holds, key=lambda o: len(o.body)).header if holds else None
    return out


def top_level(found: list[Loop]) -> list[Loop]:
    """The loops that no other one holds."""
    return [x for x in found if x.parent is None]


def children(found: list[Loop], header: int) -> list[Loop]:
    """The loops right within the one of that header."""
    return [x for x in found if x.parent == header]


def complexity(g: Graph) -> int:
    return max(1, sum(len(n.out) for n in g.nodes) - len(g.nodes) + 2)


FLOW = (
    "resource_id long, abc_id int, body_index long, method_index long, block long, start long, end long, kind string, successors array<bigint>, idom long, ipostdom long, "
    "loop_header long, loop_parent long, complexity long"
)


def flow_rows(b: Block, _: int) -> Iterator[dict]:
    """One row a block; loop_header is the innermost loop that holds it, loop_parent that loop's parent."""
    for k, body in enumerate(b.bodies):
        g = graph_of(decode(body.code), body.handlers)
        idom, post, found = immediate_dominators(g), immediate_postdominators(g), []
        found = loops(g, idom)
        size = complexity(g)
        for n in g.nodes:
            inner = min((x for x in found if n.index in x.body), key=lambda x: len(x.body), default=None)
            yield {
                "body_index": k, "method_index": body.method, "block": n.index, "start": n.start, "end": n.end, "kind": n.kind, "successors": n.out, "idom": idom[n.index], "ipostdom": post[n.index],
                "loop_header": inner.header if inner else None, "loop_parent": inner.parent if inner else None, "complexity": size,
            }


def flow(blocks: DataFrame) -> DataFrame:
    """Blocks, dominators and loops of all bodies of the given bytecode blocks."""
    return blocks.mapInArrow(rows_of(flow_rows, FLOW), FLOW)
