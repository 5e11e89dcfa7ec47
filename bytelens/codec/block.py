"""Bytecode blocks: parse, serialise, and convert to and from relational rows.

A row is (kind, idx, ints, s, d, raw): one row an entry of a pool or a definition.  `LAYOUT` names
the leading integers of each kind; lists follow them.  The rows of a block are all of it, so a block
can be edited as rows and serialised again.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..functions import fixed as K
from .errors import BlockError
from .numbers import read_d64, read_s32, read_u30, write_s32, write_u30

LAYOUT = {
    "block": ("minor", "major"),
    "int": ("value",),
    "uint": ("value",),
    "double": (),
    "string": (),
    "namespace": ("kind", "name"),
    "ns_set": (),
    "multiname": ("kind", "ns", "name", "ns_set", "base"),
    "method": ("return_type", "name", "flags", "n_params", "n_options", "n_names"),
    "metadata": ("name",),
    "instance": ("name", "super", "flags", "protected_ns", "iinit", "cinit"),
    "trait": ("owner_kind", "owner", "name", "kind", "attr", "slot", "type", "vindex", "vkind", "method", "disp", "class", "function"),
    "script": ("init",),
    "body": ("method", "max_stack", "local_count", "init_scope_depth", "max_scope_depth"),
    "exception": ("body", "from", "to", "target", "type", "var"),
}
OWNERS = ("instance", "static", "script", "body")
Row = tuple[str, int, list[int], str | None, float | None, bytes | None]


@dataclass(slots=True)
class Trait:
    name: int
    kind: int
    attr: int = 0
    slot: int = 0
    type: int = 0
    vindex: int = 0
    vkind: int = -1
    method: int = 0
    disp: int = 0
    klass: int = 0
    function: int = 0
    metadata: list[int] = field(default_factory=list)
    raw: bytes | None = None


@dataclass(slots=True)
class Multiname:
    kind: int
    ns: int = 0
    name: int = 0
    ns_set: int = 0
    base: int = 0
    params: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Method:
    params: list[int] = field(default_factory=list)
    return_type: int = 0
    name: int = 0
    flags: int = 0
    options: list[tuple[int, int]] = field(default_factory=list)
    names: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Instance:
    name: int
    super_name: int = 0
    flags: int = 0
    protected_ns: int = 0
    interfaces: list[int] = field(default_factory=list)
    iinit: int = 0
    cinit: int = 0
    traits: list[Trait] = field(default_factory=list)
    statics: list[Trait] = field(default_factory=list)


@dataclass(slots=True)
class Handler:
    start: int
    end: int
    target: int
    type: int = 0
    var: int = 0


@dataclass(slots=True)
class Body:
    method: int
    max_stack: int = 0
    local_count: int = 0
    init_scope_depth: int = 0
    max_scope_depth: int = 0
    code: bytes = b""
    handlers: list[Handler] = field(default_factory=list)
    traits: list[Trait] = field(default_factory=list)


@dataclass(slots=True)
class Script:
    init: int
    traits: list[Trait] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    """All pools hold their entry 0; `raw_*` keep the bytes of integers as they were read."""

    minor: int = 16
    major: int = 46
    ints: list[int] = field(default_factory=lambda: [0])
    uints: list[int] = field(default_factory=lambda: [0])
    doubles: list[float] = field(default_factory=lambda: [0.0])
    strings: list[str] = field(default_factory=lambda: [""])
    namespaces: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    ns_sets: list[list[int]] = field(default_factory=lambda: [[]])
    multinames: list[Multiname] = field(default_factory=lambda: [Multiname(0)])
    methods: list[Method] = field(default_factory=list)
    metadata: list[tuple[int, list[tuple[int, int]]]] = field(default_factory=list)
    instances: list[Instance] = field(default_factory=list)
    scripts: list[Script] = field(default_factory=list)
    bodies: list[Body] = field(default_factory=list)
    raw_ints: dict[int, bytes] = field(default_factory=dict)
    raw_uints: dict[int, bytes] = field(default_factory=dict)
    raw_strings: dict[int, bytes] = field(default_factory=dict)


class Reader:
    """A cursor; every count is checked against the bytes that are left."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def u8(self) -> int:
        if self.at >= len(self.data):
            raise BlockError(f"cut off at {self.at}")
        self.at += 1
        return self.data[self.at - 1]

    def u16(self) -> int:
        return self.u8() | self.u8() << 8

    def u30(self) -> int:
        at = self.at
        if at < len(self.data) and self.data[at] < 0x80:
            self.at = at + 1
            return self.data[at]
        value, self.at = read_u30(self.data, at)
        return value

    def count(self) -> int:
        n = self.u30()
        if n > len(self.data) - self.at + 1:
            raise BlockError(f"{n} entries cannot follow {self.at}")
        return n

    def many(self, n: int) -> list[int]:
        return [self.u30() for _ in range(n)]

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise BlockError(f"{n} bytes cannot follow {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]


def parse(data: bytes) -> Block:
    """A block from its bytes."""
    if len(data) < 4:
        raise BlockError(f"{len(data)} bytes are no block")
    r, b = Reader(data), Block()
    b.minor, b.major = r.u16(), r.u16()
    for values, raws, read in ((b.ints, b.raw_ints, read_s32), (b.uints, b.raw_uints, read_u30)):
        for i in range(1, r.count()):
            start = r.at
            value, r.at = read(data, r.at)
            values.append(value)
            raws[i] = data[start : r.at]
    for _ in range(1, r.count()):
        value, r.at = read_d64(data, r.at)
        b.doubles.append(value)
    for i in range(1, r.count()):
        raw = r.take(r.u30())
        b.strings.append(raw.decode("utf-8", "replace"))
        if b.strings[-1].encode("utf-8", "replace") != raw:
            b.raw_strings[i] = raw
    for _ in range(1, r.count()):
        kind = r.u8()
        b.namespaces.append((kind, r.u30()))
    for _ in range(1, r.count()):
        b.ns_sets.append(r.many(r.count()))
    for _ in range(1, r.count()):
        b.multinames.append(_multiname(r))
    for _ in range(r.count()):
        b.methods.append(_method(r))
    for _ in range(r.count()):
        name, n = r.u30(), r.count()
        b.metadata.append((name, [(r.u30(), r.u30()) for _ in range(n)]))
    n = r.count()
    for _ in range(n):
        b.instances.append(_instance(r))
    for i in range(n):
        b.instances[i].cinit = r.u30()
        b.instances[i].statics = _traits(r)
    for _ in range(r.count()):
        init = r.u30()
        b.scripts.append(Script(init, _traits(r)))
    for _ in range(r.count()):
        head = r.many(5)
        code = r.take(r.u30())
        handlers = [Handler(*r.many(5)) for _ in range(r.count())]
        b.bodies.append(Body(*head, code, handlers, _traits(r)))
    return b


def _multiname(r: Reader) -> Multiname:
    kind = r.u8()
    if kind in (K.QNAME, K.QNAME_A):
        return Multiname(kind, ns=r.u30(), name=r.u30())
    if kind in (K.RTQNAME, K.RTQNAME_A):
        return Multiname(kind, name=r.u30())
    if kind in (K.RTQNAME_L, K.RTQNAME_LA):
        return Multiname(kind)
    if kind in (K.MULTINAME, K.MULTINAME_A):
        return Multiname(kind, name=r.u30(), ns_set=r.u30())
    if kind in (K.MULTINAME_L, K.MULTINAME_LA):
        return Multiname(kind, ns_set=r.u30())
    if kind == K.TYPENAME:
        return Multiname(kind, base=r.u30(), params=r.many(r.count()))
    raise BlockError(f"unknown kind of name 0x{kind:02X}")


def _method(r: Reader) -> Method:
    n, out = r.count(), Method(return_type=r.u30())
    out.params, out.name, out.flags = r.many(n), r.u30(), r.u8()
    if out.flags & K.HAS_OPTIONAL:
        out.options = [(r.u30(), r.u8()) for _ in range(r.count())]
    if out.flags & K.HAS_PARAM_NAMES:
        out.names = r.many(n)
    return out


def _instance(r: Reader) -> Instance:
    out = Instance(r.u30(), r.u30(), r.u8())
    if out.flags & K.PROTECTED_NS:
        out.protected_ns = r.u30()
    out.interfaces = r.many(r.count())
    out.iinit = r.u30()
    out.traits = _traits(r)
    return out


def _traits(r: Reader) -> list[Trait]:
    return [_trait(r) for _ in range(r.count())]


def _trait(r: Reader) -> Trait:
    start, name, byte = r.at, r.u30(), r.u8()
    t = Trait(name, byte & 0x0F, byte >> 4)
    if t.kind in (K.SLOT, K.CONST):
        t.slot, t.type, t.vindex = r.u30(), r.u30(), r.u30()
        if t.vindex:
            t.vkind = r.u8()
    elif t.kind in (K.METHOD, K.GETTER, K.SETTER):
        t.disp, t.method = r.u30(), r.u30()
    elif t.kind == K.CLASS:
        t.slot, t.klass = r.u30(), r.u30()
    elif t.kind == K.FUNCTION:
        t.slot, t.function = r.u30(), r.u30()
    else:
        raise BlockError(f"unknown kind of trait {t.kind}")
    if t.attr & K.ATTR_METADATA:
        t.metadata = r.many(r.count())
    t.raw = r.data[start : r.at]
    return t


def _list(values: list[int]) -> bytes:
    return b"".join(map(write_u30, values))


def _counted(values: list[int]) -> bytes:
    return write_u30(len(values)) + _list(values)


def _pool(parts: list[bytes]) -> bytes:
    """An empty pool has count 0, others one more than their entries."""
    return write_u30(len(parts) + 1 if parts else 0) + b"".join(parts)


def write_trait(t: Trait) -> bytes:
    if t.raw is not None:
        return t.raw
    out = write_u30(t.name) + bytes([t.attr << 4 | t.kind])
    if t.kind in (K.SLOT, K.CONST):
        out += _list([t.slot, t.type, t.vindex]) + (bytes([max(t.vkind, 0)]) if t.vindex else b"")
    elif t.kind == K.CLASS:
        out += _list([t.slot, t.klass])
    elif t.kind == K.FUNCTION:
        out += _list([t.slot, t.function])
    else:
        out += _list([t.disp, t.method])
    return out + (_counted(t.metadata) if t.attr & K.ATTR_METADATA else b"")


def _write_traits(traits: list[Trait]) -> bytes:
    return write_u30(len(traits)) + b"".join(map(write_trait, traits))


def _write_multiname(m: Multiname) -> bytes:
    fields = {
        K.QNAME: [m.ns, m.name], K.QNAME_A: [m.ns, m.name], K.RTQNAME: [m.name], K.RTQNAME_A: [m.name], K.RTQNAME_L: [], K.RTQNAME_LA: [],
        K.MULTINAME: [m.name, m.ns_set], K.MULTINAME_A: [m.name, m.ns_set], K.MULTINAME_L: [m.ns_set], K.MULTINAME_LA: [m.ns_set],
        K.TYPENAME: [m.base, len(m.params), *m.params],
    }
    return bytes([m.kind]) + _list(fields[m.kind])


def serialize(b: Block) -> bytes:
    """The bytes of a block; what was read and not changed comes out as it was."""
    out = [struct.pack("<HH", b.minor, b.major)]
    out.append(_pool([b.raw_ints.get(i) or write_s32(b.ints[i]) for i in range(1, len(b.ints))]))
    out.append(_pool([b.raw_uints.get(i) or write_u30(b.uints[i]) for i in range(1, len(b.uints))]))
    out.append(_pool([struct.pack("<d", x) for x in b.doubles[1:]]))
    texts = [b.raw_strings.get(i, s.encode("utf-8", "replace")) for i, s in enumerate(b.strings)][1:]
    out.append(_pool([write_u30(len(t)) + t for t in texts]))
    out.append(_pool([bytes([kind]) + write_u30(name) for kind, name in b.namespaces[1:]]))
    out.append(_pool([_counted(x) for x in b.ns_sets[1:]]))
    out.append(_pool([_write_multiname(m) for m in b.multinames[1:]]))
    out.append(write_u30(len(b.methods)))
    for m in b.methods:
        out.append(write_u30(len(m.params)) + _list([m.return_type, *m.params, m.name]) + bytes([m.flags]))
        if m.flags & K.HAS_OPTIONAL:
            out.append(write_u30(len(m.options)) + b"".join(write_u30(v) + bytes([k]) for v, k in m.options))
        if m.flags & K.HAS_PARAM_NAMES:
            out.append(_list(m.names))
    out.append(write_u30(len(b.metadata)) + b"".join(_list([name, len(items), *(x for pair in items for x in pair)]) for name, items in b.metadata))
    out.append(write_u30(len(b.instances)))
    for c in b.instances:
        out.append(_list([c.name, c.super_name]) + bytes([c.flags]) + (write_u30(c.protected_ns) if c.flags & K.PROTECTED_NS else b""))
        out.append(_counted(c.interfaces) + write_u30(c.iinit) + _write_traits(c.traits))
    out.extend(write_u30(c.cinit) + _write_traits(c.statics) for c in b.instances)
    out.append(write_u30(len(b.scripts)) + b"".join(write_u30(s.init) + _write_traits(s.traits) for s in b.scripts))
    out.append(write_u30(len(b.bodies)))
    for x in b.bodies:
        out.append(_list([x.method, x.max_stack, x.local_count, x.init_scope_depth, x.max_scope_depth, len(x.code)]) + x.code)
        out.append(write_u30(len(x.handlers)) + b"".join(_list([h.start, h.end, h.target, h.type, h.var]) for h in x.handlers) + _write_traits(x.traits))
    return b"".join(out)


def to_rows(b: Block) -> list[Row]:
    """The whole block as rows."""
    out: list[Row] = [("block", 0, [b.minor, b.major], None, None, None)]
    out += [("int", i, [v], None, None, b.raw_ints.get(i)) for i, v in enumerate(b.ints)]
    out += [("uint", i, [v], None, None, b.raw_uints.get(i)) for i, v in enumerate(b.uints)]
    out += [("double", i, [], None, v, None) for i, v in enumerate(b.doubles)]
    out += [("string", i, [], v, None, b.raw_strings.get(i)) for i, v in enumerate(b.strings)]
    out += [("namespace", i, list(v), None, None, None) for i, v in enumerate(b.namespaces)]
    out += [("ns_set", i, list(v), None, None, None) for i, v in enumerate(b.ns_sets)]
    out += [("multiname", i, [m.kind, m.ns, m.name, m.ns_set, m.base, *m.params], None, None, None) for i, m in enumerate(b.multinames)]
    for i, m in enumerate(b.methods):
        flat = [x for pair in m.options for x in pair]
        out.append(("method", i, [m.return_type, m.name, m.flags, len(m.params), len(m.options), len(m.names), *m.params, *flat, *m.names], None, None, None))
    out += [("metadata", i, [name, *(x for pair in items for x in pair)], None, None, None) for i, (name, items) in enumerate(b.metadata)]
    for i, c in enumerate(b.instances):
        out.append(("instance", i, [c.name, c.super_name, c.flags, c.protected_ns, c.iinit, c.cinit, *c.interfaces], None, None, None))
    out += [("script", i, [s.init], None, None, None) for i, s in enumerate(b.scripts)]
    for i, x in enumerate(b.bodies):
        out.append(("body", i, [x.method, x.max_stack, x.local_count, x.init_scope_depth, x.max_scope_depth], None, None, x.code))
        out += [("exception", k, [i, h.start, h.end, h.target, h.type, h.var], None, None, None) for k, h in enumerate(x.handlers)]
    for kind, owners in enumerate(([c.traits for c in b.instances], [c.statics for c in b.instances], [s.traits for s in b.scripts], [x.traits for x in b.bodies])):
        for i, traits in enumerate(owners):
            for k, t in enumerate(traits):
                ints = [kind, i, t.name, t.kind, t.attr, t.slot, t.type, t.vindex, t.vkind, t.method, t.disp, t.klass, t.function, *t.metadata]
                out.append(("trait", k, ints, None, None, t.raw))
    return out


def from_rows(rows: list[Row]) -> Block:
    """A block from its rows, in any order; rows of other kinds are passed over."""
    by: dict[str, list[Row]] = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    of = lambda kind: sorted(by.get(kind, []), key=lambda r: r[1])
    b = Block(*of("block")[0][2][:2])
    b.ints, b.uints = [r[2][0] for r in of("int")], [r[2][0] for r in of("uint")]
    b.raw_ints, b.raw_uints, b.raw_strings = ({r[1]: bytes(r[5]) for r in of(k) if r[5] is not None} for k in ("int", "uint", "string"))
    b.doubles, b.strings = [r[4] for r in of("double")], [r[3] for r in of("string")]
    b.namespaces, b.ns_sets = [(r[2][0], r[2][1]) for r in of("namespace")], [list(r[2]) for r in of("ns_set")]
    b.multinames = [Multiname(*r[2][:5], list(r[2][5:])) for r in of("multiname")]
    for _, _, x, *_ in of("method"):
        p, o = 6 + x[3], 6 + x[3] + 2 * x[4]
        b.methods.append(Method(list(x[6:p]), x[0], x[1], x[2], list(zip(x[p:o:2], x[p + 1 : o : 2])), list(x[o : o + x[5]])))
    b.metadata = [(r[2][0], list(zip(r[2][1::2], r[2][2::2]))) for r in of("metadata")]
    b.instances = [Instance(x[0], x[1], x[2], x[3], list(x[6:]), x[4], x[5]) for _, _, x, *_ in of("instance")]
    b.scripts = [Script(r[2][0]) for r in of("script")]
    b.bodies = [Body(*r[2][:5], bytes(r[5])) for r in of("body")]
    for r in of("exception"):
        b.bodies[r[2][0]].handlers.append(Handler(*r[2][1:6]))
    for r in of("trait"):
        kind, owner, *x = r[2]
        trait = Trait(*x[:11], list(x[11:]), None if r[5] is None else bytes(r[5]))
        (b.instances[owner].traits if kind == 0 else b.instances[owner].statics if kind == 1 else b.scripts[owner].traits if kind == 2 else b.bodies[owner].traits).append(trait)
    return b
