"""Resolving names of a block to text."""

from __future__ import annotations

from ..functions import fixed as K
from .block import Block

#: Type names may refer to each other; deeper than this they are taken as cyclic.
MOST_DEPTH = 32
NAMED = (K.QNAME, K.QNAME_A, K.RTQNAME, K.RTQNAME_A, K.MULTINAME, K.MULTINAME_A)
LATE = (K.RTQNAME_L, K.RTQNAME_LA, K.MULTINAME_L, K.MULTINAME_LA)


def resolve(b: Block, i: int, depth: int = 0) -> str:
    """The simple name: * for any or late-bound ones, multiname[i] where there is none."""
    if not 0 < i < len(b.multinames) or depth > MOST_DEPTH:
        return "*"
    m = b.multinames[i]
    if m.kind in NAMED:
        return b.strings[m.name] if 0 < m.name < len(b.strings) else f"multiname[{i}]"
    if m.kind in LATE:
        return "*"
    if m.kind == K.TYPENAME:
        base = resolve(b, m.base, depth + 1)
        return f"{base}.<{', '.join(resolve(b, p, depth + 1) for p in m.params)}>" if m.params else base
    return f"multiname[{i}]"


def package(b: Block, i: int, depth: int = 0) -> str:
    """The package: only qualified names have one; that of a type name is its base's."""
    if not 0 < i < len(b.multinames) or depth > MOST_DEPTH:
        return ""
    m = b.multinames[i]
    if m.kind == K.TYPENAME:
        return package(b, m.base, depth + 1)
    if m.kind not in (K.QNAME, K.QNAME_A) or not 0 < m.ns < len(b.namespaces):
        return ""
    name = b.namespaces[m.ns][1]
    return b.strings[name] if 0 < name < len(b.strings) else ""


def ns_kind(b: Block, i: int) -> int:
    if not 0 < i < len(b.multinames):
        return 0
    ns = b.multinames[i].ns
    return b.namespaces[ns][0] if 0 < ns < len(b.namespaces) else 0


def full(b: Block, i: int) -> tuple[str, str]:
    """(package, name); a missing name is *."""
    name = resolve(b, i)
    return package(b, i), "*" if name.startswith("multiname[") else name


def dotted(b: Block, i: int) -> str:
    p, n = full(b, i)
    return f"{p}.{n}" if p else n
