"""Building blocks: interned pools, classes, methods, bodies."""

from __future__ import annotations

from ..functions import fixed as K
from . import block as B
from .code import assemble


class BlockBuilder:
    """A new block; every method returns the index of what it added."""

    def __init__(self) -> None:
        self.block = B.Block()
        self._known: dict[tuple, int] = {}
        self._in_script: list[B.Trait] = []

    def _intern(self, pool: list, value, *key) -> int:
        key = key or (id(pool), value)
        if key not in self._known:
            pool.append(value)
            self._known[key] = len(pool) - 1
        return self._known[key]

    def string(self, s: str) -> int:
        return self._intern(self.block.strings, s) if s else 0

    def int(self, n: int) -> int:
        return self._intern(self.block.ints, n)

    def uint(self, n: int) -> int:
        return self._intern(self.block.uints, n)

    def double(self, x: float) -> int:
        return self._intern(self.block.doubles, x, "double", repr(x))

    def namespace(self, name: str = "", kind: int = K.NS_PACKAGE) -> int:
        return self._intern(self.block.namespaces, (kind, self.string(name)))

    def private_namespace(self, name: str = "") -> int:
        return self.namespace(name, K.NS_PRIVATE)

    def internal_namespace(self, name: str = "") -> int:
        return self.namespace(name, K.NS_INTERNAL)

    def protected_namespace(self, name: str = "") -> int:
        return self.namespace(name, K.NS_PROTECTED)

    def _add(self, pool: list, value) -> int:
        pool.append(value)
        return len(pool) - 1

    def ns_set(self, namespaces: list[int]) -> int:
        return self._add(self.block.ns_sets, list(namespaces))

    def qname(self, name: str, package: str = "", ns: int | None = None) -> int:
        if name == "*":
            return 0
        value = B.Multiname(K.QNAME, ns=self.namespace(package) if ns is None else ns, name=self.string(name))
        return self._intern(self.block.multinames, value, "qname", value.ns, value.name)

    def dotted(self, name: str | int | None) -> int:
        """The name of a dotted path; an index stays as it is."""
        if name is None or isinstance(name, int):
            return name or 0
        package, _, simple = name.rpartition(".")
        return self.qname(simple, package)

    def multiname(self, name: str, ns_set: int) -> int:
        return self._add(self.block.multinames, B.Multiname(K.MULTINAME, name=self.string(name), ns_set=ns_set))

    def multiname_late(self, ns_set: int) -> int:
        return self._add(self.block.multinames, B.Multiname(K.MULTINAME_L, ns_set=ns_set))

    def rtqname(self, name: str) -> int:
        return self._add(self.block.multinames, B.Multiname(K.RTQNAME, name=self.string(name)))

    def typename(self, base: int, params: list[int]) -> int:
        return self._add(self.block.multinames, B.Multiname(K.TYPENAME, base=base, params=list(params)))

    def method(self, params=(), returns="*", name: str = "", names=(), flags: int = 0, options=()) -> int:
        flags |= (K.HAS_PARAM_NAMES if names else 0) | (K.HAS_OPTIONAL if options else 0)
        m = B.Method([self.dotted(p) for p in params], self.dotted(returns), self.string(name), flags, list(options), [self.string(n) for n in names])
        return self._add(self.block.methods, m)

    def body(self, method: int, code: bytes = b"\x47", max_stack: int = 8, local_count: int = 8, handlers=(), scope: tuple[int, int] = (0, 8)) -> int:
        return self._add(self.block.bodies, B.Body(method, max_stack, local_count, *scope, code, [B.Handler(*h) for h in handlers]))

    def slot(self, name: str, type_name="*", slot: int = 0, const: bool = False, vindex: int = 0, vkind: int = -1, ns: int | None = None) -> B.Trait:
        return B.Trait(self.qname(name, ns=ns), K.CONST if const else K.SLOT, 0, slot, self.dotted(type_name), vindex, vkind)

    def method_trait(self, name: str, method: int, kind: int = K.METHOD, attr: int = 0, disp: int = 0, ns: int | None = None) -> B.Trait:
        return B.Trait(self.qname(name, ns=ns), kind, attr, disp=disp, method=method)

    def klass(self, name: str, super_name: str | None = "Object", interfaces=(), traits=(), statics=(), flags: int = K.SEALED, init: bytes | None = None, cinit: bytes = b"\x47", init_params=()) -> int:
        """A class of a dotted name; its initialisers get bodies (interfaces only the static one)."""
        iinit, static = self.method(init_params), self.method()
        if init is None:
            init = assemble("getlocal_0", "pushscope", "getlocal_0", ("constructsuper", 0), "returnvoid")
        if not flags & K.INTERFACE:
            self.body(iinit, init)
        self.body(static, cinit)
        c = B.Instance(self.dotted(name), self.dotted(super_name), flags, 0, [self.dotted(i) for i in interfaces], iinit, static, list(traits), list(statics))
        index = self._add(self.block.instances, c)
        self._in_script.append(B.Trait(c.name, K.CLASS, klass=index))
        return index

    def member(self, name: str, code: bytes | None = b"\x47", params=(), returns="*", kind: int = K.METHOD, attr: int = 0, handlers=(), ns: int | None = None, **signature) -> B.Trait:
        """A method with a body (none if `code` is None) and its trait."""
        m = self.method(params, returns, **signature)
        if code is not None:
            self.body(m, code, handlers=handlers)
        return self.method_trait(name, m, kind, attr, ns=ns)

    def script(self, traits=()) -> int:
        init = self.method()
        self.body(init, assemble("getlocal_0", "pushscope", "returnvoid"))
        return self._add(self.block.scripts, B.Script(init, list(traits)))

    def build(self) -> bytes:
        """The block's bytes; if there is no script, every class gets one, as compilers do."""
        if not self.block.scripts:
            for trait in self._in_script:
                self.script([trait])
        return B.serialize(self.block)
