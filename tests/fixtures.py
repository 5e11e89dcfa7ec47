"""Blocks and movies built in code."""

from bytelens.codec import container
from bytelens.codec.builder import BlockBuilder
from bytelens.codec.code import assemble
from bytelens.functions import fixed as K


def test_class_block() -> bytes:
    """One class with a field and a method that pushes a string."""
    b = BlockBuilder()
    code = assemble("getlocal_0", "pushscope", ("pushstring", b.string("TestClass")), "pop", "returnvoid")
    method = b.member("doStuff", code, ["String"], "void", names=["arg0"])
    b.klass("com.test.TestClass", "com.test.Object", traits=[b.slot("myField", "int", 1), method])
    return b.build()


test_class_block.__test__ = False


def game_block() -> bytes:
    """An interface, three game classes and a HUD."""
    b = BlockBuilder()
    push = lambda s: ("pushstring", b.string(s))
    trace = b.qname("trace")
    entity = b.qname("Entity", "com.game")
    b.klass("IDrawable", "Object", traits=[b.member("draw", b"\x47", (), "void")], flags=K.INTERFACE)
    b.klass(
        "com.game.Entity", "Object", ["IDrawable"],
        [
            b.slot("hp", "int", 1), b.slot("name", "String", 2),
            b.member("getName", assemble(push("entity"), "returnvalue"), (), "String", kind=K.GETTER),
            b.member("update", assemble(push("updating entity"), "pop", "returnvoid"), (), "void"),
        ],
    )
    attack = assemble(push("attacking!"), "pop", ("findpropstrict", trace), push("player attacks"), ("callpropvoid", trace, 1), "returnvoid")
    b.klass("com.game.Player", "com.game.Entity", traits=[b.slot("score", "int", 3), b.member("attack", attack, ["int"], "void")])
    b.klass("com.game.Enemy", "com.game.Entity")
    render = assemble(push("Score: 0"), "pop", push("http://assets.example.com/hud.png"), "pop", ("findpropstrict", entity), ("constructprop", entity, 0), "pop", "returnvoid")
    b.klass("com.ui.HUD", "Object", traits=[b.member("render", render, (), "void")])
    return b.build()


def movie(block: bytes, name: str = "main", compress: bool = True) -> bytes:
    return container.MovieBuilder().add_block(block, name).set_document_class("Main").build(compress)
