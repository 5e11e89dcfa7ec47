"""Trees, text, structure and rewrites."""

import pytest

from bytelens.codec import block as B
from bytelens.codec.builder import BlockBuilder
from bytelens.codec.code import assemble, decode
from bytelens.functions import fixed as K
from bytelens.kernels import ast as A
from bytelens.kernels import decompile as D
from bytelens.kernels import graph as G
from bytelens.kernels.printer import Printer
from bytelens.kernels.rewrite import polished
from bytelens.session import Workspace

from .fixtures import game_block, movie

X, Y, ONE = A.Identifier("x"), A.Identifier("y"), A.Literal(1)
show = Printer().source


@pytest.mark.parametrize(
    "tree,text",
    [
        (A.Literal(None), "null"), (A.Literal(True), "true"), (A.Literal(2.0), "2"), (A.Literal(float("nan")), "NaN"), (A.Literal(-float("inf")), "-Infinity"), (A.Literal('a"\n'), '"a\\"\\n"'),
        (A.BinaryOp("*", A.BinaryOp("+", X, Y), ONE), "(x + y) * 1"), (A.BinaryOp("-", X, A.BinaryOp("-", Y, ONE)), "x - (y - 1)"), (A.BinaryOp("-", A.BinaryOp("-", X, Y), ONE), "x - y - 1"),
        (A.UnaryOp("!", A.BinaryOp("==", X, Y)), "!(x == y)"), (A.UnaryOp("-", A.Literal(-5)), "--5"), (A.MemberAccess(A.BinaryOp("+", X, Y), "z"), "(x + y).z"),
        (A.TernaryOp(A.TernaryOp(X, Y, ONE), X, A.TernaryOp(X, Y, ONE)), "(x ? y : 1) ? x : x ? y : 1"), (A.AssignExpr(X, A.AssignExpr(Y, ONE)), "x = y = 1"),
        (A.MethodCall(A.MemberAccess(X, "f"), (A.AssignExpr(X, ONE), Y)), "x.f(x = 1, y)"), (A.NewExpr(A.Identifier("P"), ()), "new P()"), (A.CastExpr("int", A.BinaryOp("+", X, Y)), "int(x + y)"),
        (A.IsExpr(X, A.Identifier("T")), "x is T"), (A.InExpr(X, Y), "x in y"), (A.TypeofExpr(X), "typeof x"), (A.DeleteExpr(A.IndexAccess(X, Y)), "delete x[y]"),
        (A.BinaryOp("+", A.BinaryOp("instanceof", X, Y), ONE), "(x instanceof y) + 1"), (A.ObjectLiteral((A.ObjectProperty("k", ONE),)), "{k: 1}"), (A.ArrayLiteral((X, ONE)), "[x, 1]"),
        (A.CompoundAssignExpr("+", X, ONE), "x += 1"), (A.BlockStmt(), "{\n}"), (A.VarDeclStmt("v", "int", ONE), "var v:int = 1;"), (A.BreakStmt("l"), "break l;"),
        (A.IfStmt(X, A.BlockStmt(), A.IfStmt(Y, A.BlockStmt())), "if (x) {\n} else if (y) {\n}"), (A.DoWhileStmt(A.BlockStmt(), X), "do {\n} while (x);"),
        (A.ForStmt(A.VarDeclStmt("i", None, ONE), X, None, A.BlockStmt()), "for (var i = 1; x; ) {\n}"), (A.ForEachStmt("v", "int", X, A.BlockStmt()), "for each (var v:int in x) {\n}"),
        (A.SwitchStmt(X, (A.SwitchCase(ONE, (A.BreakStmt(),)), A.SwitchCase(None))), "switch (x) {\n    case 1:\n        break;\n    default:\n}"),
        (A.TryStmt(A.BlockStmt(), (A.CatchClause("e", "Error", A.BlockStmt()),), A.BlockStmt()), "try {\n} catch (e:Error) {\n} finally {\n}"),
        (A.FunctionExpr(None, (("a", "int"),), "void", A.BlockStmt((A.ReturnStmt(),))), "function(a:int):void {\n    return;\n}"),
    ],
)
def test_text(tree, text):
    assert show(tree) == text


def tree(code, handlers=(), params=(), late=False, setup=None):
    b = BlockBuilder()
    names = setup(b) if setup else None
    b.member("run", code(names) if callable(code) else code, params, handlers=handlers)
    b.klass("T")
    parsed = B.parse(b.build())
    return parsed, " ".join(show(D.method_tree(parsed, 0, index_access=late, raw=True)).split()), " ".join(show(D.method_tree(parsed, 0, index_access=late)).split())


@pytest.mark.parametrize(
    "steps,text",
    [
        (["returnvoid"], "{ return; }"),
        ([("pushbyte", 7), "setlocal_1", "returnvoid"], "{ _loc1_ = 7; return; }"),
        (["getlocal_1", "getlocal_2", "equals", ("iffalse", ":no"), ("pushbyte", 1), "returnvalue", ":no", ("pushbyte", 0), "returnvalue"], "{ if (_loc1_ == _loc2_) { return 1; } else { return 0; } }"),
        (["getlocal_1", ("iftrue", ":yes"), ("pushbyte", 2), "returnvalue", ":yes", ("pushbyte", 1), "returnvalue"], "{ if (_loc1_) { return 1; } else { return 2; } }"),
        (
            [("pushbyte", 0), "setlocal_1", ":top", "getlocal_1", ("pushbyte", 0), "equals", ("iffalse", ":end"), "getlocal_1", "increment", "setlocal_1", ("jump", ":top"), ":end", "getlocal_1", "returnvalue"],
            "{ _loc1_ = 0; while (_loc1_ == 0) { _loc1_ = _loc1_ + 1; } return _loc1_; }",
        ),
        ([":top", "getlocal_1", ("iftrue", ":end"), ("jump", ":top"), ":end", "returnvoid"], "{ while (!_loc1_) { } return; }"),
        (
            ["getlocal_1", ("lookupswitch", ":d", ":a", ":b"), ":a", ("pushbyte", 1), "returnvalue", ":b", ("pushbyte", 2), "returnvalue", ":d", ("pushbyte", 0), "returnvalue"],
            "{ switch (_loc1_) { case 0: return 1; case 1: return 2; default: return 0; } }",
        ),
        ([("pushbyte", 0xFF), "convert_d", "negate", "returnvalue"], "{ return -Number(-1); }"),
        (["getlocal_1", "getlocal_2", ("ifnlt", ":e"), "returnvoid", ":e", "returnvoid"], "{ if (_loc1_ < _loc2_) { return; } else { return; } }"),
        (["getlocal_0", "dup", "swap", ("newarray", 2), "pop", ("hasnext2", 1, 2), ("iftrue", ":e"), ":e", "returnvoid"], "{ return; }"),
        (["getlocal_1", ("iftrue", ":a"), ("pushbyte", 1), ("jump", ":b"), ":a", ("pushbyte", 2), ":b", "returnvalue"], "{ if (_loc1_) { } return _s0_b3; }"),
    ],
)
def test_structure(steps, text):
    assert tree(assemble(*steps))[1] == text


def test_try_and_catch():
    code = assemble(("pushbyte", 0), "returnvalue", "pop", ("pushbyte", 9), "returnvalue")
    assert tree(code, handlers=[(0, 3, 3)])[1] == "{ try { return 0; } catch (_catch0_) { return 9; } }"


def test_members_and_calls():
    def code(n):
        return assemble(
            ("findpropstrict", n["trace"]), "getlocal_0", ("getproperty", n["hp"]), ("callpropvoid", n["trace"], 1), "getlocal_0", ("pushbyte", 3), ("setproperty", n["hp"]),
            ("getlex", n["Point"]), ("pushbyte", 1), ("construct", 1), "pop", ("findpropstrict", n["Point"]), ("constructprop", n["Point"], 0), ("coerce", n["Point"]), "returnvalue",
        )

    names = lambda b: {k: b.qname(k) for k in ("trace", "hp", "Point")}
    assert tree(code, setup=names)[1] == "{ trace(this.hp); this.hp = 3; new Point(1); return Point(new Point()); }"


def test_late_names():
    late = lambda b: {"any": b.multiname_late(b.ns_set([b.namespace()]))}
    code = lambda n: assemble("getlocal_1", ("pushbyte", 2), ("getproperty", n["any"]), "returnvalue")
    assert tree(code, setup=late, late=True)[1] == "{ return _loc1_[2]; }"


def test_rewrites():
    assign = lambda t, v: A.ExpressionStmt(A.AssignExpr(t, v))
    plus = A.AssignExpr(X, A.BinaryOp("+", X, ONE))
    cases = [
        (A.UnaryOp("!", A.UnaryOp("!", X)), "x"),
        (plus, "x += 1"),
        (A.IfStmt(Y, A.BlockStmt((assign(X, ONE),)), A.BlockStmt((assign(X, Y),))), "x = y ? 1 : y;"),
        (A.BlockStmt((A.IfStmt(X, A.BlockStmt((A.ReturnStmt(ONE),)), A.BlockStmt((assign(Y, ONE),))),)), "{ if (x) { return 1; } y = 1; }"),
        (A.BlockStmt((assign(X, ONE), A.WhileStmt(A.BinaryOp("<", X, Y), A.BlockStmt((A.ExpressionStmt(plus),))))), "{ for (x = 1; x < y; x += 1) { } }"),
        (A.BlockStmt((assign(X, ONE), A.ReturnStmt())), "{ x = 1; }"),
    ]
    for before, after in cases:
        done = polished(before)
        assert " ".join(show(done).split()) == after and polished(done) == done


def test_dominators_and_loops():
    code = decode(assemble(":top", "getlocal_1", ("iffalse", ":end"), ":inner", "getlocal_2", ("iftrue", ":inner"), ("jump", ":top"), ":end", "returnvoid"))
    g = G.graph_of(code)
    assert G.immediate_dominators(g) == {0: 0, 1: 0, 2: 1, 3: 0} and G.immediate_postdominators(g) == {0: 3, 1: 2, 2: 0, 3: 3}
    assert [(x.header, sorted(x.body), x.parent) for x in G.loops(g)] == [(0, [0, 1, 2], None), (1, [1], 0)]
    two = G.graph_of(decode(assemble("getlocal_1", ("iftrue", ":a"), "returnvoid", ":a", "returnvoid")))
    assert G.immediate_postdominators(two) == {0: -1, 1: 1, 2: 2} and G.complexity(two) == 1
    endless = G.graph_of(decode(assemble(":t", ("jump", ":t"))))
    assert G.immediate_postdominators(endless) == {0: -1} and G.loops(endless)[0].tails == [0]
    dead = G.graph_of(decode(assemble(("jump", ":e"), "returnvoid", ":e", "returnvoid")))
    assert G.immediate_dominators(dead)[1] == 1


def test_classes():
    b = B.parse(game_block())
    text = {D.full(b, c.name)[1]: D.class_source(b, i) for i, c in enumerate(b.instances)}
    assert text["Player"] == (
        "package com.game\n{\n    public class Player extends Entity\n    {\n        public var score:int;\n\n        public function Player()\n        {\n            super();\n        }\n\n"
        '        public function attack(_arg_1:int):void\n        {\n            trace("player attacks");\n        }\n    }\n}\n'
    )
    assert "public interface IDrawable\n" in text["IDrawable"] and "function draw():void;" in text["IDrawable"]
    assert "public class Entity implements IDrawable\n" in text["Entity"] and "function get getName():String" in text["Entity"]
    assert "import com.game.Entity;" in text["HUD"] and "new Entity()" in text["HUD"]


def test_fields_defaults_and_statics():
    b = BlockBuilder()
    count = b.slot("count", "int", vindex=b.int(4096), vkind=3, const=True)
    ratio = b.slot("ratio", "Number", vindex=b.int(2), vkind=3, ns=b.private_namespace("x"))
    plain = b.slot("late", "String")
    init = assemble("getlocal_0", "pushscope", ("findproperty", plain.name), ("pushstring", b.string("v")), ("initproperty", plain.name), ("findpropstrict", b.qname("boot")), ("callpropvoid", b.qname("boot"), 0), "returnvoid")
    m = b.method(["int", "String"], "void", names=["a", ""], options=[(b.string("s"), 1)], flags=K.NEED_REST)
    b.body(m)
    b.klass("p.C", traits=[ratio, b.method_trait("go", m, attr=K.ATTR_OVERRIDE | K.ATTR_FINAL)], statics=[count, plain], cinit=init, flags=0)
    text = D.class_source(B.parse(b.build()), 0)
    for line in ("public dynamic class C", "public static const count:int = 0x1000;", 'public static var late:String = "v";', "private var ratio:Number = 2.0;", "boot();", 'final override public function go(a:int, _arg_2:String="s", ...rest):void'):
        assert line in text, text


def test_scripts_and_errors(spark, tmp_path):
    b = BlockBuilder()
    f = b.method(["int"], "int")
    b.body(f, assemble("getlocal_1", "returnvalue"))
    b.script([b.slot("top", "int"), B.Trait(b.qname("f"), K.FUNCTION, function=f)])
    ws = Workspace.of_bytes(spark, ("s.swf", movie(b.build())), ("game.swf", movie(game_block())))
    text = [r.source for r in D.scripts(ws.files.blocks).collect() if r.functions]
    assert text == ["public var top:int;\nfunction f(_arg_1:int):int\n{\n    return _arg_1;\n}\n"]
    assert {r.name for r in ws.decompile().collect() if r.error is None} == {"IDrawable", "Entity", "Player", "Enemy", "HUD"}
    assert {r.source for r in D.methods(ws.files.blocks).filter("method_name = 'attack'").collect()} == {'trace("player attacks");'}
    assert D.write_tree(D.first_blocks(ws.files.blocks), str(tmp_path)).count() == 5
    assert (tmp_path / "com" / "game" / "Player.as").read_text().startswith("package com.game")
    rows = G.flow(ws.files.blocks).collect()
    assert rows and all(r.complexity >= 1 and r.idom is not None for r in rows)


def test_bad_code_is_a_comment():
    b = B.parse(game_block())
    b.bodies[0].code = bytes([0x4F])  # cut off
    assert D.method_body(b, b.bodies[0].method) == ""
    b.methods.clear()
    assert D.class_source(b, 2)


def calls_of(b, name):
    return [("getlocal_0"), ("callpropvoid", b.qname(name), 0)]


@pytest.mark.parametrize(
    "body,want",
    [
        # while (a) { if (b) break; f(); } g();
        ([":top", "getlocal_1", ("iffalse", ":end"), "getlocal_2", ("iftrue", ":end"), "F", ("jump", ":top"), ":end", "G", "returnvoid"], "{ while (_loc1_) { if (_loc2_) { break; } f(); } g(); }"),
        # while (a) { if (b) continue; f(); } g();
        ([":top", "getlocal_1", ("iffalse", ":end"), "getlocal_2", ("iftrue", ":top"), "F", ("jump", ":top"), ":end", "G", "returnvoid"], "{ while (_loc1_) { if (_loc2_) { } else { f(); } } g(); }"),
        # while (a) { if (b) { f(); break; } g(); } g();
        ([":top", "getlocal_1", ("iffalse", ":end"), "getlocal_2", ("iffalse", ":go"), "F", ("jump", ":end"), ":go", "G", ("jump", ":top"), ":end", "G", "returnvoid"], "{ while (_loc1_) { if (_loc2_) { f(); break; } g(); } g(); }"),
        # while (a) { if (b) { f(); } else if (c) { break; } g(); } g();
        (
            [":top", "getlocal_1", ("iffalse", ":end"), "getlocal_2", ("iffalse", ":else"), "F", ("jump", ":meet"), ":else", "getlocal_3", ("iftrue", ":end"), ":meet", "G", ("jump", ":top"), ":end", "G", "returnvoid"],
            "{ while (_loc1_) { if (_loc2_) { f(); } else if (_loc3_) { break; } g(); } g(); }",
        ),
    ],
)
def test_loops_are_left_where_they_are_left(body, want):
    b = BlockBuilder()
    steps = []
    for x in body:
        steps += calls_of(b, x.lower()) if x in ("F", "G") else [x]
    b.member("run", assemble(*steps))
    b.klass("T")
    got = " ".join(show(D.method_tree(B.parse(b.build()), 0)).split()).replace("this.", "").replace(" return; }", " }")
    assert got == want


def test_written_paths_stay_inside(tmp_path):
    for folders, name in ((["..", ".."], "x"), (["/etc"], "passwd"), ([], "../../x"), (["a", ""], ".."), (["a"], "b/c")):
        path = D.contained(str(tmp_path), folders, name)
        assert path.startswith(str(tmp_path)) and ".." not in path[len(str(tmp_path)) :].replace("_..", "").split("/")
