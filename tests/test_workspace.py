"""Containers through every operator: the game movie's answers, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from bytelens.codec import block as B
from bytelens.codec.builder import BlockBuilder
from bytelens.codec.code import assemble
from bytelens.functions import fixed as K
from bytelens.operators import calls, classgraph, fields, flow, inheritance, references, strings, structure
from bytelens.session import Workspace
from bytelens.sources import files

from .fixtures import game_block, movie, test_class_block


@pytest.fixture(scope="module")
def game(spark):
    return Workspace.of_bytes(spark, ("game.swf", movie(game_block())))


def column(df):
    return sorted(r[0] for r in df.collect())


def test_classes_and_packages(game):
    assert column(game.classes.select("qualified_name")) == ["IDrawable", "com.game.Enemy", "com.game.Entity", "com.game.Player", "com.ui.HUD"]
    assert {r["package"]: r.classes for r in game.packages().collect()} == {"": ["IDrawable"], "com.game": ["Enemy", "Entity", "Player"], "com.ui": ["HUD"]}
    row = game.find_methods(name="attack").first()
    assert (row.return_type, row.param_types, row.class_name) == ("void", ["int"], "com.game.Player")
    assert column(game.find_fields(type_name="int").select("name")) == ["hp", "score"]
    assert game.get_class("Player").first().super_qualified == "com.game.Entity"
    assert column(structure.with_method_returning(game.model, "String").select("name")) == ["Entity"]
    assert {r.full_name: r.trait_count for r in game.class_summaries().collect()}["com.game.Entity"] == 4


def test_strings(game):
    m = game.model
    assert column(strings.used(m)) == ["Score: 0", "attacking!", "entity", "http://assets.example.com/hud.png", "player attacks", "updating entity"]
    assert column(strings.urls(strings.used(m))) == ["http://assets.example.com/hud.png"]
    assert column(strings.ui_texts(strings.used(m))) == ["Score: 0", "player attacks", "updating entity"]
    assert column(game.search_strings("ATTACK")) == ["attacking!", "player attacks"]
    assert column(game.search_strings(r"^\w+!$", regex=True)) == ["attacking!"] and column(game.search_strings("(", regex=True)) == []
    assert "com.game" in column(game.search_pool("com.game")) and column(game.strings_in_class("Player")) == ["attacking!", "player attacks"]
    assert column(game.classes_using_string("entity")) == ["com.game.Entity"]


def test_references(game):
    refs = game.references
    assert {(r.source_class, r.source_member, r.target) for r in references.of_kind(refs, "extends").collect()} == {
        ("com.game.Player", "<extends>", "com.game.Entity"), ("com.game.Enemy", "<extends>", "com.game.Entity"),
    }
    assert column(game.instantiators("Entity").select("source_class")) == ["com.ui.HUD"]
    assert column(game.type_users("int").select("source_member")) == ["attack", "hp", "score"]


def test_calls(game):
    assert {(r.caller, r.edge_type) for r in game.callers("trace").collect()} == {("Player.attack", "read"), ("Player.attack", "call")}
    assert calls.instantiators(game.edges).filter("target = 'Entity'").first().callers == ["HUD.render"]
    assert column(game.distinct_arg_values("trace", 0)) == ["s:player attacks"]


def test_hierarchy(game):
    m = game.model
    assert column(game.roots()) == ["IDrawable", "com.game.Entity", "com.ui.HUD"]
    assert [r.ancestor for r in game.ancestors("Player").collect()] == ["com.game.Entity", "Object"]
    assert [r.name for r in game.descendants("com.game.Entity").collect()] == ["com.game.Enemy", "com.game.Player"]
    assert {r.name: r.depth for r in inheritance.depths(m).collect()}["com.game.Player"] == 2
    assert game.implementors("IDrawable").first().classes == ["com.game.Entity"]
    assert column(inheritance.closure_sql(m).filter("name = 'com.game.Player'").select("ancestor")) == ["Object", "com.game.Entity"]
    assert [r.line for r in inheritance.tree_lines(m, "com.game.Entity").collect()] == ["  com.game.Enemy", "  com.game.Player"]


def test_deep_hierarchies_are_whole(spark):
    b = BlockBuilder()
    for i in range(103):
        b.klass(f"C{i}", f"C{i + 1}")
    m = Workspace.of_bytes(spark, ("x.swf", movie(b.build()))).model
    m.classes = m.classes.cache()
    assert inheritance.ancestors(m).filter("name = 'C0'").count() == 103


def test_cycles_end(spark):
    b = BlockBuilder()
    b.klass("A", "B")
    b.klass("B", "A")
    m = Workspace.of_bytes(spark, ("x.swf", movie(b.build()))).model
    assert {(r.name, r.ancestor) for r in inheritance.ancestors(m).collect()} >= {("A", "B"), ("B", "A")}
    assert inheritance.descendants(m).count() == 4 and inheritance.tree_lines(m, "A").count() == 1


def test_dead_code_and_graph(game):
    assert column(game.dead_classes()) == ["com.game.Enemy", "com.game.Player", "com.ui.HUD"]
    assert {(r.class_name, r.method_name) for r in game.dead_methods().collect()} == {("IDrawable", "draw"), ("com.game.Entity", "update"), ("com.game.Player", "attack"), ("com.ui.HUD", "render")}
    assert column(game.entrypoints()) == []
    assert {(r.source, r.target, r.kind) for r in game.class_edges().collect()} == {
        ("Entity", "IDrawable", "implements"), ("Player", "Entity", "extends"), ("Enemy", "Entity", "extends"), ("HUD", "Entity", "instantiation"),
    }
    nodes = {r.name: r for r in classgraph.nodes(game.model).collect()}
    assert nodes["Entity"].field_count == 2 and nodes["Entity"].method_count == 2 and nodes["Player"].super_name == "?"


def test_test_class(spark):
    ws = Workspace.of_bytes(spark, ("t.swf", movie(test_class_block(), compress=False)))
    refs = [(r.source_member, r.target, r.ref_kind, r.offset) for r in ws.references.collect()]
    assert sorted(refs) == sorted([("myField", "int", "field_type", -1), ("doStuff", "void", "return_type", -1), ("doStuff", "String", "param_type", -1), ("<extends>", "com.test.Object", "extends", -1), ("doStuff", "TestClass", "string_use", 2)][:3] + [("doStuff", "TestClass", "string_use", 2)])
    assert {r.complexity for r in ws.complexity().collect()} == {1}
    assert column(strings.used(ws.model)) == ["TestClass"]


def program(spark, code, handlers=(), **more):
    b = BlockBuilder()
    names = {k: b.qname(v) for k, v in more.items()}
    code = code(names) if callable(code) else code
    b.klass("T", traits=[b.member("run", code, handlers=handlers)])
    ws = Workspace.of_bytes(spark, ("t.swf", movie(b.build())))
    body = ws.model.methods.filter("name = 'run'").first().body_index
    return ws, body


def test_fields_and_constructors(spark):
    b = BlockBuilder()
    n = {k: b.qname(k) for k in ("hp", "mp", "xp")}
    init = assemble("getlocal_0", ("pushbyte", 1), ("initproperty", n["mp"]), "getlocal_0", ("pushbyte", 1), ("setproperty", n["hp"]), "getlocal_0", ("pushbyte", 2), ("setproperty", n["mp"]), "returnvoid")
    reset = assemble("getlocal_0", "getlocal_0", ("getproperty", n["xp"]), ("setproperty", n["hp"]), "returnvoid")
    b.klass("a.Hero", traits=[b.member("reset", reset)], init=init)
    ws = Workspace.of_bytes(spark, ("t.swf", movie(b.build())))
    assert ws.constructor_assignments("Hero").first().fields == ["mp", "hp", "mp"]
    assert ws.field_writers("a.Hero", "hp").first().methods == ["<init>", "reset"] and ws.field_readers("Hero", "xp").first().methods == ["reset"]
    assert tuple(fields.totals(ws.accesses).first()) == (5, 1, 4)
    assert {r.field_name: (r.readers, r.writers) for r in ws.field_summary("Hero").collect()}["mp"] == ([], ["<init>"])


def test_const_args_stop_at_the_first_break(spark):
    def code(n):
        return assemble(
            ("getlex", n["f"]), ("pushbyte", 0xFF), ("callpropvoid", n["f"], 1), "getlocal_1", "pushtrue", ("callpropvoid", n["f"], 2), "pushundefined", "pushnull", ("callpropvoid", n["f"], 2),
            "pushnan", ("pushshort", 3), ("callpropvoid", n["f"], 2), ("callpropvoid", n["f"], 0), "returnvoid",
        )

    ws, _ = program(spark, code, f="SetFlag")
    got = [[(a.kind, a.i, a.b) for a in r.args] for r in ws.const_args.orderBy("offset").collect() if r.target == "SetFlag"]
    unknown = ("unknown", None, None)
    assert got == [[("int", -1, None)], [unknown, ("bool", None, True)], [unknown, ("null", None, None)], [unknown, ("int", 3, None)], []]
    assert column(ws.distinct_arg_values("SetFlag", 1)) == ["n:1.0", "n:3.0", "null"]


@pytest.mark.parametrize(
    "steps,starts,edges,complexity",
    [
        ([("jump", ":e"), "returnvoid", ":e", "returnvoid"], [0, 4, 5], [(0, 5)], 1),
        ([("pushbyte", 1), ("iftrue", ":e"), "returnvoid", ":e", "returnvoid"], [0, 6, 7], [(0, 6), (0, 7)], 1),
        ([":s", ("pushbyte", 1), ("iftrue", ":s"), "returnvoid"], [0, 6], [(0, 0), (0, 6)], 2),
        ([("lookupswitch", ":a", ":b", ":c"), ":a", "returnvoid", ":b", "returnvoid", ":c", "returnvoid"], [0, 11, 12, 13], [(0, 11), (0, 12), (0, 13)], 1),
        ([("lookupswitch", ":a", ":a", ":a"), ":a", "returnvoid"], [0, 11], [(0, 11)], 1),
    ],
)
def test_control_flow(spark, steps, starts, edges, complexity):
    ws, body = program(spark, assemble(*steps))
    found, links, _ = ws.flow
    at = {r.block: r.start for r in found.filter(F.col("body_index") == body).collect()}
    assert sorted(at.values()) == starts
    assert sorted((at[r.src], at[r.dst]) for r in links.filter(F.col("body_index") == body).collect()) == edges
    assert ws.complexity().filter(F.col("body_index") == body).first().complexity == complexity


def test_handlers_cover_blocks(spark):
    ws, body = program(spark, assemble(("pushbyte", 1), "pop", "returnvoid", "pushscope", "returnvoid"), handlers=[(0, 4, 4)])
    found, _, cover = ws.flow
    kinds = {r.start: r.kind for r in found.filter(F.col("body_index") == body).collect()}
    assert kinds == {0: "normal", 4: "catch_entry"}
    assert [(r.block, r.handler) for r in cover.filter(F.col("body_index") == body).collect()] == [(0, 0)]


def test_registers(spark):
    ws, body = program(spark, assemble("getlocal_0", "setlocal_1", ("inclocal", 2), ("hasnext2", 3, 4), ("kill", 1), "getlocal_0", "returnvoid"))
    live = {r.reg: (r.reads, r.writes, r.first_write, r.last_read) for r in ws.liveness().filter(F.col("body_index") == body).collect()}
    assert live == {0: (2, 0, None, 9), 1: (0, 2, 1, None), 2: (1, 1, 2, 2), 3: (1, 1, 4, 4), 4: (1, 1, 4, 4)}
    use = {r.reg: r.is_write_only for r in flow.register_use(flow.liveness(flow.register_accesses(ws.model.code.filter(F.col("body_index") == body)))).collect()}
    assert use == {0: False, 1: True, 2: False, 3: False, 4: False}


def test_increment_patterns(spark):
    ws, body = program(spark, assemble("getlocal_1", "increment", "setlocal_1", ("getlocal", 5), "decrement_i", ("setlocal", 5), "getlocal_1", "increment", "setlocal_2", "returnvoid"))
    assert [(r.seq, r.reg, r.op) for r in flow.increments(ws.model.code).filter(F.col("body_index") == body).orderBy("seq").collect()] == [(0, 1, "increment"), (3, 5, "decrement_i")]


def test_fingerprints(spark):
    ws, body = program(spark, lambda n: assemble("getlocal_0", "pushscope", ("pushbyte", 200), ("pushbyte", 3), "add", ("callproperty", n["f"], 1), ("iftrue", ":e"), ":e", "returnvoid"), f="f")
    r = ws.fingerprints().filter("method_name = 'run'").first()
    assert (r.instr_count, r.arithmetic_ops, r.call_count, r.branch_count, r.return_void, r.int_constants) == (8, 1, 1, 1, True, [3, 200])
    assert [(g.a, g.b, g.n) for g in r.opcode_bigrams][:2] == [("PUSH", "PUSH", 2), ("READ", "PUSH", 1)]
    assert ws.fingerprints().filter("is_constructor").first().method_name == "<constructor>"


def test_disassembly(game):
    got = [(r["at"], r.text) for r in game.disassemble("Player", "attack").collect()]
    assert got[0][1] == 'pushstring "attacking!"' and got[2][1] == "findpropstrict trace" and got[4] == ("0x0007", "callpropvoid trace, 1")


def test_unreadable_files_leave_errors(spark):
    ws = Workspace.of_bytes(spark, ("bad.swf", b"nothing"), ("empty.swf", b""), ("b.SWZ", game_block()), ("cut.swf", movie(game_block()[:90])), ("good.swf", movie(game_block())))
    errors = {r.path: r.error for r in ws.resources.collect()}
    assert errors["bad.swf"] and errors["empty.swf"] and not errors["b.SWZ"] and not errors["good.swf"]
    assert ws.files.block_errors.count() == 1 and ws.classes.select("resource_id").distinct().count() == 2
    assert ws.get_class("Player").first().resource_id == 4  # the one loaded last


def test_owners_do_not_mix_between_blocks(spark):
    other = BlockBuilder()
    other.klass("Other", traits=[other.member("go", assemble(("pushstring", other.string("x")), "returnvoid"))])
    ws = Workspace.of_bytes(spark, ("a.swf", movie(game_block())), ("b.swf", movie(other.build())))
    assert column(ws.classes_using_string("x")) == ["Other"] and column(ws.classes_using_string("entity")) == ["com.game.Entity"]


def test_rows_serialize_and_movies_rebuild(spark, game, tmp_path):
    rows = game.files.rows
    assert bytes(files.serialize(rows).first().data) == game_block()
    edited = rows.withColumn("s", F.when(F.col("s") == "attacking!", "defending!").otherwise(F.col("s")))
    blocks = files.serialize(edited)
    data = bytes(files.rebuild(game.files.parts, blocks).first().data)
    assert data == movie(bytes(blocks.first().data))
    again = Workspace.of_bytes(spark, ("new.swf", data))
    assert column(again.search_strings("defend")) == ["defending!"]
    assert B.parse(bytes(blocks.first().data)).strings != B.parse(game_block()).strings


def test_files_source_and_stream(spark, tmp_path):
    from bytelens.sources import datasource
    from bytelens.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.swf").write_bytes(movie(game_block()))
    (folder / "b.swz").write_bytes(game_block())
    ws = Workspace.load(spark, str(folder))
    assert ws.classes.count() == 10 and ws.tags.count() == 3 and ws.files.symbols.first().class_name == "Main"
    datasource.register(spark)
    got = spark.read.format("swf").option("table", "classes").load(str(folder))
    assert column(got.select("qualified_name")) == column(ws.classes.select("qualified_name"))
    query = ingest.append(ingest.tables(spark, str(folder)).model().classes, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_saved_workspaces_answer_alike(spark, game, tmp_path):
    game.save(str(tmp_path / "ws"))
    again = Workspace.open(spark, str(tmp_path / "ws"))
    assert column(again.dead_classes()) == column(game.dead_classes()) and again.complexity().count() == game.complexity().count()
    assert bytes(files.serialize(again.files.rows).first().data) == game_block()


def test_constants_are_classified():
    assert len(K.OPCODES) == 164 and K.EDGE_TYPES["newclass"] == "class"
