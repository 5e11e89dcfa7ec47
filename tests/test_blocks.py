"""Answers read in one pass over blocks, against the operators on tables that they stand for."""

from dataclasses import replace

from pyspark.sql import functions as F

from bytelens.operators import calls, flow, inheritance
from bytelens.plans import archive, bridge, catalogue, movies
from bytelens.session import Workspace
from bytelens.sources import files

from .fixtures import game_block, movie, test_class_block

SF = "/root/testdata/sf0.001"


def workspace(spark):
    return Workspace.of_bytes(spark, ("a.swf", movie(game_block())), ("b.swf", movie(test_class_block())))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_fingerprints_are_those_of_the_tables_and_move_nothing(spark):
    ws = workspace(spark)
    m, key = ws.model, ["resource_id", "abc_id", "method_index"]
    flags = ("is_static", "is_getter", "is_setter")
    own = m.methods.select("resource_id", "abc_id", "class_name", F.col("name").alias("method_name"), F.lit(False).alias("is_constructor"), "param_types", "return_type", *flags, "body_index")
    made = m.classes.withColumn("method_index", F.col("constructor_index")).join(m.bodies.select(*key, "body_index"), key).select(
        "resource_id", "abc_id", F.col("qualified_name").alias("class_name"), F.lit("<constructor>").alias("method_name"), F.lit(True).alias("is_constructor"), F.array().cast("array<string>").alias("param_types"),
        F.lit("void").alias("return_type"), *(F.lit(False).alias(c) for c in flags), "body_index",
    )
    want = flow.fingerprints(m.code, made.unionByName(own), m.bodies.drop("method_index"))
    got = ws.fingerprints()
    assert got.columns == want.columns and same(want, got) and got.count() == 11
    assert "Exchange" not in plan(got)


def test_customers_of_one_name_are_classes_of_their_own(spark, tmp_path):
    """Customers were joined to their classes by name, so that equal names multiplied the code of all."""
    for name in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    bridge.read(spark, SF, "customer").withColumn("c_name", F.lit("Same")).write.parquet(str(tmp_path / "customer.parquet"))
    calls_of = lambda folder: archive.swf_const_args(spark, folder).count()
    assert calls_of(str(tmp_path)) == calls_of(SF) > 0


def test_class_summaries_are_those_of_the_tables_and_move_nothing(spark):
    ws = workspace(spark)
    m, key = ws.model, ["resource_id", "abc_id", "class_name"]
    traits = m.fields.select(*key).unionByName(m.methods.select(*key)).groupBy(*key).agg(F.count("*").alias("trait_count"))
    want = m.classes.withColumn("class_name", F.col("qualified_name")).join(traits, key, "left").select(
        "resource_id", "abc_id", "class_idx", "name", "package", F.col("qualified_name").alias("full_name"), F.col("super_qualified").alias("super"), "is_interface", F.coalesce("trait_count", F.lit(0)).alias("trait_count")
    )
    got = ws.class_summaries()
    assert got.columns == want.columns and same(want, got) and got.count() == 6
    assert "Exchange" not in plan(got)


def test_constant_arguments_of_blocks_are_those_of_the_tables_and_move_nothing(spark):
    blocks = archive.class_blocks(spark, SF).limit(2).localCheckpoint()
    m = archive.model(blocks)
    got, want = calls.const_args(m), calls.const_args(replace(m, sites=None))
    assert same(want, got) and got.count() > 0
    ws = workspace(spark)
    assert same(calls.const_args(replace(ws.model, sites=None)), calls.const_args(ws.model))
    assert "Window" not in plan(got) and "Exchange" not in plan(got)


def test_sibling_spans_sum_up_the_pairs_without_making_them(spark):
    m = bridge.model(spark, SF)
    got = inheritance.sibling_spans(m)
    want = inheritance.siblings(m).groupBy("name").agg(F.count("*").alias("n"), F.min("sibling").alias("first"), F.max("sibling").alias("last"))
    assert same(want, got) and got.count() > 0
    for made in ([("a", "p"), ("b", "p"), ("c", "q"), (None, "p"), ("b", "q")], [("x", "p")]):
        rows = spark.createDataFrame([(n, p, i, "s") for i, (n, p) in enumerate(made)], "qualified_name string, super_qualified string, load_seq long, super_name string")
        odd = replace(m, classes=rows)
        want = inheritance.siblings(odd).groupBy("name").agg(F.count("*").alias("n"), F.min("sibling").alias("first"), F.max("sibling").alias("last"))
        assert same(want, inheritance.sibling_spans(odd))


def test_siblings_are_listed_for_every_class_and_summed_up_from_the_lists(spark, monkeypatch):
    """Numbers and ends were reckoned from each superclass's number and ends of children; no class was set against its siblings."""
    m = bridge.model(spark, SF)
    rows = [(r.qualified_name, r.super_qualified) for r in m.classes.collect()]
    want = sorted((a, b) for a, p in rows for b, q in rows if p == q and a != b)
    found = {a: [b for k, b in want if k == a] for a, _ in want}
    assert max(map(len, found.values())) > 3
    for size in (inheritance.LIST, 3):
        monkeypatch.setattr(inheritance, "LIST", size)
        lists = inheritance.sibling_lists(m).collect()
        assert sorted((r.name, s) for r in lists for s in r.siblings) == want and all(r.siblings == sorted(r.siblings) for r in lists)
        assert sorted(map(tuple, inheritance.siblings(m).select("name", "sibling").collect())) == want
        got = catalogue.QUERIES["inh_siblings"](spark, SF)
        assert sorted(map(tuple, got.select("name", "n", "first", "last").collect())) == [(a, len(x), x[0], x[-1]) for a, x in sorted(found.items())]
        assert "array_remove" in plan(got)
    # of equal names the class loaded last says whose children are its siblings; nulls are no siblings
    made = [("a", "p"), ("b", "p"), ("c", "q"), (None, "p"), ("b", "q"), ("d", None)]
    odd = replace(m, classes=spark.createDataFrame([(n, p, i, "s") for i, (n, p) in enumerate(made)], "qualified_name string, super_qualified string, load_seq long, super_name string"))
    assert sorted(map(tuple, inheritance.siblings(odd).collect())) == [("a", "b"), ("b", "c"), ("c", "b")]


def test_patched_blocks_are_those_serialised_from_all_rows(spark):
    f = workspace(spark).files
    changed = F.when(F.col("s") == "myField", F.lit("other")).otherwise(F.col("s"))
    key = ["resource_id", "abc_id"]
    whole = files.serialize(f.rows.withColumn("s", changed))
    got = files.patch(f.blocks, f.rows_of("string").filter("s = 'myField'").withColumn("s", F.lit("other")))
    assert got.count() == 1  # of two
    assert same(whole.join(got.select(*key), key), got)
    # rows within owners are told apart, and new ones are put in beside the others
    assert same(f.blocks.select(*key, "data"), files.patch(f.blocks, f.rows_of("trait", "exception", "body")))


def test_edited_movies_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(movies, "movies", lambda *a, f=movies.movies: made.append(a) or f(*a))
    out = movies.mov_edit(spark, SF)
    assert len(made) == 1 and "packed" not in plan(out) and out.filter("qualified_name = 'changed.Extra'").count() > 0
