"""Command line: python -m bytelens.cli COMMAND FILE ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import calls, fields, inheritance, strings, structure
from .session import Workspace
from .sources import pools

COLOR = sys.stdout.isatty() and not os.environ.get("NO_COLOR")


def title(text: str) -> None:
    print(f"\033[1m{text}\033[0m" if COLOR else text)


def show(df: DataFrame, form: str = "{0}") -> int:
    """Print the rows as they arrive; their number."""
    n = 0
    for row in df.toLocalIterator():
        print(form.format(*row, **row.asDict()))
        n += 1
    return n


def info(ws: Workspace, a) -> None:
    for r in ws.resources.orderBy("resource_id").collect():
        title(r.path)
        print(f"  {r.error}" if r.error else f"  {r.kind} version {r.version}, {r.length} bytes")
    m = ws.model
    counts = {"tags": ws.tags, "blocks": ws.files.blocks, "classes": m.classes, "methods": ws.files.rows.filter("kind = 'method'"), "strings": m.pool_strings, "packages": m.classes.select("package").distinct()}
    for name, df in counts.items():
        print(f"  {name}: {df.count()}")


def tags(ws: Workspace, a) -> None:
    show(ws.tags.orderBy("resource_id", "tag_seq").select("tag_seq", "tag_type", "type_name", "size", F.coalesce("name", F.lit("")).alias("name")), "[{0:3}] {1:3} {2:20} {3:8} {4}")
    show(ws.files.symbols.orderBy("resource_id", "tag_seq", "pos").limit(5).select("char_id", "class_name"), "      symbol {0} = {1}")


def classes(ws: Workspace, a) -> None:
    rows = structure.search_classes(ws.model, a.search) if a.search else ws.classes
    if a.package is not None:
        rows = rows.filter(F.col("package") == a.package)
    if a.extends:
        rows = rows.filter(F.col("super_name") == a.extends)
    if a.interfaces_only:
        rows = rows.filter("is_interface")
    form = "{qualified_name} extends {super_qualified} {interfaces}" if a.verbose else "{qualified_name}"
    print(f"{show(rows.orderBy('load_seq'), form)} classes")


def one_class(ws: Workspace, name: str):
    """The class of an exact name, else the only one whose name contains it."""
    row = structure.get_class(ws.model, name).first()
    if row:
        return row
    some = structure.search_classes(ws.model, name).orderBy("qualified_name").limit(20).collect()
    if len(some) == 1:
        return some[0]
    sys.exit(f"ambiguous: {', '.join(r.qualified_name for r in some)}" if some else f"no class {name}")


def class_(ws: Workspace, a) -> None:
    c = one_class(ws, a.name)
    title(f"{'interface' if c.is_interface else 'class'} {c.qualified_name} extends {c.super_qualified}")
    for i in c.interfaces:
        print(f"  implements {i}")
    mine = F.col("class_name") == c.qualified_name
    show(ws.model.fields.filter(mine).orderBy("is_static", "trait_index"), "  {name}:{type_name}")
    rows = ws.model.methods.filter(mine).orderBy("is_static", "trait_index").withColumn("params", C.joined(F.col("param_types"), ", "))
    show(rows, "  {name}({params}):{return_type}")


def string(ws: Workspace, a) -> None:
    if a.classify:
        used = strings.used(ws.model)
        for name, kind in (("URLs", strings.urls), ("debug markers", strings.debug_markers), ("texts", strings.ui_texts)):
            title(name)
            show(kind(used).orderBy("string"), "  {0}")
        return
    rows = strings.search(ws.model, a.search, a.regex) if a.search else strings.used(ws.model)
    if a.verbose:
        rows = strings.usages(ws.model).join(rows, "string").select("string", "class_name", "method_name").distinct().orderBy("string", "class_name", "method_name")
        show(rows, "{0!r} {1}.{2}")
    else:
        show(rows.orderBy("string"), "{0!r}")


def refs(ws: Workspace, a) -> None:
    print(f"{show(ws.references_to(a.name), '{ref_kind:14} {source_class}.{source_member}')} references")


def field(ws: Workspace, a) -> None:
    c = one_class(ws, a.name)
    acc = ws.accesses.filter(F.col("class_name") == c.qualified_name)
    if a.field:
        show(ws.field_summary(c.qualified_name).filter(F.col("field_name") == a.field), "readers {readers}\nwriters {writers}")
    elif a.method:
        show(fields.by_method(acc).filter(F.col("method_name") == a.method), "reads {read}\nwrites {written}")
    elif a.constructor:
        show(fields.constructor_assignments(acc), "{fields}")
    else:
        show(fields.summary(acc).orderBy("field_name"), "{field_name}: readers {readers}, writers {writers}")


def callers(ws: Workspace, a) -> None:
    print(f"{show(ws.callers(a.name), '{edge_type:10} {caller} at {offset}')} edges")


def callees(ws: Workspace, a) -> None:
    print(f"{show(calls.callees(ws.edges, a.name), '{edge_type:10} {target} at {offset}')} edges")


def tree(ws: Workspace, a) -> None:
    c = one_class(ws, a.name)
    title(c.qualified_name)
    if a.ancestors:
        show(ws.ancestors(c.qualified_name), "  {ancestor}")
    else:
        show(inheritance.tree_lines(ws.model, c.qualified_name).select("line"))


def packages(ws: Workspace, a) -> None:
    show(ws.packages().orderBy("package").select("package", "class_count"), "{0:40} {1}")


def pool(ws: Workspace, a) -> None:
    show(pools.search(pools.pools(ws.files), a.kind, a.search, a.abc_index))


def disasm(ws: Workspace, a) -> None:
    from .kernels.disassembly import listing

    rows = listing(ws.files.blocks)
    if a.class_name:
        rows = rows.filter(F.col("class_name") == one_class(ws, a.class_name).qualified_name)
    if a.method_index is not None:
        rows = rows.filter(F.col("method_index") == a.method_index)
    text = F.col("mnemonic") if a.raw else F.col("text")
    rows = rows.orderBy("resource_id", "abc_id", "body_index", "seq").select(C.offset_text(F.col("offset")).alias("at"), text.alias("text"), "class_name", "member_name")
    show(rows, "{0}  {1}")


def extract(ws: Workspace, a) -> None:
    for path in pools.extract(ws.files, a.output or "."):
        print(path)


def build(ws: Workspace, a) -> None:
    if not a.output:
        sys.exit("build needs --output: the input is never overwritten")
    print(f"{pools.write_movie(ws.files, a.output, not a.decompress)} bytes to {a.output}")


def decompile(ws: Workspace, a) -> None:
    from .kernels import decompile as D

    blocks = D.first_blocks(ws.files.blocks)
    if a.all:
        print(f"{D.write_tree(blocks, a.outdir).count()} classes to {a.outdir}")
    elif a.class_name and a.method_name:
        name = one_class(ws, a.class_name).qualified_name
        show(D.methods(blocks).filter((F.col("class_name") == name) & (F.col("method_name") == a.method_name)).select("source"))
    elif a.class_name:
        c = one_class(ws, a.class_name)
        show(D.classes(blocks).filter((F.col("name") == c.name) & (F.col("package") == c.package)).select("source"))
    else:
        show(D.classes(blocks).orderBy("package", "name").select(C.qualified(F.col("package"), F.col("name")).alias("q")))


COMMANDS = {
    "info": (info, []),
    "tags": (tags, []),
    "classes": (classes, [("-s", "--search"), ("-p", "--package"), ("-e", "--extends"), ("-i", "--interfaces-only", True), ("-v", "--verbose", True)]),
    "class": (class_, ["name"]),
    "strings": (string, [("-s", "--search"), ("-r", "--regex", True), ("-c", "--classify", True), ("-v", "--verbose", True)]),
    "refs": (refs, ["name"]),
    "fields": (field, ["name", ("-f", "--field"), ("-m", "--method"), ("-c", "--constructor", True)]),
    "callers": (callers, ["name"]),
    "callees": (callees, ["name"]),
    "tree": (tree, ["name", ("-a", "--ancestors", True)]),
    "packages": (packages, []),
    "pool": (pool, ["kind", ("-s", "--search")]),
    "disasm": (disasm, [("--class",), ("--raw", "--raw", True)]),
    "extract": (extract, [("-o", "--output")]),
    "build": (build, [("-o", "--output"), ("-d", "--decompress", True)]),
    "decompile": (decompile, [("--list", "--list", True), ("--class",), ("--method",), ("--all", "--all", True)]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelens", description="Query compiled bytecode archives.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        c = sub.add_parser(name)
        c.add_argument("file")
        for o in options:
            if isinstance(o, str):
                c.add_argument(o, **({"choices": pools.POOLS} if o == "kind" else {}))
            elif len(o) == 1:
                c.add_argument(o[0], dest=f"{o[0].strip('-')}_name")
            elif len(o) == 3:
                c.add_argument(*dict.fromkeys(o[:2]), action="store_true")
            else:
                c.add_argument(*o)
        if name == "pool":
            c.add_argument("--abc-index", type=int, default=0)
        if name == "disasm":
            c.add_argument("--method-index", type=int)
        if name == "decompile":
            c.add_argument("--outdir", default="decompiled")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("bytelens").getOrCreate()
    ws = Workspace.load(spark, a.file, cache=True)
    COMMANDS[a.command][0](ws, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
