"""Constant pools as text lines, and sinks for single files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec.block import Block
from ..codec.names import full, resolve
from .files import Files, rebuild, rows_of

POOLS = ("multinames", "strings", "namespaces", "namespace-sets", "ints", "uints", "doubles")
LINES = "resource_id long, abc_id int, pool string, idx long, key string, line string"


def pool_lines(b: Block, _: int) -> Iterator[dict]:
    """One row an entry; `key` is what a search looks at: the name of a multiname, else the line."""
    space = lambda i: b.namespaces[i] if 0 <= i < len(b.namespaces) else (0, 0)
    text = lambda i: b.strings[i] if 0 < i < len(b.strings) else ""
    shown = {
        "multinames": [f"0x{m.kind:02X} {'.'.join(x for x in full(b, i) if x)}" for i, m in enumerate(b.multinames)],
        "strings": [repr(s) for s in b.strings], "namespaces": [f"0x{k:02X} {text(n)!r}" for k, n in b.namespaces],
        "namespace-sets": [", ".join(f"{x}:{text(space(x)[1])!r}" for x in s) for s in b.ns_sets],
        "ints": [str(x) for x in b.ints], "uints": [str(x) for x in b.uints], "doubles": [repr(x) for x in b.doubles],
    }
    for pool, lines in shown.items():
        for i, line in enumerate(lines):
            if i:
                yield {"pool": pool, "idx": i, "key": resolve(b, i) if pool == "multinames" else f"[{i}] {line}", "line": f"[{i}] {line}"}


def pools(files: Files) -> DataFrame:
    return files.blocks.mapInArrow(rows_of(pool_lines, LINES), LINES)


def search(lines: DataFrame, pool: str, text: str | None = None, block: int = 0) -> DataFrame:
    """The lines of a pool of the n-th block of the first resource, in order."""
    order = lines.select("resource_id", "abc_id").distinct().orderBy("resource_id", "abc_id").offset(block).limit(1)
    rows = lines.join(order, ["resource_id", "abc_id"]).filter(F.col("pool") == pool)
    if text:
        rows = rows.filter(F.lower("key").contains(text.lower()))
    return rows.orderBy("idx").select("line")


def extract(files: Files, outdir: str) -> list[str]:
    """Write the blocks of the first resource as abc_0.abc, abc_1.abc, ..."""
    os.makedirs(outdir, exist_ok=True)
    out = []
    first = files.blocks.agg(F.min("resource_id")).first()[0]
    for i, row in enumerate(files.blocks.filter(F.col("resource_id") == first).orderBy("abc_id").select("data").toLocalIterator()):
        path = os.path.join(outdir, f"abc_{i}.abc")
        with open(path, "wb") as f:
            f.write(row.data)
        out.append(path)
    return out


def write_movie(files: Files, output: str, compress: bool = True) -> int:
    """Rebuild the first movie into a file; the number of bytes."""
    data = bytes(rebuild(files.parts, compress=compress).orderBy("resource_id").first().data)
    with open(output, "wb") as f:
        f.write(data)
    return len(data)
