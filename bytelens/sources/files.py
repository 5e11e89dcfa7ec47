"""Reading containers: files to blocks, blocks to the model's tables.  Every step is a map.

`spark.read.format("binaryFile")` lists and reads the files wherever Spark can; a kernel turns each
into its tags and blocks, further kernels turn blocks into table rows.  What can't be read leaves an
error in the `resources` table instead of failing the job.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..codec import block as B
from ..codec import classes as C
from ..codec import container
from ..codec.errors import BytelensError
from ..operators.inheritance import level
from ..operators.model import CLASSES, CODE, FIELDS, LITERAL, METHODS, SITES, Model

PARTS = "resource_id long, path string, kind string, seq int, tag_type int, type_name string, name string, version int, length long, error string, payload binary"
BLOCKS = "resource_id long, abc_id int, path string, name string, data binary"
ROWS = "resource_id long, abc_id int, kind string, idx long, ints array<bigint>, s string, d double, raw binary"
BODIES = "resource_id long, abc_id int, body_index long, method_index long, code_size long, max_stack long, local_count long, exception_count long"
HANDLERS = "resource_id long, abc_id int, body_index long, seq long, from_offset long, to_offset long, target long, exc_type string, var_name string"
NAMES = "resource_id long, abc_id int, idx long, name string, package string, full_name string, kind int, ns_kind int"
SYMBOL_ROWS = "resource_id long, tag_seq int, pos int, char_id int, class_name string"
STRINGS = "resource_id long, abc_id int, idx long, string string"
SUMMARIES = "resource_id long, abc_id int, class_idx int, name string, package string, full_name string, super string, is_interface boolean, trait_count long"
BIGRAMS = "array<struct<rank:int,a:string,b:string,n:bigint>>"
#: Classes of one block keep their order under this many to a block, blocks under as many to a file.
LOAD_STEP = 1 << 20
#: Numbered files beyond so many repeat load orders, which then breaks no tie; hashed ids of streams do so anyway.
FILES = 1 << 22
#: The paths of so many files at most are sent to every task.
FEW_FILES = 200_000
ROWS_AT_ONCE = 4096


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    LITERAL: pa.struct([("kind", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("d", pa.float64()), ("b", pa.bool_())]),
    f"array<{LITERAL}>": pa.list_(pa.struct([("kind", pa.string()), ("s", pa.string()), ("i", pa.int64()), ("d", pa.float64()), ("b", pa.bool_())])),
    BIGRAMS: pa.list_(pa.struct([("rank", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of the types that the tables use; executors have no session to ask."""
    return pa.schema([(name, ARROW[kind]) for name, _, kind in (column.partition(" ") for column in ddl.split(", "))])


def batched(rows: Iterator[dict], ddl: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from dictionaries."""
    shape = arrow_schema(ddl)
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_AT_ONCE:
            yield pa.RecordBatch.from_pylist(held, shape)
            held = []
    yield pa.RecordBatch.from_pylist(held, shape)


def parts_of(resource: int, path: str, data: bytes) -> Iterator[dict]:
    """The file's own row (seq -1, its header as payload), then one row a tag or block."""
    row = {"resource_id": resource, "path": path, "seq": -1, "tag_type": None, "type_name": None, "name": None, "version": None, "length": len(data), "error": None, "payload": None}
    bundle = path.lower().endswith(".swz")
    row["kind"] = "swz" if bundle else "swf"
    try:
        if bundle:
            found = container.read_bundle(data)
            yield row
            yield row | {"seq": 0, "tag_type": container.DO_ABC, "type_name": "DoABC", "name": "", "payload": found}
        else:
            movie = container.read_movie(data)
            yield row | {"version": movie.version, "length": movie.length, "payload": movie.header}
            for k, t in enumerate(movie.tags):
                yield row | {"seq": k, "tag_type": t.kind, "type_name": t.kind_name, "name": t.name, "payload": t.payload}
    except BytelensError as e:
        yield row | {"error": str(e)}


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for row in batch.to_pylist():
                yield from parts_of(row["resource_id"], row["path"], row["content"] or b"")

    yield from batched(rows(), PARTS)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                found = container.block_of(container.Tag(r["tag_type"], r["payload"], r["name"]))
                if found is not None:
                    yield {"resource_id": r["resource_id"], "abc_id": r["seq"], "path": r["path"], "name": r["name"], "data": found}

    yield from batched(rows(), BLOCKS)


def rows_of(make: Callable[[B.Block, int], Iterator[dict]], ddl: str):
    """A kernel from blocks to rows; blocks that can't be parsed have none (see `block_errors`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    key = {"resource_id": r["resource_id"], "abc_id": r["abc_id"]}
                    try:
                        block = B.parse(r["data"])
                    except BytelensError:
                        continue
                    base = (r["resource_id"] % FILES * LOAD_STEP + r["abc_id"]) * LOAD_STEP
                    for row in make(block, base):
                        yield key | row

        yield from batched(rows(), ddl)

    return run


def errors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    B.parse(r["data"])
                except BytelensError as e:
                    yield {"resource_id": r["resource_id"], "abc_id": r["abc_id"], "error": str(e)}

    yield from batched(rows(), "resource_id long, abc_id int, error string")


def symbols_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                for pos, (char, name) in enumerate(container.symbols(r["payload"] or b"")):
                    yield {"resource_id": r["resource_id"], "tag_seq": r["tag_seq"], "pos": pos, "char_id": char, "class_name": name}

    yield from batched(rows(), SYMBOL_ROWS)


def raw_rows(block: B.Block, _: int, kinds: tuple[str, ...] = ()) -> Iterator[dict]:
    for kind, idx, ints, s, d, raw in B.to_rows(block):
        if not kinds or kind in kinds:
            yield {"kind": kind, "idx": idx, "ints": ints, "s": s, "d": d, "raw": raw}


def serialized(pdf_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's rows to its bytes."""
    rows, key = [], None
    for batch in pdf_rows:
        for r in batch.to_pylist():
            key = (r["resource_id"], r["abc_id"])
            rows.append((r["kind"], r["idx"], r["ints"], r["s"], r["d"], r["raw"]))
    out = {"resource_id": key[0], "abc_id": key[1], "data": B.serialize(B.from_rows(rows))}
    yield pa.RecordBatch.from_pylist([out], arrow_schema("resource_id long, abc_id int, data binary"))


def place_of(row: B.Row) -> tuple:
    """What tells the rows of a block apart: kind and index, and the owner of what is numbered within one."""
    kind, idx, ints = row[:3]
    return (kind, idx, *(ints[:1] if kind == "exception" else ints[:2] if kind == "trait" else ()))


def patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to rows, those in `rows` in the place of the old ones, rows to blocks."""
    for batch in batches:
        for r in batch.to_pylist():
            new = [(x["kind"], x["idx"], x["ints"], x["s"], x["d"], x["raw"]) for x in r["rows"]]
            rows = {place_of(row): row for row in B.to_rows(B.parse(r["data"]))} | {place_of(row): row for row in new}
            out = {"resource_id": r["resource_id"], "abc_id": r["abc_id"], "data": B.serialize(B.from_rows(list(rows.values())))}
            yield pa.RecordBatch.from_pylist([out], arrow_schema("resource_id long, abc_id int, data binary"))


def blocks_in(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("tag_type").isin(container.DO_ABC, container.DO_ABC2)).mapInArrow(blocks_of, BLOCKS)


class Files:
    """Containers and the tables read from them; nothing runs before a table is used."""

    def __init__(self, content: DataFrame):
        """`content`: resource_id, path, content."""
        self.spark = content.sparkSession
        self.parts = content.select("resource_id", "path", "content").mapInArrow(unpack, PARTS)
        self.blocks = blocks_in(self.parts)

    @classmethod
    def of_tables(cls, parts: DataFrame, blocks: DataFrame) -> Files:
        """From parts and blocks that were written before."""
        out = cls.__new__(cls)
        out.spark, out.parts, out.blocks = parts.sparkSession, parts, blocks
        return out

    @classmethod
    def at(cls, spark: SparkSession, *paths: str) -> Files:
        """Files, folders or globs; resources are numbered by path, or, if there are very many, have the path's hash."""
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
        paths = found.select("path")
        if paths.count() <= FEW_FILES:  # numbers need the paths alone; the contents aren't moved
            ids = paths.withColumn("resource_id", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))
            return cls(found.select("path", "content").join(F.broadcast(ids), "path"))
        return cls(found.select(F.xxhash64("path").alias("resource_id"), "path", "content"))

    @classmethod
    def of_bytes(cls, spark: SparkSession, *contents: tuple[str, bytes]) -> Files:
        rows = [(i, name, bytearray(data)) for i, (name, data) in enumerate(contents)]
        return cls(spark.createDataFrame(rows, "resource_id long, path string, content binary"))

    @property
    def resources(self) -> DataFrame:
        return self.parts.filter("seq = -1").select("resource_id", "path", "kind", "version", "length", "error", F.col("payload").alias("header"))

    @property
    def tags(self) -> DataFrame:
        tags = self.parts.filter("seq >= 0 and kind = 'swf'")
        return tags.select("resource_id", F.col("seq").alias("tag_seq"), "tag_type", "type_name", "name", F.length("payload").alias("size"), "payload")

    def kept(self) -> Files:
        """The same with the containers' parts written once to the folder of checkpoints, for several tables or when a container is costly to make."""
        parts = level(self.parts)
        return Files.of_tables(parts, blocks_in(parts))

    def table(self, make, ddl: str) -> DataFrame:
        return self.blocks.mapInArrow(rows_of(make, ddl), ddl)

    @property
    def rows(self) -> DataFrame:
        """All blocks as rows (see `codec.block`)."""
        return self.table(raw_rows, ROWS)

    def rows_of(self, *kinds: str) -> DataFrame:
        """The rows of some kinds."""
        return self.table(lambda b, _: raw_rows(b, _, kinds), ROWS)

    @property
    def block_errors(self) -> DataFrame:
        return self.blocks.mapInArrow(errors_of, "resource_id long, abc_id int, error string")

    @property
    def names(self) -> DataFrame:
        return self.table(lambda b, _: C.name_rows(b), NAMES)

    @property
    def bodies(self) -> DataFrame:
        return self.table(lambda b, _: C.body_rows(b), BODIES)

    @property
    def handlers(self) -> DataFrame:
        return self.table(lambda b, _: C.handler_rows(b), HANDLERS)

    @property
    def sites(self) -> DataFrame:
        return self.table(lambda b, _: C.site_rows(b), SITES)

    @property
    def symbols(self) -> DataFrame:
        """Characters and their classes; character 0 is the document's."""
        rows = self.tags.filter(F.col("tag_type") == container.SYMBOLS).select("resource_id", "tag_seq", "payload")
        return rows.mapInArrow(symbols_of, SYMBOL_ROWS).withColumn("is_document", F.col("char_id") == 0)

    def model(self) -> Model:
        return Model(
            self.table(C.class_rows, CLASSES), self.table(C.field_rows, FIELDS), self.table(C.method_rows, METHODS), self.table(lambda b, _: C.code_rows(b), CODE),
            self.table(lambda b, _: C.string_rows(b), STRINGS), self.bodies, {"handlers": self.handlers, "names": self.names}, self.sites,
        )


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what is kept and no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def serialize(rows: DataFrame) -> DataFrame:
    """resource_id, abc_id, data: blocks from their (possibly edited) rows."""
    return rows.groupBy("resource_id", "abc_id").applyInArrow(serialized, "resource_id long, abc_id int, data binary")


def patch(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """resource_id, abc_id, data: the blocks that `rows` (as in `Files.rows`) change, with these in the place of the old ones or beside them.

    As `serialize` of all rows, of which only the changed ones are moved; other blocks stay as they are and aren't given.
    """
    key = ["resource_id", "abc_id"]
    found = rows.groupBy(*key).agg(F.collect_list(F.struct("kind", "idx", "ints", "s", "d", "raw")).alias("rows"))
    return blocks.select(*key, "data").join(found, key).mapInArrow(patched, "resource_id long, abc_id int, data binary")


def rebuild(parts: DataFrame, blocks: DataFrame | None = None, compress: bool = True) -> DataFrame:
    """resource_id, path, data: whole movies from their parts, with blocks put in where given."""
    rows = parts.filter("kind = 'swf' and error is null").select("resource_id", "path", "seq", "tag_type", "name", "payload")
    if blocks is not None:
        new = blocks.select("resource_id", F.col("abc_id").alias("seq"), F.col("data").alias("new"))
        rows = rows.join(new, ["resource_id", "seq"], "left")
    else:
        rows = rows.withColumn("new", F.lit(None).cast("binary"))

    def build(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for batch in group for r in batch.to_pylist()), key=lambda r: r["seq"])
        tags = []
        for r in found[1:]:
            payload = r["payload"]
            if r["new"] is not None:
                old = container.block_of(container.Tag(r["tag_type"], payload, r["name"]))
                payload = payload[: len(payload) - len(old)] + r["new"]
            tags.append(container.Tag(r["tag_type"], payload, r["name"]))
        out = {"resource_id": found[0]["resource_id"], "path": found[0]["path"], "data": container.write_movie(found[0]["payload"], tags, compress)}
        yield pa.RecordBatch.from_pylist([out], arrow_schema("resource_id long, path string, data binary"))

    return rows.groupBy("resource_id").applyInArrow(build, "resource_id long, path string, data binary")
