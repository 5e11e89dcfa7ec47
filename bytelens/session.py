"""A workspace: containers in, tables and answers out, all as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec.classes import summary_rows
from .functions import columns as C
from .operators import calls, classgraph, fields, flow, inheritance, references, strings, structure
from .operators.model import BODY, Model
from .sources.files import SUMMARIES, Files


TABLES = ("classes", "fields", "methods", "code", "pool_strings")


class Workspace:
    """Loaded containers and every operator over them.

    Nothing is kept by default: every answer plans its own scan.  `cache` keeps the tables of a few
    files in memory; `save` writes the tables of many as Parquet once, and `open` works on those, so
    that filters and column choices reach the scans.  `add` gives a new workspace with more files.
    """

    def __init__(self, files: Files, cache: bool = False, model: Model | None = None):
        self.files, self.spark = files, files.spark
        if cache:
            files.parts, files.blocks = files.parts.persist(), files.blocks.persist()
        self.model: Model = files.model() if model is None else model
        if cache:
            for name in TABLES:
                setattr(self.model, name, getattr(self.model, name).persist())

    @classmethod
    def load(cls, spark: SparkSession, *paths: str, cache: bool = False) -> Workspace:
        """Files, folders or globs; .swz files are bundles, all others movies."""
        return cls(Files.at(spark, *paths), cache)

    @classmethod
    def of_bytes(cls, spark: SparkSession, *contents: tuple[str, bytes]) -> Workspace:
        return cls(Files.of_bytes(spark, *contents), cache=True)

    def save(self, path: str) -> None:
        """Write the containers' parts and blocks, and all tables, each in a folder of its own."""
        for name, df in {"parts": self.files.parts, "blocks": self.files.blocks, "bodies": self.files.bodies, "handlers": self.files.handlers, "names": self.files.names}.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        for name in TABLES:
            getattr(self.model, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Workspace:
        """A saved workspace."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        files = Files.of_tables(read("parts"), read("blocks"))
        return cls(files, model=Model(*(read(name) for name in TABLES), read("bodies"), {name: read(name) for name in ("handlers", "names")}, files.sites))

    # what was loaded

    @property
    def resources(self) -> DataFrame:
        return self.files.resources

    @property
    def tags(self) -> DataFrame:
        return self.files.tags

    @property
    def classes(self) -> DataFrame:
        return self.model.classes

    def get_class(self, name: str) -> DataFrame:
        return structure.get_class(self.model, name)

    def find_classes(self, **conditions) -> DataFrame:
        return structure.find_classes(self.model, **conditions)

    def find_fields(self, **conditions) -> DataFrame:
        return structure.find_fields(self.model, **conditions)

    def find_methods(self, **conditions) -> DataFrame:
        return structure.find_methods(self.model, **conditions)

    def packages(self) -> DataFrame:
        return classgraph.packages(self.model)

    def class_summaries(self) -> DataFrame:
        """One row a class: its place, names, superclass and number of traits."""
        return self.files.table(summary_rows, SUMMARIES)

    # indexes

    @cached_property
    def references(self) -> DataFrame:
        return references.references(self.model).persist()

    @cached_property
    def accesses(self) -> DataFrame:
        return fields.accesses(self.model).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return calls.edges(self.model).persist()

    def search_strings(self, pattern: str, regex: bool = False) -> DataFrame:
        return strings.search(self.model, pattern, regex)

    def search_pool(self, pattern: str, regex: bool = False) -> DataFrame:
        return strings.search_pool(self.model, pattern, regex)

    def string_usages(self) -> DataFrame:
        return strings.usages(self.model)

    def _class_key(self, name: str) -> str:
        """The qualified name of the loaded class that `name` stands for."""
        hit = self.model.classes.select(F.col("qualified_name").alias("key")).filter((F.col("key") == name) | F.col("key").endswith("." + name)).distinct()
        first = hit.orderBy((F.col("key") != name).cast("int"), "key").first()
        return first.key if first else name

    def strings_in_class(self, name: str) -> DataFrame:
        rows = strings.in_class(self.model)
        return rows.filter(F.col("class_name") == self._class_key(name)).select("string")

    def classes_using_string(self, text: str) -> DataFrame:
        return strings.classes_using(self.model).filter(F.col("string") == text).select("class_name")

    def references_to(self, target: str) -> DataFrame:
        return references.to_target(self.references, target)

    def references_from(self, name: str) -> DataFrame:
        return references.from_class(self.references, name)

    def type_users(self, name: str) -> DataFrame:
        return references.type_users(self.references, name)

    def instantiators(self, name: str) -> DataFrame:
        return references.instantiators(self.references, name)

    def field_writers(self, class_name: str, field: str) -> DataFrame:
        key = self._class_key(class_name)
        return fields.writers(self.accesses.filter((F.col("class_name") == key) & (F.col("field_name") == field)))

    def field_readers(self, class_name: str, field: str) -> DataFrame:
        key = self._class_key(class_name)
        return fields.readers(self.accesses.filter((F.col("class_name") == key) & (F.col("field_name") == field)))

    def fields_read_by(self, class_name: str, method: str) -> DataFrame:
        """field_name of the fields that a method reads."""
        return self._touched(class_name, method, "read")

    def fields_written_by(self, class_name: str, method: str) -> DataFrame:
        return self._touched(class_name, method, "written")

    def _touched(self, class_name: str, method: str, how: str) -> DataFrame:
        rows = fields.by_method(self.accesses.filter(F.col("class_name") == self._class_key(class_name)))
        return rows.filter(F.col("method_name") == method).select(F.explode(how).alias("field_name"))

    def constructor_reads(self, class_name: str) -> DataFrame:
        return fields.constructor_reads(self.accesses.filter(F.col("class_name") == self._class_key(class_name)))

    def field_access_count(self, class_name: str, field: str) -> int:
        return self.accesses.filter((F.col("class_name") == self._class_key(class_name)) & (F.col("field_name") == field)).count()

    def field_summary(self, class_name: str) -> DataFrame:
        key = self._class_key(class_name)
        return fields.summary(self.accesses.filter(F.col("class_name") == key))

    def constructor_assignments(self, class_name: str) -> DataFrame:
        key = self._class_key(class_name)
        return fields.constructor_assignments(self.accesses.filter(F.col("class_name") == key))

    def callers(self, target: str) -> DataFrame:
        return calls.callers(self.edges, target)

    def callees(self, caller: str) -> DataFrame:
        return calls.callees(self.edges, caller)

    @cached_property
    def const_args(self) -> DataFrame:
        return calls.const_args(self.model).persist()

    def distinct_arg_values(self, target: str, slot: int) -> DataFrame:
        return calls.distinct_values(self.const_args.filter(F.col("target") == target)).filter(F.col("slot") == slot).select("value")

    # hierarchy

    def ancestors(self, name: str) -> DataFrame:
        return inheritance.ancestors(self.model).join(inheritance.resolve(self.model, name), F.col("name") == F.col("key")).select("ancestor", "depth").orderBy("depth")

    def descendants(self, name: str) -> DataFrame:
        key = inheritance.resolve(self.model, name).first()
        return inheritance.descendants_in_order(self.model, key.key if key else name)

    def implementors(self, interface: str) -> DataFrame:
        rows = inheritance.implementors(self.model).filter((F.col("interface") == interface) | F.col("interface").endswith("." + interface))
        return rows.orderBy((F.col("interface") != interface).cast("int"), "interface").limit(1)

    def get_superclass(self, name: str) -> DataFrame:
        """parent of the class that `name` stands for."""
        return inheritance.parents(self.model).join(inheritance.resolve(self.model, name), F.col("name") == F.col("key")).select("parent")

    def get_subclasses(self, name: str) -> DataFrame:
        """name of the direct subclasses, in order."""
        return inheritance.child_edges(self.model).join(inheritance.resolve(self.model, name), F.col("parent") == F.col("key")).select("name").orderBy("name")

    def lookup(self, name: str):
        """The class row that `name` stands for; a name of several classes raises a ValueError that lists some of them."""
        found = structure.lookup(self.model, name).orderBy("qualified_name").limit(20).collect()
        if len(found) > 1:
            raise ValueError(f"ambiguous: {', '.join(r.qualified_name for r in found)}")
        if not found:
            raise KeyError(name)
        return found[0]

    def summary(self) -> dict[str, int]:
        """Counts of what is loaded."""
        m = self.model
        kinds = m.classes.agg(F.count("*").alias("classes"), F.count_if("is_interface").alias("interfaces"), F.count_distinct("package").alias("packages")).first()
        return kinds.asDict() | {"resources": self.resources.count(), "fields": m.fields.count(), "methods": m.methods.count(), "strings": m.pool_strings.count()}

    def dead_code(self) -> DataFrame:
        return classgraph.dead_code(self.model, self.references, self.edges)

    def observations_for(self, target: str) -> DataFrame:
        return calls.observations_for(self.const_args, target)

    def roots(self) -> DataFrame:
        return inheritance.roots(self.model)

    def class_edges(self) -> DataFrame:
        return classgraph.edges(self.model, self.references)

    def dead_classes(self) -> DataFrame:
        return classgraph.dead_classes(self.model, self.references)

    def dead_methods(self) -> DataFrame:
        return classgraph.dead_methods(self.model, self.edges)

    def entrypoints(self) -> DataFrame:
        return classgraph.entrypoints(self.model)

    # flow

    @cached_property
    def flow(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return flow.blocks(self.model.code, self.files.handlers)

    def complexity(self) -> DataFrame:
        found, edges, _ = self.flow
        return flow.complexity(found, edges)

    def liveness(self) -> DataFrame:
        return flow.liveness(flow.register_accesses(self.model.code))

    def fingerprints(self) -> DataFrame:
        """Of all methods and constructors; constructors come first and are named <constructor>."""
        from .kernels.fingerprint import fingerprints

        return fingerprints(self.files.blocks)

    def disassemble(self, class_name: str, method: str) -> DataFrame:
        """offset, mnemonic, text of a method (also <init> and <cinit>), operands resolved."""
        from .kernels.disassembly import listing

        rows = listing(self.files.blocks)
        mine = rows.filter((F.col("member_name") == method) & ((F.col("class_name") == class_name) | F.col("class_name").endswith("." + class_name)))
        return mine.select(C.offset_text(F.col("offset")).alias("at"), "mnemonic", "text", "seq", *BODY).orderBy("resource_id", "abc_id", "body_index", "seq")

    def decompile(self) -> DataFrame:
        """resource_id, abc_id, package, name, source of every class."""
        from .kernels.decompile import classes

        return classes(self.files.blocks)

    @cached_property
    def _sources(self) -> dict[tuple, str]:
        return {}

    def decompile_class(self, name: str) -> str:
        """The source of one class; kept for later requests."""
        return self._source(name, None)

    def decompile_method(self, class_name: str, method: str) -> str:
        """The source of one method; kept for later requests."""
        return self._source(class_name, method)

    def decompile_scripts(self) -> DataFrame:
        from .kernels.decompile import scripts

        return scripts(self.files.blocks)

    def _source(self, name: str, method: str | None) -> str:
        from .kernels import decompile as D

        if (name, method) not in self._sources:
            c = self.lookup(name)
            own = self.files.blocks.filter((F.col("resource_id") == c.resource_id) & (F.col("abc_id") == c.abc_id))
            if method is None:
                row = D.classes(own).filter((F.col("name") == c["name"]) & (F.col("package") == c.package)).select("source").first()
            else:
                row = D.methods(own).filter((F.col("class_name") == c.qualified_name) & (F.col("method_name") == method)).select("source").first()
            if row is None:
                raise KeyError((name, method))
            self._sources[name, method] = row.source
        return self._sources[name, method]

    def add(self, *paths: str) -> Workspace:
        """A workspace with more files; resources are numbered anew by path."""
        known = [r.path for r in self.files.resources.select("path").collect()]
        return Workspace.load(self.spark, *known, *paths)

    def view_all(self, prefix: str = "") -> None:
        """Publish the tables as SQL views."""
        self.model.views(prefix)


