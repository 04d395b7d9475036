"""A catalog of universes, tables, columns and types, and documents put into and read from their tables.

The catalog is itself four versioned stores; a document table is a store whose key is `document_uri`. Putting a document again changes only
the cells that it brings.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.uri import TYPES
from millrace.operators.merge import DELETED
from millrace.sources.log import LogError
from millrace.sources.store import Group, Store

KINDS = ("universe", "table", "column", "type", "dataset")


def _escaped(uri: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "__" for c in uri)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        schema = T.StructType.fromDDL("uri string, universe string, parent string, type string, definition string")
        self.stores = {}
        for k in KINDS:
            try:
                self.stores[k] = Store.open(spark, f"{self.root}/catalog/{k}")
            except LogError:
                self.stores[k] = Store.create(spark, f"{self.root}/catalog/{k}", schema, [Group("all", ("uri",), ("universe", "parent", "type", "definition"))])

    def list(self, kind: str) -> DataFrame:
        try:
            return self.stores[kind].read()
        except LogError:
            return self.spark.createDataFrame([], self.stores[kind].schema)

    def _one(self, kind: str, uri: str) -> DataFrame:
        return self.list(kind).filter(F.col("uri") == uri)

    def create(self, kind: str, uri: str, universe: str = "", parent: str = "", type: str = "", definition: str = "") -> None:
        self.create_all(kind, [(uri, universe, parent, type, definition)])

    def create_all(self, kind: str, items: list[tuple[str, str, str, str, str]]) -> None:
        """Items (uri, universe, parent, type, definition) in one commit; one that is there already, or a column of an unknown type, fails them all."""
        if not items:
            return
        there = [r["uri"] for r in self.list(kind).filter(F.col("uri").isin([i[0] for i in items])).select("uri").collect()]
        if there:
            raise ValueError(f"{kind} {there[0]} exists")
        if kind == "column" and (asked := {i[3] for i in items} - set(TYPES)):
            own = {r["uri"] for r in self.list("type").filter(F.col("uri").isin(list(asked))).select("uri").collect()}
            if asked - own:
                raise ValueError(f"unknown type {sorted(asked - own)[0]}")
        rows = self.spark.createDataFrame(items, self.stores[kind].schema)
        self.stores[kind].append(rows, message=f"create {kind} {items[0][0]}" + (f" and {len(items) - 1} more" if len(items) > 1 else ""))

    # Datasets: a name, where it lies, its version and format, and what is told about it

    def register_dataset(self, name: str, location: str, version: str = "1", format: str = "parquet", about: dict | None = None) -> None:
        self.create("dataset", f"{name}@{version}", location, name, format, json.dumps(about or {}, sort_keys=True))

    def datasets(self) -> DataFrame:
        """name, version, location, format, about (JSON)."""
        rows = self.list("dataset")
        return rows.select(F.col("parent").alias("name"), F.substring_index("uri", "@", -1).alias("version"), F.col("universe").alias("location"), F.col("type").alias("format"), F.col("definition").alias("about"))

    def dataset(self, name: str, version: str | None = None) -> DataFrame:
        """The rows of a registered dataset; without a version, of the one that sorts last."""
        found = self.datasets().filter(F.col("name") == name)
        found = found.filter(F.col("version") == version) if version is not None else found
        row = found.orderBy(F.desc("version")).first()
        if row is None:
            raise ValueError(f"no dataset {name}" + (f"@{version}" if version else ""))
        return self.spark.read.format(row["format"]).load(row["location"])

    def delete(self, kind: str, uri: str) -> None:
        if self._one(kind, uri).isEmpty():
            raise ValueError(f"no {kind} {uri}")
        self.stores[kind].append(self.spark.createDataFrame([(uri, True)], f"uri string, {DELETED} boolean"), message=f"delete {kind} {uri}")

    def deploy_file(self, path: str) -> None:
        """deploy() of a JSON file: a list of items, or one item a line."""
        text = self.stores["table"].files.read(path).decode()
        self.deploy(json.loads(text) if text.lstrip().startswith("[") else [json.loads(line) for line in text.splitlines() if line.strip()])

    def deploy(self, specs: list[dict]) -> None:
        """Creates or deletes in order: {"do": "create", "kind": "column", "uri": ..., ...}."""
        for s in specs:
            fields = {k: v for k, v in s.items() if k not in ("do", "kind")}
            if s.get("do", "create") == "delete":
                self.delete(s["kind"], fields["uri"])
            elif s["kind"] == "table":
                self.create_table(fields["uri"], fields.get("universe", ""), fields["columns"])
            else:
                self.create(s["kind"], **fields)

    # Document tables

    def _path(self, uri: str, universe: str) -> str:
        return f"{self.root}/universe_{_escaped(universe)}/{_escaped(uri)}"

    def _sql_type(self, type_uri: str) -> str:
        if type_uri in TYPES:
            return TYPES[type_uri]
        own = self._one("type", type_uri).first()
        if own is None:
            raise ValueError(f"unknown type {type_uri}")
        return own["definition"]

    def create_table(self, uri: str, universe: str, columns: dict[str, str]) -> Store:
        """columns: URI to type URI; a table's columns are stored under their escaped URIs."""
        fields = [T.StructField("document_uri", T.StringType())] + [T.StructField(_escaped(c), T._parse_datatype_string(self._sql_type(t))) for c, t in columns.items()]
        store = Store.create(self.spark, self._path(uri, universe), T.StructType(fields), [Group("cells", ("document_uri",), tuple(f.name for f in fields[1:]))])
        self.create("table", uri, universe)
        there = {r["uri"] for r in self.list("column").filter(F.col("uri").isin(list(columns))).select("uri").collect()}
        self.create_all("column", [(c, universe, uri, t, "") for c, t in columns.items() if c not in there])
        return store

    def table(self, uri: str, universe: str) -> Store:
        return Store.open(self.spark, self._path(uri, universe))

    def drop_table(self, uri: str, universe: str, even_if_filled: bool = False) -> None:
        store = self.table(uri, universe)
        try:
            filled = not store.read(columns=["document_uri"]).limit(1).isEmpty()
        except LogError:
            filled = False
        if filled and not even_if_filled:
            raise ValueError(f"{uri} holds documents")
        store.files.delete(store.root)
        self.delete("table", uri)

    def put(self, uri: str, universe: str, documents: DataFrame) -> None:
        """documents: document_uri and any columns, by URI or escaped name."""
        self.table(uri, universe).append(documents.withColumnsRenamed({c: _escaped(c) for c in documents.columns}))

    def get(self, uri: str, universe: str, ids: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
        names = None if columns is None else ["document_uri", *(_escaped(c) for c in columns)]
        rows = self.table(uri, universe).read(columns=names)
        return rows if ids is None else rows.join(ids.select("document_uri"), "document_uri", "left_semi")
