"""Names of universes, tables and columns, namespaces, key-value texts and typed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Column types by type URI; any other is an error.
TYPES = {"/std/text": "string", "/std/int64": "bigint", "/std/int32": "int", "/std/int": "int", "/std/double": "double"}
NAMESPACES = {"std": "/std/"}


def escape_uri(uri: Column) -> Column:
    """Letters, digits and underscores stay, any other sign becomes two underscores."""
    return F.regexp_replace(uri, "[^\\p{L}\\p{N}_]", "__")


def keyspace(universe: Column) -> Column:
    return F.concat(F.lit("universe_"), escape_uri(universe))


def table_name(uri: Column) -> Column:
    return escape_uri(uri)


def update_schema(columns: Column) -> Column:
    """(document_uri, a, b) for an array of column URIs."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.lit("document_uri"), F.transform(columns, escape_uri)), F.lit(")"))


def literal_text(text: Column) -> Column:
    """A quoted literal, quotes inside doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def column_type(uri: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    return F.when(F.map_contains_key(known, uri), F.get(F.array(known[uri]), 0)).otherwise(F.raise_error(F.concat(F.lit("unknown type "), uri)))


def resolve(name: Column, spaces: dict[str, str] | None = None) -> Column:
    """ns:key to the namespace's prefix, one slash and the key; names without a colon stay; unknown namespaces are an error."""
    spaces = NAMESPACES if spaces is None else spaces
    ns, key = F.substring_index(name, ":", 1), F.regexp_replace(name, "^[^:]*:", "")
    out = F.raise_error(F.concat(F.lit("unknown namespace "), ns)).cast("string")
    for k, prefix in spaces.items():
        out = F.when(ns == k, F.concat(F.lit(prefix if prefix.endswith("/") else prefix + "/"), key)).otherwise(out)
    return F.when(F.contains(name, F.lit(":")), out).otherwise(name)


def resolve_all(names: Column, spaces: dict[str, str] | None = None) -> Column:
    return F.transform(names, lambda n: resolve(n, spaces))


def resolve_map(names: Column, spaces: dict[str, str] | None = None, keys: bool = True, values: bool = False) -> Column:
    out = F.transform_keys(names, lambda k, v: resolve(k, spaces)) if keys else names
    return F.transform_values(out, lambda k, v: resolve(v, spaces)) if values else out


def key_values(text: Column) -> Column:
    """a=b,c=d as a map; each item is cut at its first sign of equality, an item without one is an error."""
    items = F.split(text, ",")
    checked = F.transform(items, lambda i: F.when(F.contains(i, F.lit("=")), F.struct(F.substring_index(i, "=", 1).alias("key"), F.regexp_replace(i, "^[^=]*=", "").alias("value"))).otherwise(F.raise_error(F.concat(F.lit("no = in "), i))))
    return F.map_from_entries(checked)


def cell(json: Column) -> Column:
    """A JSON scalar as a struct of one filled field: as_string, as_int, as_double or as_bool; arrays, objects and null give null."""
    v = F.parse_json(json)
    kind = F.schema_of_variant(v)
    return F.when(
        kind.isin("STRING", "BIGINT", "BOOLEAN", "DOUBLE") | kind.startswith("DECIMAL"),
        F.struct(
            F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("as_string"),
            F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).alias("as_int"),
            F.when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double")).alias("as_double"),
            F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).alias("as_bool"),
        ),
    )
