"""Metadata: JSON objects, kinds of their values, locators, keys that are safe to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import stripped

# Results depend on them.
SHOWN_KEYS = [
    "id", "source", "url", "path", "file", "file_path", "title", "topic", "category", "doc_id", "document_id", "source_id", "source_url",
    "tenant_id", "workspace_id", "org_id", "user_id", "created_at", "updated_at", "last_modified", "lastmod", "language", "lang",
]
SOURCE_KEYS = ["source", "source_url", "url", "path", "file", "file_path", "page_url", "doc_id", "document_id", "source_id"]
STRUCTURED_KEYS = [
    *SOURCE_KEYS, "page", "page_number", "page_label", "sheet", "sheet_name", "row", "row_id", "row_number", "column", "column_id", "column_name",
    "slide", "slide_number", "cell", "range", "section",
]


def as_json(column: Column, kind: T.DataType) -> Column:
    """JSON text of a metadata column: strings hold it already; structs, maps and variants are written."""
    return column if isinstance(kind, T.StringType) else F.to_json(column)


def object_only(json: Column) -> Column:
    """The JSON text if it is an object; arrays, scalars and broken texts are null."""
    parsed = F.try_parse_json(json)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), json)


def keys(json: Column) -> Column:
    return F.json_object_keys(json)


def kind_of(value: Column) -> Column:
    """null, array, string, number, boolean or object."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (schema == "VOID"), "null").when(schema.startswith("ARRAY<"), "array").when(schema.startswith("OBJECT<"), "object")
        .when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
    )


def has_value(json: Column, key: str) -> Column:
    """Whether a key has something in it: no null, no blank text, no empty array or object."""
    value = F.try_variant_get(F.try_parse_json(json), f'$["{key}"]', "variant")
    text = F.to_json(value)
    blank = (F.schema_of_variant(value) == "STRING") & (stripped(F.try_variant_get(value, "$", "string")) == "")
    return F.coalesce(text.isNotNull() & ~text.isin("null", "[]", "{}") & ~blank, F.lit(False))


def has_locator(json: Column, present: Column, names: list[str]) -> Column:
    """Whether any of the names has a value; values are looked at only where the key is present."""
    out = F.lit(False)
    for name in names:
        out = out | F.when(F.coalesce(F.array_contains(present, name), F.lit(False)), has_value(json, name)).otherwise(False)
    return out


def safe_key(key: Column) -> Column:
    return F.when(key.isin(SHOWN_KEYS), key).otherwise(F.concat(F.lit("sha256:"), F.sha2(key, 256)))
