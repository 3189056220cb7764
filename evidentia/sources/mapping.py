"""Mappings: which columns of a chunk table are the six canonical fields."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import as_json

IDENTIFIER = re.compile(r"[a-zA-Z0-9_.]+")
FIELDS = ("content", "embedding", "metadata", "documentId", "sourceUrl", "updatedAt")
REQUIRED = ("content", "embedding")
JSON_PREFIX = "meta:"


class MappingError(ValueError):
    pass


def segments(name: str, what: str) -> list[str]:
    """A dotted identifier's parts; anything but letters, digits, _ and dots is refused."""
    if not IDENTIFIER.fullmatch(name):
        raise MappingError(f"unsafe identifier for {what!r}: {name!r}")
    parts = name.split(".")
    if "" in parts:
        raise MappingError(f"empty identifier segment for {what!r}: {name!r}")
    return parts


def quoted(name: str, what: str = "identifier") -> str:
    return ".".join(f"`{p}`" for p in segments(name, what))


def json_path(value: str, what: str) -> tuple[str, str]:
    """meta:<column>.<key>; only the first dot parts them, so a key may hold dots."""
    column, dot, key = value.removeprefix(JSON_PREFIX).partition(".")
    if not column or not dot or not key:
        raise MappingError(f"invalid JSON path for {what!r}: expected meta:<column>.<key>")
    segments(column, what)
    segments(key, what)
    return column, key


@dataclass(frozen=True)
class Mapping:
    """table and columns by canonical field (null: not mapped); joins are carried for recognition only."""

    table: str
    columns: dict[str, str | None]
    joins: dict[str, str] | None = None
    version: int = 1
    dialect: str = "pgvector"

    def __post_init__(self):
        if self.version != 1 or self.dialect != "pgvector":
            raise MappingError("a mapping has version 1 and dialect pgvector")
        if not self.table:
            raise MappingError("a mapping names a table")
        if set(self.columns) != set(FIELDS):
            raise MappingError(f"a mapping has the columns {', '.join(FIELDS)}")
        for name in FIELDS:
            value = self.columns[name]
            if value == "" or (value is None and name in REQUIRED):
                raise MappingError(f"the column of {name!r} is required")
        if self.joins is not None and set(self.joins) != {"collectionTable", "collectionFk", "collectionNameColumn"}:
            raise MappingError("joins name a collection table, its key and its name column")

    @classmethod
    def of(cls, table: str, content: str, embedding: str, metadata: str | None = None, documentId: str | None = None, sourceUrl: str | None = None, updatedAt: str | None = None, joins: dict[str, str] | None = None) -> Mapping:
        return cls(table, {"content": content, "embedding": embedding, "metadata": metadata, "documentId": documentId, "sourceUrl": sourceUrl, "updatedAt": updatedAt}, joins)

    def to_dict(self) -> dict:
        out = {"version": self.version, "dialect": self.dialect, "table": self.table, "columns": dict(self.columns)}
        return out | ({"joins": dict(self.joins)} if self.joins else {})

    @classmethod
    def from_dict(cls, data: dict) -> Mapping:
        if not isinstance(data, dict) or not isinstance(data.get("columns"), dict):
            raise MappingError("a mapping is an object with columns")
        return cls(data.get("table", ""), dict(data["columns"]), data.get("joins"), data.get("version"), data.get("dialect"))


def column_expr(mapping: Mapping, name: str, df: DataFrame) -> Column | None:
    """The only place where mapped names become expressions; null if the field is not mapped."""
    value = mapping.columns[name]
    if value is None:
        return None
    if value.startswith(JSON_PREFIX):
        column, key = json_path(value, name)
        kind = df.select(F.col(quoted(column))).schema[0].dataType
        parsed = F.try_parse_json(as_json(F.col(quoted(column)), kind))
        found = F.try_variant_get(parsed, f'$["{key}"]', "variant")
        # Like text extraction: strings bare, all else as JSON, JSON null as null.
        text = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")).otherwise(F.to_json(found))
        return F.when(F.schema_of_variant(found) != "VOID", text)
    return F.col(quoted(value, name))
