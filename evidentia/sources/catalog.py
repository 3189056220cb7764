"""Tables and their columns: where a chunk table may be, and small looks into it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import quoted

# Results depend on them.
MARKED_TIMES = {"deleted_at", "archived_at", "removed_at", "disabled_at"}
MARKED_FLAGS = {"deleted", "is_deleted", "archived", "is_archived"}
KEY_ROWS, LENGTH_ROWS, SHOWN_ROWS = 20, 200, 3
TIMES = ("timestamptz", "timestamp", "date")


def kind_of(field: T.StructField) -> str:
    """A field's kind: text, jsonb, vector, timestamptz, timestamp, date, bool or Spark's own name. A string field
    whose metadata says {"json": true} holds JSON."""
    t = field.dataType
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "jsonb" if field.metadata.get("json") else "text"
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return "vector"
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return "jsonb"
    names = {T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp", T.DateType: "date", T.BooleanType: "bool"}
    return names.get(type(t), t.simpleString())


def vector_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if kind_of(f) == "vector"]


def soft_delete_columns(df: DataFrame) -> list[str]:
    """Columns that mark rows as deleted: filled times and true flags of known names."""
    return [f.name for f in df.schema if (f.name.lower() in MARKED_TIMES and kind_of(f) in TIMES) or (f.name.lower() in MARKED_FLAGS and kind_of(f) == "bool")]


def soft_delete_counts(df: DataFrame) -> tuple[int, int]:
    """Marked rows and all rows."""
    flags = {f.name for f in df.schema if kind_of(f) == "bool"}
    marked = [F.coalesce(F.col(quoted(n)), F.lit(False)) if n in flags else F.col(quoted(n)).isNotNull() for n in soft_delete_columns(df)]
    row = df.agg(F.count_if(reduce(lambda a, b: a | b, marked, F.lit(False))).alias("marked"), F.count("*").alias("n")).first()
    return row["marked"], row["n"]


@dataclass
class Candidate:
    schema: str
    name: str
    frame: DataFrame
    estimated_rows: int | None = None

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(f.name, kind_of(f)) for f in self.frame.schema]

    @property
    def vectors(self) -> list[str]:
        return vector_columns(self.frame)


class Catalog:
    """Tables by schema and name. Nothing here writes to a source; looks into a table read a few rows or one aggregate."""

    def __init__(self, tables: dict[str, DataFrame], estimates: dict[str, int] | None = None):
        self.tables = {(n if "." in n else f"public.{n}"): df for n, df in tables.items()}
        self.estimates = {(n if "." in n else f"public.{n}"): e for n, e in (estimates or {}).items()}

    @classmethod
    def of_parquet(cls, spark: SparkSession, paths: dict[str, str]) -> Catalog:
        return cls({name: spark.read.parquet(path) for name, path in paths.items()})

    @classmethod
    def of_database(cls, spark: SparkSession, database: str) -> Catalog:
        tables = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
        return cls({f"{database}.{t}": spark.table(f"{quoted(database)}.{quoted(t)}") for t in tables})

    def frame(self, table: str) -> DataFrame:
        name = table if "." in table else f"public.{table}"
        if name not in self.tables:
            raise KeyError(f"unknown table: {table}")
        return self.tables[name]

    def keyed(self, table: str, key: str) -> DataFrame:
        """A table that is read as a whole, by a store that deals it by ranges of its key if it can."""
        return self.frame(table)

    @contextmanager
    def snapshot(self) -> Iterator[str | None]:
        """Within, all reads see one state of the store, if it can promise that; files and session tables are read as they are."""
        yield None

    def indexes(self, table: str) -> list[tuple[str, str, list[str]]] | None:
        """(name, method, columns) of a table's indexes; null where the store has none to speak of."""
        return None

    def estimate(self, qualified: str) -> int:
        """Rows by the catalog's estimate, or by a table's own statistics, else counted: of Parquet that reads no column, but the row
        counts that its files' footers hold, in tasks."""
        if qualified in self.estimates:
            return self.estimates[qualified]
        known = self.tables[qualified]._jdf.queryExecution().optimizedPlan().stats().rowCount()
        return int(str(known.get())) if known.isDefined() else self.tables[qualified].count()

    def candidates(self) -> list[Candidate]:
        """Tables with a vector column, and all of the schema `vecs`, with their estimated numbers of rows."""
        out = []
        for qualified in sorted(self.tables):
            schema, _, name = qualified.partition(".")
            held = Candidate(schema, name, self.tables[qualified])
            if held.vectors or schema == "vecs":
                held.estimated_rows = self.estimate(qualified)
                out.append(held)
        return out

    def json_keys(self, table: str, column: str, rows: int | None = KEY_ROWS) -> list[str]:
        """Distinct top-level keys of a few filled rows; of all with rows null."""
        df = self.frame(table)
        kind = df.select(F.col(quoted(column))).schema[0].dataType
        held = df.where(F.col(quoted(column)).isNotNull())
        held = held.limit(rows) if rows else held
        text = F.col(quoted(column)) if isinstance(kind, T.StringType) else F.to_json(F.col(quoted(column)))
        return sorted(r["k"] for r in held.select(F.explode(F.json_object_keys(text)).alias("k")).distinct().collect())

    def average_length(self, table: str, column: str, rows: int | None = LENGTH_ROWS) -> float:
        df = self.frame(table).where(F.col(quoted(column)).isNotNull()).select(F.length(F.col(quoted(column)).cast("string")).alias("n"))
        return (df.limit(rows) if rows else df).agg(F.avg("n").alias("n")).first()["n"] or 0.0

    def sample_rows(self, table: str, columns: list[str], n: int = SHOWN_ROWS) -> list[dict]:
        return [r.asDict() for r in self.frame(table).select(*(F.col(quoted(c)) for c in columns)).limit(n).collect()]

    def embedding_dims(self, table: str, column: str) -> int | None:
        row = self.frame(table).where(F.col(quoted(column)).isNotNull()).select(F.size(F.col(quoted(column))).alias("n")).limit(1).first()
        return row["n"] if row else None

    def has_embeddings(self, table: str, column: str) -> bool:
        return self.frame(table).where(F.col(quoted(column)).isNotNull()).limit(1).count() > 0

    def count(self, table: str) -> int:
        return self.frame(table).count()

