"""Databases behind JDBC: catalog queries, vectors as arrays, reads by parts, indexes. Sessions refuse writes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .indexes import described
from .mapping import segments

#: Rows that one task reads, about; a table has as many parts as its rows ask for.
PART_ROWS = 200_000


@dataclass(frozen=True)
class Dialect:
    """What is asked of a kind of database, as SQL that gives the columns named.

    columns: table_schema, table_name, column_name, kind, place. sizes: table_schema, table_name, n_rows, n_pages
    (estimates). indexes, of {schema} and {table}: name, definition. json and vector: kinds that are read as
    text by the cast. by_page: a predicate for rows of pages from {low} up to, not including, {high}. relations: of {schema} and {table}, the
    catalog's own tables in place of definitions: indexes (name, method, keys and opclass_ids as numbers parted by spaces, key_count, expressions
    parted by SEPARATOR), attributes (attnum, attname) and classes (opclass_id, opclass). export: a query of a transaction that gives the name of its snapshot to
    others, and share: what makes another transaction read that snapshot, {snapshot}.
    """

    columns: str
    sizes: str | None = None
    indexes: str | None = None
    read_only: str | None = None
    json: tuple[str, ...] = ("json", "jsonb")
    vector: tuple[str, ...] = ("vector",)
    as_text: str = "CAST({0} AS text)"
    by_page: str | None = None
    relations: dict[str, str] | None = None
    export: str | None = None
    share: str | None = None
    options: dict[str, str] = field(default_factory=lambda: {"fetchsize": "500"})


POSTGRESQL = Dialect(
    columns="SELECT table_schema, table_name, column_name, udt_name AS kind, ordinal_position AS place FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
    sizes="SELECT s.nspname AS table_schema, t.relname AS table_name, CAST(GREATEST(t.reltuples, 0) AS bigint) AS n_rows, CAST(t.relpages AS bigint) AS n_pages FROM pg_class t JOIN pg_namespace s ON s.oid = t.relnamespace WHERE t.relkind IN ('r', 'p')",
    indexes="SELECT indexname AS name, indexdef AS definition FROM pg_indexes WHERE schemaname = '{schema}' AND tablename = '{table}'",
    read_only="SET default_transaction_read_only = on",
    by_page="ctid >= '({low},0)'::tid AND ctid < '({high},0)'::tid",
    relations={
        "indexes": "SELECT c.relname AS name, am.amname AS method, CAST(x.indkey AS text) AS keys, CAST(x.indclass AS text) AS opclass_ids, CAST(x.indnkeyatts AS int) AS key_count, array_to_string(ARRAY(SELECT pg_get_indexdef(x.indexrelid, k + 1, true) FROM generate_series(0, x.indnatts - 1) k WHERE x.indkey[k] = 0 ORDER BY k), chr(31)) AS expressions FROM pg_index x JOIN pg_class c ON c.oid = x.indexrelid JOIN pg_am am ON am.oid = c.relam WHERE x.indrelid = CAST('\"{schema}\".\"{table}\"' AS regclass)",
        "attributes": "SELECT CAST(attnum AS int) AS attnum, attname FROM pg_attribute WHERE attnum > 0 AND NOT attisdropped AND attrelid = CAST('\"{schema}\".\"{table}\"' AS regclass)",
        "classes": "SELECT CAST(oid AS bigint) AS opclass_id, opcname AS opclass FROM pg_opclass",
    },
    export="SELECT pg_export_snapshot()",
    share="SET TRANSACTION ISOLATION LEVEL REPEATABLE READ READ ONLY; SET TRANSACTION SNAPSHOT '{snapshot}'",
)

SEPARATOR = chr(31)


def parse_url(connection: str) -> tuple[str, dict[str, str]]:
    """The JDBC address and properties of a connection: a jdbc: address, or postgres://user:password@host:port/database."""
    if connection.startswith("jdbc:"):
        return connection, {}
    parts = urlsplit(connection)
    if parts.scheme not in ("postgres", "postgresql") or not parts.hostname:
        raise ValueError("a connection begins with jdbc: or postgresql://")
    held = {"user": unquote(parts.username or ""), "password": unquote(parts.password or "")} | dict(parse_qsl(parts.query))
    host = f"[{parts.hostname}]" if ":" in parts.hostname else parts.hostname
    return f"jdbc:postgresql://{host}{f':{parts.port}' if parts.port else ''}{parts.path}", {k: v for k, v in held.items() if v}


def parse_index(name: str, definition: str) -> tuple[str, str, list[str]]:
    """Name, method and plain columns of an index, in order, from its definition (operator classes and options apart)."""
    found = re.search(r"\bUSING (\w+) \((.*?)\)(?: WITH | WHERE | INCLUDE |$)", definition)
    method, inside = (found[1], found[2]) if found else ("", "")
    columns = [re.match(r'\s*"?([A-Za-z0-9_]+)"?', part) for part in inside.split(",")]
    return name, method, [m[1] for m in columns if m]


class Database(Catalog):
    """The tables with a vector column, and those of the schema `vecs`, of a database; its statistics instead of counts.

    Columns of vectors and JSON are cast to text by the database and made arrays, or marked as JSON, here, so
    that they look as in any other source. A large table is read by ranges of pages, or of a whole-numbered key.
    """

    def __init__(self, spark: SparkSession, connection: str, dialect: Dialect = POSTGRESQL, properties: dict[str, str] | None = None):
        self.spark, self.dialect = spark, dialect
        self.url, held = parse_url(connection)
        self.options = dialect.options | ({"sessionInitStatement": dialect.read_only} if dialect.read_only else {}) | held | (properties or {})
        lower = lambda r: {k.lower(): v for k, v in r.asDict().items()}
        rows = sorted((lower(r) for r in self._query(dialect.columns)), key=lambda r: (r["table_schema"], r["table_name"], r["place"]))
        self.columns: dict[str, list[tuple[str, str]]] = {}
        for r in rows:
            self.columns.setdefault(f"{r['table_schema']}.{r['table_name']}", []).append((r["column_name"], r["kind"].strip()))
        sizes = [lower(r) for r in self._query(dialect.sizes)] if dialect.sizes else []
        self.pages = {f"{r['table_schema']}.{r['table_name']}": r["n_pages"] or 0 for r in sizes}
        named = {t for t, cs in self.columns.items() if any(k in dialect.vector for _, k in cs) or t.startswith("vecs.")}
        estimates = {f"{r['table_schema']}.{r['table_name']}": r["n_rows"] for r in sizes}
        super().__init__({}, {t: n for t, n in estimates.items() if t in self.columns})
        self.tables = {t: self.read(t) for t in sorted(named)}

    def _query(self, sql: str) -> list:
        return self._frame(sql).collect()

    def _frame(self, sql: str) -> DataFrame:
        out = self.spark.read.format("jdbc").options(url=self.url, query=sql, **self.options).load()
        return out.toDF(*(c.lower() for c in out.columns))

    @contextmanager
    def snapshot(self) -> Iterator[str | None]:
        """Tables that are read within see the database as it is now, in all parts: one transaction, held open here, gives its snapshot's name, and
        every part's session begins by taking it, so a row that is changed or moved meanwhile is read once, as it was. DataFrames made within must be used
        within, too. The name; or null where the database has no such thing, and parts are transactions of their own.
        """
        if self.dialect.export is None:
            yield None
            return
        jvm = self.spark._jvm
        held = jvm.java.util.Properties()
        for k, v in self.options.items():
            held.setProperty(k, v)
        con = jvm.java.sql.DriverManager.getConnection(self.url, held)
        before = dict(self.options)
        try:
            con.setAutoCommit(False)
            con.setReadOnly(True)
            con.setTransactionIsolation(4)  # repeatable read, as JDBC numbers it
            rows = con.createStatement().executeQuery(self.dialect.export)
            rows.next()
            name = rows.getString(1)
            if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
                raise ValueError(f"a snapshot's name is letters, digits, - and _: {name!r}")
            self.options = before | {"sessionInitStatement": self.dialect.share.format(snapshot=name)}
            yield name
        finally:
            self.options = before
            con.rollback()
            con.close()

    def read(self, table: str, key: str | None = None) -> DataFrame:
        """A table's rows; by ranges of `key`, if one is given and whole-numbered, else of pages where the database has them."""
        schema, name = segments(table, "table")
        quote = lambda n: '"' + n.replace('"', '""') + '"'
        columns, text = self.columns[table], {*self.dialect.vector, *self.dialect.json}
        listed = ", ".join(f"{self.dialect.as_text.format(quote(n))} AS {quote(n)}" if k in text else quote(n) for n, k in columns)
        source, parts = f"{quote(schema)}.{quote(name)}", -(-(self.estimates.get(table) or 0) // PART_ROWS)
        reader = self.spark.read.format("jdbc").options(**self.options)
        if key is not None and parts > 1:
            low, high = self._query(f"SELECT MIN({quote(key)}) AS low, MAX({quote(key)}) AS high FROM {source}")[0]
            if isinstance(low, int):
                reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=parts)
                out = reader.options(url=self.url, dbtable=f"(SELECT {listed} FROM {source}) held").load()
                return self._typed(out, columns)
        pages = self.pages.get(table, 0)
        if parts > 1 and self.dialect.by_page and pages > 1:
            cuts = sorted({pages * k // parts for k in range(parts)})
            # The last range is open: rows may have come since the statistics.
            ranges = [self.dialect.by_page.format(low=a, high=b) for a, b in zip(cuts, [*cuts[1:], 2**32 - 2], strict=True)]
            inner = f"(SELECT {listed}, ctid FROM {source}) held"
            out = self.spark.read.jdbc(self.url, inner, predicates=ranges, properties=self.options).drop("ctid")
        else:
            out = reader.options(url=self.url, query=f"SELECT {listed} FROM {source}").load()
        return self._typed(out, columns)

    def _typed(self, rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
        out = []
        for n, k in columns:
            value = F.col(f"`{n}`")
            if k in self.dialect.vector:
                value = F.from_json(value.cast("string"), "array<float>").alias(n)
            elif k in self.dialect.json:
                value = value.cast("string").alias(n, metadata={"json": True})
            out.append(value)
        return rows.select(*out)

    def indexes(self, table: str) -> list[tuple[str, str, list[str]]] | None:
        schema, name = segments(table if "." in table else f"public.{table}", "table")
        if self.dialect.relations is not None:
            return [(r["name"], r["method"], r["columns"]) for r in self.index_columns(schema, name).orderBy("name").collect()]
        if self.dialect.indexes is None:
            return None
        rows = self._query(self.dialect.indexes.format(schema=schema, table=name))
        return [parse_index(r[0], r[1]) for r in sorted(rows, key=lambda r: r[0])]

    def index_columns(self, schema: str, table: str) -> DataFrame:
        """A table's indexes as sources.indexes.described has them: columns by ordinal position, included ones, operator classes, expressions."""
        held = {k: self._frame(sql.format(schema=schema, table=table)) for k, sql in self.dialect.relations.items()}
        named = F.lit(f"{schema}.{table}").alias("table_name")
        parts = lambda c, by, kind: F.filter(F.split(F.coalesce(F.trim(c), F.lit("")), by), lambda x: x != "").cast(f"array<{kind}>")
        indexes = held["indexes"].select(named, "name", "method", parts("keys", " ", "int").alias("keys"), F.col("key_count").cast("int").alias("key_count"), parts("opclass_ids", " ", "long").alias("opclass_ids"), parts("expressions", SEPARATOR, "string").alias("expressions"))
        attributes = held["attributes"].select(named, F.col("attnum").cast("int").alias("attnum"), "attname")
        return described(indexes, attributes, held["classes"].select(F.col("opclass_id").cast("long").alias("opclass_id"), "opclass"))

    def keyed(self, table: str, key: str) -> DataFrame:
        name = table if "." in table else f"public.{table}"
        return self.read(name, key) if name in self.columns else super().frame(table)
