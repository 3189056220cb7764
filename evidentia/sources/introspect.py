"""Introspection: which table and columns hold the chunks, by named layouts, by scores, or by asking."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog import TIMES, Candidate, Catalog
from .mapping import Mapping

# Results depend on them.
LONG_TEXT, LEAST_SCORE, LEAST_MARGIN = 80, 16, 6
COLLATION = "UNICODE"
INTERNAL = ("evidentia_",)
MODELS = {1536: "openai text-embedding-3-small or ada-002 (guess)", 3072: "openai text-embedding-3-large (guess)", 1024: "Cohere/BGE-class (guess)", 768: "sentence-transformers-class (guess)"}


@dataclass(frozen=True)
class Recipe:
    """A layout that a framework writes: how its table is named, what it has, and its mapping."""

    id: str
    framework: str
    named: Callable[[Candidate], bool]
    has: tuple[str, ...]
    columns: dict[str, str | None]
    joins: dict[str, str] | None = None

    def mapping(self, table: Candidate, tables: list[Candidate]) -> Mapping:
        joins = None
        if self.joins:
            collection = next((t.qualified for t in tables if t.name == "langchain_pg_collection"), f"{table.schema}.langchain_pg_collection")
            joins = {"collectionTable": collection} | self.joins
        return Mapping(table.qualified, dict(self.columns), joins)


def columns(content: str, embedding: str, metadata: str, documentId: str | None = None, sourceUrl: str | None = None) -> dict[str, str | None]:  # noqa: N803
    return {"content": content, "embedding": embedding, "metadata": metadata, "documentId": documentId, "sourceUrl": sourceUrl, "updatedAt": None}


RECIPES = [
    Recipe("langchain-pgvector", "langchain", lambda t: t.name == "langchain_pg_embedding", ("document", "embedding", "cmetadata", "collection_id"), columns("document", "embedding", "cmetadata", sourceUrl="meta:cmetadata.source"), {"collectionFk": "collection_id", "collectionNameColumn": "name"}),
    Recipe("llamaindex-pgvector", "llamaindex", lambda t: t.name.startswith("data_"), ("text", "embedding", "metadata_", "node_id"), columns("text", "embedding", "metadata_", documentId="meta:metadata_.doc_id")),
    Recipe("supabase-vecs", "vecs", lambda t: t.schema == "vecs", ("id", "vec", "metadata"), columns("meta:metadata.text", "vec", "metadata")),
    Recipe("supabase-docs-tutorial", "generic", lambda t: t.name == "documents", ("content", "embedding", "metadata"), columns("content", "embedding", "metadata")),
]


def model_guess(dims: int | None) -> str | None:
    return None if dims is None else MODELS.get(dims, "unknown model (guess)")


def match_recipe(tables: list[Candidate]) -> tuple[Recipe, Mapping] | None:
    for recipe in RECIPES:
        for t in tables:
            if recipe.named(t) and set(recipe.has) <= {n for n, _ in t.columns}:
                return recipe, recipe.mapping(t, tables)
    return None


def content_score(name: str) -> int:
    n = name.lower()
    exact = {"content": 10, "text": 9, "document": 9, "body": 6, "body_text": 6, "summary": 3, "title": 0, "path": 0}
    if n in exact:
        return exact[n]
    return 6 if "chunk" in n and "text" in n else 0 if n.endswith("_hash") else 2


def table_score(name: str, internal: tuple[str, ...] = INTERNAL) -> int:
    """internal: prefixes of tables that tools keep for themselves."""
    n = name.lower()
    out = {"document_chunks": 10, "documents": 7}.get(n, 5 if n.endswith("_documents") or "chunk" in n else 0)
    return out - 12 * ("cache" in n) - 10 * n.startswith(internal)


def rows_score(n: int | None) -> int:
    return next((score for least, score in ((10_000, 5), (1_000, 4), (100, 3), (1, 1)) if (n or 0) >= least), 0)


def embedding_column(t: Candidate) -> str:
    return next((n for n in ("embedding", "vec") if n in t.vectors), t.vectors[0])


def places(spark: SparkSession, names: Iterable[str]) -> dict[str, int]:
    """Each name's place in the order of COLLATION, equal ones by code point: a few names, sorted by Spark as it sorts those of tables."""
    held = spark.createDataFrame([(n,) for n in sorted(set(names))], "n string")
    return {r["n"]: i for i, r in enumerate(held.orderBy(F.collate("n", COLLATION), "n").collect())}


def content_column(catalog: Catalog, t: Candidate) -> tuple[str, int] | None:
    """The column of long text with the best name; none if that is not clear."""
    lengths = {n: catalog.average_length(t.qualified, n) for n, kind in t.columns if kind == "text"}
    place = places(t.frame.sparkSession, lengths)
    ranked = sorted(((content_score(n), length, n) for n, length in lengths.items() if length > LONG_TEXT), key=lambda x: (-x[0], -x[1], place[x[2]]))
    if not ranked or ranked[0][0] <= 0:
        return None
    best = ranked[0][0]
    if len(ranked) > 1 and (best < 8 or (best < 10 and best - ranked[1][0] < 2)):
        return None
    return ranked[0][2], best


def pick(t: Candidate, kinds: tuple[str, ...] | None, names: tuple[str, ...], any_other: bool = True) -> str | None:
    fits = [n for n, kind in t.columns if kinds is None or kind in kinds]
    return next((n for n in fits if n in names), fits[0] if any_other and fits else None)


def score_table(catalog: Catalog, t: Candidate, internal: tuple[str, ...] = INTERNAL) -> tuple[int, Mapping] | None:
    content = content_column(catalog, t) if t.vectors else None
    if content is None:
        return None
    embedding = embedding_column(t)
    metadata = pick(t, ("jsonb",), ("metadata", "cmetadata", "metadata_"))
    url = pick(t, ("text",), ("source_url", "url", "page_url"), False)
    document = pick(t, None, ("document_id", "doc_id", "source_id", "node_id"), False)
    updated = pick(t, TIMES, ("updated_at", "modified_at", "created_at"))
    score = content[1] + table_score(t.name, internal) + rows_score(t.estimated_rows) + 2 * (embedding in ("embedding", "vec")) + 2 * bool(metadata) + bool(url) + bool(document) + bool(updated)
    return score, Mapping.of(t.qualified, content[0], embedding, metadata, document, url, updated)


def match_generic(catalog: Catalog, tables: list[Candidate], internal: tuple[str, ...] = INTERNAL) -> Mapping | None:
    """The one table that clearly is the chunk table, if there is one."""
    scored = [(s[0], t.estimated_rows, s[1]) for t in tables if (s := score_table(catalog, t, internal))]
    place = places(tables[0].frame.sparkSession, (s[2].table for s in scored)) if tables else {}
    scored.sort(key=lambda x: (-x[0], -(-1 if x[1] is None else x[1]), place[x[2].table]))
    if not scored or scored[0][0] < LEAST_SCORE or (len(scored) > 1 and scored[0][0] - scored[1][0] < LEAST_MARGIN):
        return None
    return scored[0][2]


def fingerprint(catalog: Catalog, tables: list[Candidate]) -> tuple[list[dict], str]:
    """Sorted tables, columns and sampled JSON keys, and the SHA-256 of that as compact JSON. Tables and columns are in the order of the one
    collation that Spark's own sorts of names use; JSON keys by code point."""
    place = places(tables[0].frame.sparkSession, [n for t in tables for n in (t.qualified, *(c for c, _ in t.columns))]) if tables else {}
    out = []
    for t in sorted(tables, key=lambda t: place[t.qualified]):
        keys = {n: catalog.json_keys(t.qualified, n) for n, kind in t.columns if kind == "jsonb"}
        out.append({"table": t.qualified, "columns": [{"name": n, "type": k} for n, k in sorted(t.columns, key=lambda c: (place[c[0]], c[1]))], "jsonKeys": keys})
    return out, hashlib.sha256(json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class IntrospectError(RuntimeError):
    pass


@dataclass
class Prompts:
    """What to ask with: confirm(message), select(message, choices), optional(message, choices)."""

    confirm: Callable[[str], bool]
    select: Callable[[str, list[str]], str]
    optional: Callable[[str, list[str]], str | None]


def ask(catalog: Catalog, tables: list[Candidate], prompts: Prompts) -> Mapping:
    """A mapping picked column by column, confirmed on three rows."""
    name = prompts.select("Which table holds the chunks?", [t.qualified for t in tables])
    t = next((t for t in tables if t.qualified == name), None)
    if t is None:
        raise IntrospectError(f"unknown table: {name}")
    of = lambda kinds: [n for n, kind in t.columns if kind in kinds]
    embedding = prompts.select("Which column holds the vectors?", t.vectors)
    content = prompts.select("Which column holds the text?", of(("text",)))
    metadata = prompts.optional("Which column holds metadata?", of(("jsonb",)))
    url = prompts.optional("Which column holds the source's address?", of(("text",)))
    updated = prompts.optional("Which column holds the time of the last update?", of(TIMES))
    rows = catalog.sample_rows(t.qualified, [content])
    if not prompts.confirm("\n".join(["Does this look like the text?", *(f"  - {str(r[content] or '')[:80]}" for r in rows)])):
        raise IntrospectError("the mapping was refused on seeing its rows")
    return Mapping.of(t.qualified, content, embedding, metadata, None, url, updated)


@dataclass
class Introspection:
    mapping: Mapping
    recipe: str
    stack: dict


def stack_of(catalog: Catalog, mapping: Mapping, framework: str | None = None, tables: list[Candidate] | None = None) -> dict:
    """fingerprintHash, frameworkGuess, embeddingDims and embeddingModelGuess of a mapping, known or found."""
    tables = catalog.candidates() if tables is None else tables
    named = match_recipe(tables)
    if framework is None and named and named[1].table == mapping.table:
        framework = named[0].framework
    dims = None if mapping.columns["embedding"].startswith("meta:") else catalog.embedding_dims(mapping.table, mapping.columns["embedding"])
    return {"fingerprintHash": fingerprint(catalog, tables)[1], "frameworkGuess": framework, "embeddingDims": dims, "embeddingModelGuess": model_guess(dims)}


def introspect(catalog: Catalog, prompts: Prompts | None = None, yes: bool = False, internal: tuple[str, ...] = INTERNAL) -> Introspection:
    """Named recipe, else scores, else questions; without prompts what needs a question is an error."""
    tables = catalog.candidates()
    if not tables:
        raise IntrospectError("no table with a vector column was found")
    agree = lambda m: yes or prompts is None or prompts.confirm(f"Use {m.columns['content']!r} and {m.columns['embedding']!r} of {m.table}?")
    named = match_recipe(tables)
    if named and agree(named[1]):
        return Introspection(named[1], named[0].id, stack_of(catalog, named[1], named[0].framework, tables))
    generic = match_generic(catalog, tables, internal)
    if generic and agree(generic):
        return Introspection(generic, "generic-single-table", stack_of(catalog, generic, "custom", tables))
    if prompts is None:
        raise IntrospectError("the tables cannot be mapped without questions; run init first")
    asked = ask(catalog, tables, prompts)
    return Introspection(asked, "manual", stack_of(catalog, asked, "custom", tables))
