"""Planted corpora: what a scan must find in each, by the numbers planted."""

import json
from datetime import UTC, datetime

import pytest
from fixtures import healthy, unit

from evidentia.plans.scan import scan
from evidentia.sources.catalog import Catalog
from evidentia.sources.introspect import introspect
from evidentia.sources.mapping import Mapping

NOW = datetime(2024, 5, 1, tzinfo=UTC)
TABLE = "| name | size | price |\n|---|---|---|\n" + "\n".join(f"| item {k} | {k} | {k * 3} |" for k in range(3)) + "\nPrices are in whole coins and hold for one season only, as the heading of the page says."


def vec(i, dims=32):
    return [float(x) for x in unit(i, dims)]


def titled(result, title):
    return next((f for f in result.findings if f.title == title), None)


def test_mixed_dims(spark):
    rows = [(i, healthy(i), vec(i, 16 if i < 45 else 32) if i < 50 else None, json.dumps({"doc_id": f"d{i}"})) for i in range(53)]
    df = spark.createDataFrame(rows, "node_id long, text string, embedding array<float>, metadata_ string")
    out = scan(df, Mapping.of("public.data_embeddings", "text", "embedding", "metadata_", "meta:metadata_.doc_id"), "node_id")
    assert out.stats["distinctEmbeddingDims"] == [16, 32] and out.stats["nullEmbeddings"] == 3 and out.score == 100
    assert out.totals["documents"] == 53 and titled(out, "3 chunks have no embedding")


def test_clean_corpus(spark):
    rows = [(i, healthy(i), vec(i), {"topic": str(i)}, f"https://example.org/{i}", NOW) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, body_text string, vec array<float>, props map<string,string>, page_url string, modified_at timestamp")
    out = scan(df, Mapping.of("public.kb_entries", "body_text", "vec", "props", None, "page_url", "modified_at"), "id")
    assert out.score == 100 and not {f.type for f in out.findings} & {"exact_duplicate", "near_duplicate", "risky_chunk", "thin_chunk"}
    assert out.subscores["freshness"] == 100


def test_metadata_health(spark):
    def meta(i):
        return json.dumps({"source": f"s{i}", "tenant_id": i if i % 2 else str(i)} | ({"region": "north"} if i % 3 == 0 else {}))

    rows = [(i, healthy(i) + (" The same long sentence stands here again and again." * 180 if i < 10 else ""), vec(i), meta(i) if i < 28 else None, NOW) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<float>, metadata string, created_at timestamp")
    out = scan(df, Mapping.of("public.metadata_documents", "content", "embedding", "metadata", None, None, "created_at"), "id")
    assert titled(out, "Metadata is missing on many chunks").evidence["missingMetadataChunks"] == 12
    assert titled(out, "Many chunks are very large").evidence["largeChunks"] == 10
    mixed = titled(out, "Metadata filter fields use mixed value types").evidence["keys"]
    assert [(k["key"], k["types"]) for k in mixed] == [("tenant_id", {"number": 14, "string": 14})]
    keys = titled(out, "Metadata keys are inconsistent across chunks").evidence["keys"]
    assert [(k["key"], k["presentRows"]) for k in keys[:2]] == [("source", 28), ("tenant_id", 28)] and keys[2]["key"].startswith("sha256:") and keys[2]["presentRows"] == 10
    assert out.subscores["coverage"] == 45 and "north" not in json.dumps([f.to_dict() for f in out.findings])


def test_structured(spark):
    def row(i):
        if i < 20:
            return (i, f"{TABLE} Table {i}.", vec(i), json.dumps({"topic": "prices"}), None)
        if i < 30:
            return (i, f"{TABLE} Table {i}.", vec(i), json.dumps({"source": "a.xlsx", "sheet_name": "S", "row_id": i, "page_number": 1}), NOW)
        return (i, healthy(i), vec(i), json.dumps({"source": "b.md"}), NOW)

    df = spark.createDataFrame([row(i) for i in range(48)], "id long, content string, embedding array<float>, metadata string, created_at timestamp")
    out = scan(df, Mapping.of("public.structured_documents", "content", "embedding", "metadata", None, None, "created_at"), "id")
    found = titled(out, "Table-like chunks are missing source/citation locators")
    assert found.evidence["tableLikeWithoutLocator"] == 20 and found.evidence["tableLikePct"] == 62.5 and found.evidence["tableLikeWithoutLocatorPct"] == 66.7
    assert titled(out, "Many chunks have no timestamp, so freshness is partial").affected == 20
    assert out.stats["staleDocsPct"] == pytest.approx(41.67, abs=0.01) and out.subscores["freshness"] == pytest.approx(16.67, abs=0.01) and out.subscores["coverage"] == 33


def test_boundaries(spark):
    rows = [(i, f"and so passage {i} goes on from {healthy(i)[10:180]} and stops at" if i < 24 else healthy(i), vec(i), json.dumps({"source": "a"}), NOW) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<float>, metadata string, created_at timestamp")
    out = scan(df, Mapping.of("public.boundary_documents", "content", "embedding", "metadata", None, None, "created_at"), "id")
    first = next(f for f in out.findings if f.type == "thin_chunk")
    assert first.title == "Many chunks look mechanically split mid-sentence" and first.affected == 24 and first.evidence["midSentencePct"] == 60 and out.subscores["quality"] == 0


def test_locators(spark):
    rows = [(i, healthy(i), vec(i), json.dumps({"topic": "x"}), None if i < 35 else f"https://example.org/{i}", NOW) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<float>, metadata string, source_url string, updated_at timestamp")
    out = scan(df, Mapping.of("public.citation_documents", "content", "embedding", "metadata", None, "source_url", "updated_at"), "id")
    found = titled(out, "Source/citation locator is missing on many chunks")
    assert found.affected == 35 and found.evidence["sourceLocatorPct"] == 30 and out.subscores["coverage"] == 30


def test_retention(spark):
    rows = [(i, healthy(i), vec(i), f"https://example.org/{i}", NOW, NOW if i < 12 else None, 12 <= i < 16) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<float>, source_url string, updated_at timestamp, deleted_at timestamp, archived boolean")
    out = scan(df, Mapping.of("public.retention_documents", "content", "embedding", None, None, "source_url", "updated_at"), "id")
    found = titled(out, "Rows marked deleted or archived are still in the mapped chunk table")
    assert found.affected == 16 and found.evidence["markedPct"] == 25 and found.evidence["markerColumns"] == ["archived", "deleted_at"]


def test_primary_table_among_many(spark):
    rows = [(i, healthy(i), vec(i), vec(i, 64), f"s{i}", f"https://example.org/{i}", {"k": "v"}, NOW) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id long, content string, embedding array<float>, embedding_wide array<float>, source_id string, source_url string, metadata map<string,string>, created_at timestamp")
    cache = chunks.select("id", "content", "embedding").limit(20)
    held = Catalog({"document_chunks": chunks, "embedding_cache": cache, "tool_chunks": cache}, {"document_chunks": 150, "embedding_cache": 20, "tool_chunks": 8})
    found = introspect(held, internal=("tool_",))
    assert found.mapping.table == "public.document_chunks" and found.mapping.columns == {"content": "content", "embedding": "embedding", "metadata": "metadata", "documentId": "source_id", "sourceUrl": "source_url", "updatedAt": "created_at"}
    out = scan(chunks, found.mapping, "id")
    assert titled(out, "Mapped table has multiple vector columns").evidence["otherVectorColumns"] == ["embedding_wide"]


def test_generic_body(spark):
    rows = [(i, f"d{i}", healthy(i), vec(i), {"category": "a"}, f"https://example.org/{i}", NOW) for i in range(72)]
    df = spark.createDataFrame(rows, "chunk_id long, document_id string, body string, embedding array<float>, properties map<string,string>, source_url string, updated_at timestamp")
    found = introspect(Catalog({"knowledge_chunks": df}))
    assert found.mapping.columns == {"content": "body", "embedding": "embedding", "metadata": "properties", "documentId": "document_id", "sourceUrl": "source_url", "updatedAt": "updated_at"}
    assert scan(df, found.mapping, "chunk_id").findings == []


def test_scale(spark):
    """100,000 generated chunks, every counter exact and nothing but bounded results on the driver."""
    from pyspark.sql import functions as F

    from evidentia.plans.scan import Limits

    i = F.col("id")
    text = F.concat(F.lit("Passage "), F.when(i % 5000 == 0, F.lit("that is always the same")).otherwise(F.concat(F.lit("number "), i.cast("string"))), F.lit(" tells of harbours and lanterns and of all that " * 5 + "ends here."))
    text = F.when(i % 3333 == 1, F.concat(F.lit("Note "), i.cast("string"))).when(i % 7777 == 2, F.concat(F.lit("Key sk-" + "a" * 24 + " in "), text)).otherwise(text)
    df = spark.range(100_000).select("id", text.alias("text"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"))
    out = scan(df, Mapping.of("public.big", "text", "embedding"), "id", limits=Limits(None, 1))
    assert (out.stats["totalChunks"], out.stats["exactDuplicateRows"], out.stats["thinChunks"], out.stats["riskyCritical"]) == (100_000, 19, 31, 13)  # one of the 20 equal texts is a note
