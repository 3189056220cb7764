"""Findings: what each detector says, from counters and a bounded number of rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from ..functions.metadata import SOURCE_KEYS, STRUCTURED_KEYS
from ..operators.features import LARGE_CHARS
from . import health as H

# Results depend on them.
TYPES = ["stale_source", "stale_document", "exact_duplicate", "near_duplicate", "thin_chunk", "risky_chunk", "embedding_mixed_dims", "embedding_null", "architecture", "test_regression"]
SEVERITIES = ["critical", "warning", "info"]
EXACT_CRITICAL_PCT, THIN_WARNING_PCT = 5, 15
MID_MIN, MID_PCT = 8, 20
MISSING_TIMESTAMP_PCT, MISSING_METADATA_PCT, LARGE_PCT = 20, 20, 20
LOCATED_PCT, TABLE_MIN, TABLE_PCT, TABLE_UNLOCATED_PCT = 80, 5, 10, 50
MIXED_COST = 25
INDEX_INFO_ROWS, INDEX_WARNING_ROWS = 100, 1000
ANN_METHODS = ("hnsw", "ivfflat")


@dataclass
class Finding:
    type: str
    severity: str
    title: str
    evidence: dict
    repair: dict | None = None
    affected: int = 1

    def to_dict(self) -> dict:
        return {"type": self.type, "severity": self.severity, "title": self.title, "evidence": self.evidence, "suggestedRepair": self.repair, "affectedCount": self.affected}


@dataclass
class Unlisted:
    """Findings that are counted but not listed one by one."""

    type: str
    severity: str
    findings: int
    affected: int
    #: That of those listed which have the same to be done, where their type alone does not tell.
    title: str | None = None

    def to_dict(self) -> dict:
        return {"type": self.type, "severity": self.severity, "findings": self.findings, "affectedCount": self.affected} | ({"title": self.title} if self.title else {})


def repair(kind: str, description: str, sql: str | None = None) -> dict:
    return {"kind": kind, "description": description} | ({"sql": sql} if sql else {})


@dataclass
class Inventory:
    min_chunks: int | None = None
    min_documents: int | None = None
    observed_documents: int | None = None

    def __post_init__(self):
        if self.min_chunks is None and self.min_documents is None:
            raise ValueError("an inventory expects a number of chunks or of documents")


@dataclass
class Snapshot:
    locator: str
    signal_kind: str
    signal_value: str
    observed_at: str
    changed: bool


@dataclass
class IndexInfo:
    """One index of the mapped table, as its store reports it (Spark's own tables have none)."""

    name: str
    method: str
    columns: list[str] = field(default_factory=list)


def exact(groups: list[dict], n_groups: int, members: int, total: int, sampled: bool) -> tuple[list[Finding], float]:
    """A finding for each group given, in order of first rows, and a summary if the share is high."""
    share = H.pct(members, total)
    cut = {"truncatedFindings": True} if n_groups > len(groups) else {}
    out = [
        Finding("exact_duplicate", "warning", f"{g['members']} chunks are exact duplicates", {"duplicateChunks": g["members"], "refs": list(g["refs"]), "sampled": sampled} | cut, None, g["members"])
        for g in groups
    ]
    if share > EXACT_CRITICAL_PCT:
        shown = H.rounded(share, 1)
        evidence = {"summary": True, "duplicateGroups": n_groups, "duplicatedChunks": members, "corpusPct": shown, "sampled": sampled}
        out.append(Finding("exact_duplicate", "critical", f"{fixed(share, 1)}% of the corpus is exact-duplicated", evidence, None, members))
    return out, share


def exact_unlisted(groups: list[dict], n_groups: int, members: int) -> list[Unlisted]:
    """The findings of all groups beyond those given, from the counts of all."""
    rest = n_groups - len(groups)
    return [Unlisted("exact_duplicate", "warning", rest, members - sum(g["members"] for g in groups))] if rest else []


def rows_unlisted(listed: list[tuple[str, Finding]], counts: dict[str, int]) -> list[Unlisted]:
    """The findings of single rows beyond those listed, by kind, from the counts of all; of a kind that has any some are listed."""
    kinds: dict[str, list[Finding]] = {}
    for kind, finding in listed:
        kinds.setdefault(kind, []).append(finding)
    rest = [(held[0], counts[kind] - len(held)) for kind, held in kinds.items()]
    return [Unlisted(f.type, f.severity, n, n, f.title) for f, n in rest if n > 0]


def fixed(x: float, digits: int) -> str:
    """A number with exactly so many decimals."""
    return f"{H.rounded(x, digits):.{digits}f}"


def near(pairs: list[dict], n_pairs: int, probes: int, threshold: float) -> tuple[list[Finding], float]:
    out = [
        Finding("near_duplicate", "warning", "Two chunks are near-duplicates", {"refs": [p["ref"], p["neighbor_ref"]], "similarity": H.rounded(p["similarity"], 4), "threshold": threshold}, None, 2)
        for p in pairs
    ]
    return out, H.pct(n_pairs, probes)


def thin(rows: list[dict], c: dict, total: int, sampled: bool) -> tuple[list[Finding], float]:
    n = c["short"] + c["link_density"] + c["mid_sentence"]
    share, mid = H.pct(n, total), H.pct(c["mid_sentence"], total)
    severity = "warning" if share > THIN_WARNING_PCT else "info"
    out = [
        Finding("thin_chunk", severity, f"Thin chunk ({r['thin_reason']})", {"ref": r["ref"], "reason": r["thin_reason"], "length": r["length"], "corpusPct": H.rounded(share, 1), "truncatedFindings": n > len(rows)})
        for r in rows
    ]
    if c["mid_sentence"] >= MID_MIN and mid >= MID_PCT:
        evidence = {"totalChunks": total, "midSentenceChunks": c["mid_sentence"], "midSentencePct": H.rounded(mid, 1), "sampled": sampled}
        what = repair("review_chunk_boundaries", "Check where the splitter cuts and how much pieces overlap: many rows begin and end inside sentences.")
        out.insert(0, Finding("thin_chunk", "warning", "Many chunks look mechanically split mid-sentence", evidence, what, c["mid_sentence"]))
    return out, share


def risky(rows: list[dict]) -> list[Finding]:
    out = []
    for r in rows:
        if r["risk"] == "secret":
            evidence = {"ref": r["ref"], "kind": "secret", "matches": [{"pattern": m["pattern"], "redacted": m["redacted"]} for m in r["secrets"]]}
            out.append(Finding("risky_chunk", "critical", "Chunk contains what looks like a secret", evidence))
        elif r["risk"] == "marker":
            out.append(Finding("risky_chunk", "warning", "Chunk contains a risk marker", {"ref": r["ref"], "kind": "marker", "markers": list(r["markers"])}))
        else:
            out.append(Finding("risky_chunk", "warning", "Chunk contains many email addresses", {"ref": r["ref"], "kind": "emails", "emailCount": r["email_count"]}))
    return out


def changed_sources(snapshots: list[Snapshot]) -> list[Finding]:
    out = []
    for s in snapshots:
        if s.changed:
            digest = "sha256:" + hashlib.sha256(s.locator.encode()).hexdigest()[:16]
            out.append(Finding("stale_source", "warning", "Source changed since last scan", {"locatorHash": digest, "signalKind": s.signal_kind, "observedAt": s.observed_at}))
    return out


def freshness(c: dict, table: str, mapped: bool, snapshots: list[Snapshot], sampled: bool) -> tuple[list[Finding], float | None]:
    """Findings, and the share of chunks that are stale or undated (null: cannot be measured)."""
    out: list[Finding] = []
    if not mapped:
        sql = f"ALTER TABLE {table} ADD COLUMN updated_at timestamptz default now();"
        what = repair("add_column", "Give the table a column that says when a chunk was last updated.", sql)
        out.append(Finding("architecture", "warning", "Your index has no timestamps — staleness can't be measured", {"table": table}, what))
    out += changed_sources(snapshots)
    if not mapped:
        return out, None
    scanned, measured, missing = c["scanned"], c["measured"], c["missing_timestamps"]
    share = H.pct(missing, scanned)
    if scanned and share >= MISSING_TIMESTAMP_PCT:
        title = "Mapped timestamp column is empty" if measured == 0 else "Many chunks have no timestamp, so freshness is partial"
        evidence = {"scannedChunks": scanned, "timestampedChunks": measured, "missingTimestampChunks": missing, "missingTimestampPct": H.rounded(share, 1), "sampled": sampled}
        out.append(Finding("architecture", "warning", title, evidence, repair("backfill_timestamps", "Fill in the missing update times so that old and new chunks can be told apart."), missing))
    if c["stale"]:
        out.append(Finding("stale_document", "warning", f"{c['stale']} documents are older than a changed source", {"staleDocuments": c["stale"], "measuredDocuments": measured}, None, c["stale"]))
    return out, (c["stale"] + missing) / scanned * 100 if measured else None


def embeddings(dims: list[tuple[int, int]], nulls: int) -> list[Finding]:
    out, dims = [], sorted(dims)
    if len(dims) > 1:
        out.append(Finding("embedding_mixed_dims", "critical", "Embeddings have mixed dimensions — retrieval is broken", {"dimensions": [{"dims": d, "count": n} for d, n in dims]}, None, sum(n for _, n in dims)))
    if nulls:
        out.append(Finding("embedding_null", "warning", f"{nulls} chunks have no embedding", {"nullEmbeddings": nulls}, None, nulls))
    return out


def inventory(expected: Inventory | None, total: int) -> tuple[list[Finding], int]:
    out, cover = [], 100
    if expected is None:
        return out, cover

    def below(what: str, least: int, seen: int, kind: str, text: str) -> None:
        nonlocal cover
        share = seen / least * 100
        cover = min(cover, H.whole(share))
        name = what.capitalize() + "s"
        evidence = {f"expectedMin{name}": least, f"observed{name}": seen, f"missing{name}": least - seen, "observedPct": H.rounded(share, 1)}
        out.append(Finding("architecture", "critical" if seen / least < 0.5 else "warning", f"Indexed {what} count is below the configured inventory minimum", evidence, repair(kind, text), least - seen))

    if expected.min_chunks is not None and total < expected.min_chunks:
        below("chunk", expected.min_chunks, total, "verify_ingestion_inventory", "Hold the ingestion job's output against the inventory: rows may be skipped, overwritten or still to come.")
    if expected.min_documents is not None:
        if expected.observed_documents is None:
            evidence = {"expectedMinDocuments": expected.min_documents, "mappedDocumentId": False}
            out.append(Finding("architecture", "info", "Document inventory cannot be verified without a mapped document id", evidence, repair("map_document_id", "Map a stable document id so that documents can be counted.")))
        elif expected.observed_documents < expected.min_documents:
            below("document", expected.min_documents, expected.observed_documents, "verify_document_inventory", "Hold the list of sources against the indexed document ids: some may be skipped, merged or overwritten.")
    return out, cover


def architecture(c: dict, table: str, metadata_mapped: bool, locator_mapped: bool, inconsistent: list[dict], mixed: list[dict], expected: Inventory | None, total: int, sampled: bool) -> tuple[list[Finding], float | None, float, bool]:
    """Findings, coverage (null: no signal), share of very large chunks, and whether the table is empty."""
    out, cover = inventory(expected, total)
    scanned = c["scanned"]

    def add(severity: str, title: str, evidence: dict, kind: str, text: str, affected: int = 1) -> None:
        out.append(Finding("architecture", severity, title, evidence, repair(kind, text), affected))

    if not metadata_mapped:
        add("info", "No metadata column is mapped", {"table": table, "impact": "Metadata completeness and filters cannot be judged."}, "map_metadata", "Map the table's JSON metadata column if it has one.")
    if scanned == 0:
        add("critical", "Mapped chunk table is empty", {"table": table, "scannedChunks": 0, "totalChunks": total}, "verify_ingestion", "Make sure that ingestion wrote chunks to this table before retrieval is tested.")
        return out, min(0, cover), 0.0, True
    seen, n_mixed = {"scannedChunks": scanned}, c.get("mixed_keys", len(mixed))
    tail = {"sampled": sampled}
    large = H.pct(c["large"], scanned)
    if large >= LARGE_PCT:
        evidence = seen | {"largeChunks": c["large"], "largePct": H.rounded(large, 1), "thresholdChars": LARGE_CHARS, "p50Chars": c["p50_chars"], "p95Chars": c["p95_chars"], "maxChars": c["max_chars"]} | tail
        add("warning", "Many chunks are very large", evidence, "review_chunking", "Split smaller: a passage is hard to find in a very large chunk, and it fills the context.", c["large"])
    missing = H.pct(c["missing_metadata"], scanned)
    if metadata_mapped and missing >= MISSING_METADATA_PCT:
        add("warning", "Metadata is missing on many chunks", seen | {"missingMetadataChunks": c["missing_metadata"], "missingPct": H.rounded(missing, 1)} | tail, "backfill_metadata", "Fill in source and document metadata so that filters and audits work.", c["missing_metadata"])
    if metadata_mapped and inconsistent:
        keys = [{"key": k["key"], "presentPct": k["present_pct"], "missingPct": k["missing_pct"], "presentRows": k["present_rows"]} for k in inconsistent]
        add("info", "Metadata keys are inconsistent across chunks", seen | {"keys": keys} | tail, "standardize_metadata", "Write the same top-level keys for every chunk.", c.get("inconsistent_keys", len(keys)))
    if metadata_mapped and mixed:
        keys = [{"key": k["key"], "rows": k["rows"], "types": {t["kind"]: t["n"] for t in k["types"]}} for k in mixed]
        add("warning", "Metadata filter fields use mixed value types", seen | {"keys": keys} | tail, "normalize_metadata_types", "Write each key with one type of value, or filters miss rows silently.", n_mixed)
    located = H.pct(c["source_rows"], scanned)
    if located < LOCATED_PCT:
        none = c["source_rows"] == 0
        title = "No source or citation locator was found" if none else "Source/citation locator is missing on many chunks"
        evidence = seen | {"sourceLocatorRows": c["source_rows"], "sourceLocatorPct": H.rounded(located, 1), "mappedSourceLocator": locator_mapped, "checkedMetadataKeys": sorted(SOURCE_KEYS)} | tail
        add("warning" if none else "info", title, evidence, "add_source_locator", "Keep a URL, a file path or a document id with each chunk so that answers can cite it.", scanned - c["source_rows"])
    tables, lost = c["table_like"], c["table_like_unlocated"]
    lost_pct = H.pct(lost, tables)
    if tables >= TABLE_MIN and H.pct(tables, scanned) >= TABLE_PCT and lost_pct >= TABLE_UNLOCATED_PCT:
        evidence = seen | {"tableLikeChunks": tables, "tableLikePct": H.rounded(H.pct(tables, scanned), 1), "tableLikeWithoutLocator": lost, "tableLikeWithoutLocatorPct": H.rounded(lost_pct, 1), "checkedMetadataKeys": sorted(STRUCTURED_KEYS)} | tail
        add("warning", "Table-like chunks are missing source/citation locators", evidence, "add_structured_locators", "Keep page, sheet, row or slide with chunks of tables so that a record can be found again.", lost)
    table_cover = H.whole(100 - lost_pct) if tables and lost_pct >= TABLE_UNLOCATED_PCT else 100
    place_cover = H.whole(located) if located < LOCATED_PCT else 100
    least = min(table_cover, cover, place_cover)
    if metadata_mapped:
        return out, min(max(0, H.whole(100 - missing - MIXED_COST * n_mixed)), least), large, False
    return out, least if least < 100 or located < LOCATED_PCT else None, large, False


def catalog(table: str, embedding: str, rows: int, indexes: list[IndexInfo] | None, other_vectors: list[str], markers: list[str], marked: int, total: int) -> list[Finding]:
    """Signals of the table's schema. indexes null: the store has no approximate indexes to speak of, so none is missed."""
    out: list[Finding] = []

    def add(severity: str, title: str, evidence: dict, kind: str, text: str, affected: int = 1) -> None:
        out.append(Finding("architecture", severity, title, evidence, repair(kind, text), affected))

    name = embedding.split(".")[-1]
    own = [i for i in indexes or [] if name in i.columns]
    found = any(i.method in ANN_METHODS for i in own)
    if indexes is not None and not found and rows >= INDEX_INFO_ROWS:
        heavy = rows >= INDEX_WARNING_ROWS
        title = "Mapped embedding column has no approximate vector index" + ("" if heavy else " yet")
        evidence = {"table": table, "embeddingColumn": name, "estimatedRows": rows, "existingIndexMethods": list(dict.fromkeys(i.method for i in own))}
        add("warning" if heavy else "info", title, evidence, "add_vector_index", "Build an HNSW or IVFFlat index once the table is large enough for approximate search.")
    if other_vectors:
        evidence = {"table": table, "mappedEmbeddingColumn": name, "otherVectorColumns": other_vectors}
        add("info", "Mapped table has multiple vector columns", evidence, "verify_embedding_column", "Make sure that retrieval uses the mapped vector column, above all after a change of models.", len(other_vectors))
    if marked:
        evidence = {"table": table, "markerColumns": sorted(markers), "markedRows": marked, "totalRows": total, "markedPct": H.rounded(H.pct(marked, total), 1)}
        add("warning", "Rows marked deleted or archived are still in the mapped chunk table", evidence, "verify_deletion_sync", "Make sure that retrieval leaves out rows marked deleted or archived, or remove their chunks.", marked)
    elsewhere = [i for i in indexes or [] if i.method in ANN_METHODS and name not in i.columns and set(i.columns) & set(other_vectors)]
    if elsewhere and not found:
        evidence = {"table": table, "mappedEmbeddingColumn": name, "indexedVectorColumns": [{"index": i.name, "method": i.method, "columns": i.columns} for i in elsewhere]}
        add("warning", "Vector index exists on a different embedding column", evidence, "verify_embedding_index", "Make sure that the mapped column and the index that retrieval uses are the same.", len(elsewhere))
    return out
