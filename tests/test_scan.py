import json

import pytest
from fixtures import SCHEMA, healthy, rotten, row, unit

from evidentia import queries
from evidentia.plans import findings as N
from evidentia.plans import health as H
from evidentia.plans import render, report, sync, telemetry
from evidentia.plans.scan import Limits, scan
from evidentia.sources.mapping import Mapping

BARE = {"fingerprintHash": "0" * 64, "frameworkGuess": "langchain", "embeddingDims": 64, "embeddingModelGuess": None}


def run(spark, rows, mapping, **more):
    return scan(spark.createDataFrame(rows, SCHEMA), mapping, "id", **more)


@pytest.fixture(scope="module")
def planted(spark):
    return run(spark, rotten(), Mapping.of("public.chunks", "text", "embedding", "meta", sourceUrl="meta:meta.source"))


def test_planted_counts_and_score(planted):
    s = planted.stats
    assert (s["exactDuplicateGroups"], s["exactDuplicateRows"], s["nearDuplicatePairs"], s["thinChunks"], s["riskyCritical"]) == (10, 30, 20, 25, 3)
    assert planted.score == 73
    shown = {k: None if v is None else H.whole(v) for k, v in planted.subscores.items()}
    assert shown == {"freshness": None, "duplication": 58, "quality": 83, "risk": 25, "coverage": 100}
    assert sum(f.severity == "critical" for f in planted.findings) == 4
    assert sum(f.severity == "warning" for f in planted.findings) == 31


def test_no_text_or_secret_leaks(planted):
    out = json.dumps([f.to_dict() for f in planted.findings])
    assert "harbour" not in out and "a1B2" not in out and "ABCDEFGH" not in out and "example.org" not in out
    assert "sk-a…" in json.loads(json.dumps([f.evidence for f in planted.findings if f.type == "risky_chunk"]))[0]["matches"][0]["redacted"]


def test_report_renders(planted):
    mapping = Mapping.of("public.chunks", "text", "embedding", "meta", sourceUrl="meta:meta.source")
    out = report.build(planted, mapping, BARE, "2024-01-01T00:00:00+00:00", "2024-01-01T00:01:00+00:00", [{"locator": "https://example.org/x", "kind": "website"}], "0.1.0")
    assert out["sources"][0]["locator"].startswith("https source sha256:")
    assert report.validate(json.loads(render.as_json(out))) == out
    text, page = render.as_text(out), render.as_html(out)
    assert "73/100" in text and "noticeable" in text and "CRITICAL (4)" in text and "+26 more" not in page
    assert "example.org" not in text + page and "<script" not in page and "src=" not in page
    assert [a["rank"] for a in out["nextActions"]] == [1, 2, 3, 4, 5]
    held = telemetry.build(out)
    assert held["mappingShape"]["id"] == "manual" and telemetry.validate(json.loads(telemetry.serialize(held))) == held
    with pytest.raises(ValueError, match="telemetry"):
        telemetry.validate(held | {"extra": 1})
    assert sync.request(out)["report"] == out
    answer = {"scanId": out["scan"]["id"], "dashboardUrl": "https://example.org/s/1", "delta": {"previousScore": 70, "previousScanAt": "2024-01-01T00:00:00Z"}}
    assert sync.response(answer) == answer
    for bad in ({}, answer | {"scanId": "1"}, answer | {"dashboardUrl": "x"}, answer | {"delta": {"previousScore": 101}}):
        with pytest.raises(report.ReportError):
            sync.response(bad)
    out["findings"][0]["severity"] = "odd"
    with pytest.raises(report.ReportError):
        report.validate(out)


def test_empty_table(spark):
    out = run(spark, [], Mapping.of("public.chunks", "text", "embedding", "meta"))
    assert out.score == 43 and out.subscores["coverage"] == 0 and out.subscores["quality"] == 0
    assert any(f.severity == "critical" and f.title == "Mapped chunk table is empty" for f in out.findings)


def test_dims_and_nulls(spark):
    rows = [row(0, healthy(0), unit(0, 3)), row(1, healthy(1), unit(1, 4)), row(2, healthy(2), None), row(3, None, unit(2, 3)), row(4, "", unit(3, 3))]
    out = run(spark, rows, Mapping.of("public.chunks", "text", "embedding"))
    mixed = next(f for f in out.findings if f.type == "embedding_mixed_dims")
    assert mixed.evidence["dimensions"] == [{"dims": 3, "count": 3}, {"dims": 4, "count": 1}] and mixed.affected == 4
    assert out.stats["nullEmbeddings"] == 1 and out.stats["exactDuplicateRows"] == 2  # null and empty content are one group


def test_mixed_and_missing_metadata(spark):
    rows = [row(i, healthy(i), unit(i), {"score": i if i % 2 else str(i), "region": 1} if i < 10 else None) for i in range(12)]
    out = run(spark, rows, Mapping.of("public.chunks", "text", "embedding", "meta"))
    mixed = next(f for f in out.findings if f.title == "Metadata filter fields use mixed value types")
    key = mixed.evidence["keys"][0]
    assert key["key"].startswith("sha256:") and key["rows"] == 10 and key["types"] == {"number": 5, "string": 5}
    assert out.subscores["coverage"] == 0  # no locator at all


def test_sampling_keeps_totals(spark):
    rows = [row(i, healthy(i), unit(i)) for i in range(30)]
    out = run(spark, rows, Mapping.of("public.chunks", "text", "embedding"), limits=Limits(10, 5), system="s")
    again = run(spark, rows, Mapping.of("public.chunks", "text", "embedding"), limits=Limits(10, 5), system="s")
    assert out.stats == again.stats and out.stats["totalChunks"] == 30


@pytest.mark.parametrize(
    ("subs", "want"),
    [((100, 100, 100, 100, 100), 100), ((0, 0, 0, 0, 0), 0), ((None, 58.05, 83.22, 25, 100), 73), ((None, 100, 0, 100, 0), 43), ((50, 100, 100, 25, None), 72)],
)
def test_score(subs, want):
    assert H.score(dict(zip(H.WEIGHTS, subs, strict=True))) == want


def test_rounding():
    assert (H.rounded(1.005, 2), H.rounded(2.5), H.rounded(0.25, 1), H.whole(77.5), H.whole(-0.5)) == (1, 3, 0.3, 78, 0)


def counts(**more):
    base = dict.fromkeys(["short", "link_density", "mid_sentence", "critical", "warning", "missing_timestamps", "measured", "stale", "null_embeddings", "large", "missing_metadata", "table_like", "table_like_unlocated"], 0)
    return base | {"scanned": 100, "source_rows": 100, "max_chars": 10, "p50_chars": 5, "p95_chars": 9} | more


def test_thresholds_on_both_sides():
    assert N.exact([], 1, 5, 100, False)[0] == [] and len(N.exact([], 1, 6, 100, False)[0]) == 1
    assert N.thin([{"ref": "a", "thin_reason": "short", "length": 1}], counts(short=15), 100, False)[0][0].severity == "info"
    assert N.thin([{"ref": "a", "thin_reason": "short", "length": 1}], counts(short=16), 100, False)[0][0].severity == "warning"
    assert N.thin([], counts(mid_sentence=19), 100, False)[0] == [] and len(N.thin([], counts(mid_sentence=20), 100, False)[0]) == 1
    assert N.thin([], counts(mid_sentence=7), 20, False)[0] == []
    titles = lambda c: [f.title for f in N.architecture(c, "t", True, True, [], [], None, 100, False)[0]]
    assert titles(counts(large=19)) == [] and titles(counts(large=20)) == ["Many chunks are very large"]
    assert titles(counts(missing_metadata=20)) == ["Metadata is missing on many chunks"]
    assert titles(counts(source_rows=80)) == [] and titles(counts(source_rows=79)) == ["Source/citation locator is missing on many chunks"]
    assert titles(counts(table_like=10, table_like_unlocated=5)) == ["Table-like chunks are missing source/citation locators"] and titles(counts(table_like=10, table_like_unlocated=4)) == []


def test_freshness():
    snap = [N.Snapshot("https://a", "etag", "1", "2024-01-02T00:00:00Z", True), N.Snapshot("https://b", "etag", "1", "2024-01-02T00:00:00Z", False)]
    found, share = N.freshness(counts(measured=50, missing_timestamps=50, stale=10), "t", True, snap, False)
    assert share == 60 and [f.type for f in found] == ["stale_source", "architecture", "stale_document"] and "https" not in json.dumps(found[0].to_dict())
    found, share = N.freshness(counts(missing_timestamps=100), "t", True, [], False)
    assert share is None and found[0].title == "Mapped timestamp column is empty"
    found, share = N.freshness(counts(), "t", False, [], False)
    assert share is None and found[0].repair["sql"] == "ALTER TABLE t ADD COLUMN updated_at timestamptz default now();"


def test_inventory():
    assert N.inventory(N.Inventory(5, None), 2)[0][0].severity == "critical" and N.inventory(N.Inventory(5, None), 2)[1] == 40
    found, cover = N.inventory(N.Inventory(None, 10, 8), 100)
    assert (found[0].severity, found[0].affected, cover) == ("warning", 2, 80)
    assert N.inventory(N.Inventory(None, 10, None), 100)[0][0].severity == "info"
    with pytest.raises(ValueError, match="inventory"):
        N.Inventory()


def test_catalog_signals():
    found = N.catalog("t", "embedding", 1000, [N.IndexInfo("i", "hnsw", ["other"])], ["other"], ["deleted_at"], 16, 64)
    assert [(f.severity, f.repair["kind"]) for f in found] == [("warning", "add_vector_index"), ("info", "verify_embedding_column"), ("warning", "verify_deletion_sync"), ("warning", "verify_embedding_index")]
    assert found[2].evidence["markedPct"] == 25
    assert N.catalog("t", "embedding", 99, [], [], [], 0, 0) == [] and N.catalog("t", "embedding", 10**9, None, [], [], 0, 0) == []


def test_actions_group_and_rank():
    f = lambda kind, severity, what, affected: {"type": kind, "severity": severity, "title": f"{kind} {severity}", "suggestedRepair": {"kind": what} if what else None, "affectedCount": affected}
    held = [f("thin_chunk", "info", None, 1), f("exact_duplicate", "warning", None, 3), f("exact_duplicate", "critical", None, 9), f("architecture", "warning", "x", 50), f("architecture", "info", "x", 1)]
    out = report.next_actions(held)
    assert [a["findingRefs"] for a in out] == [[1, 2], [3, 4], [0]] and out[0]["title"] == "exact_duplicate critical"


def test_counts_are_of_all_exact_groups(spark, monkeypatch):
    """Groups beyond those that a report lists count in the queries, the report's numbers, actions and telemetry."""
    mapping = Mapping.of("public.chunks", "text", "embedding", "meta", sourceUrl="meta:meta.source")

    def shown(result):
        monkeypatch.setattr(queries, "whole_scan", lambda *_: result)
        return [sorted(map(tuple, f(spark, "").collect())) for f in (queries.findings_by_type, queries.next_actions, queries.flagship)]

    whole = run(spark, rotten(), mapping)
    monkeypatch.setattr("evidentia.plans.scan.GROUP_FINDINGS", 3)
    cut = run(spark, rotten(), mapping)
    groups = lambda r: [f for f in r.findings if f.type == "exact_duplicate" and not f.evidence.get("summary")]
    assert (len(groups(whole)), len(groups(cut))) == (10, 3) and cut.score == whole.score
    assert not any("truncatedFindings" in f.evidence for f in groups(whole)) and all(f.evidence["truncatedFindings"] for f in groups(cut))
    assert shown(cut) == shown(whole)
    full, part = (report.build(r, mapping, BARE, "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:01+00:00") for r in (whole, cut))
    assert "unlisted" not in full and [(u["type"], u["findings"]) for u in part["unlisted"]] == [("exact_duplicate", 7)]
    assert telemetry.build(part)["findingCounts"] == telemetry.build(full)["findingCounts"]
    assert [a["title"] for a in part["nextActions"]] == [a["title"] for a in full["nextActions"]]
    assert report.severity_count(part, "warning") == report.severity_count(full, "warning") == 31 and "exact_duplicate  … +7 more" in render.as_text(part)


def test_only_neighbours_texts_are_hashed(spark):
    """A search hashes the texts of probes and neighbours, and a scan none that it has hashed already."""
    from pyspark.sql import functions as F

    from evidentia.operators import knn
    from evidentia.sources.chunks import chunk_view

    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    plain = spark.createDataFrame([(i, f"Text {i} of some length.", [float(i % 7), 1.0 + i]) for i in range(300)], "id long, content string, embedding array<float>")
    table = plain.withColumn("content", F.udf(told, "string")("content"))
    mapping = Mapping.of("public.chunks", "content", "embedding")
    want = sorted(tuple(r) for r in knn.nearest_neighbors(chunk_view(plain, mapping, "id"), 3).collect())
    assert sorted(tuple(r) for r in knn.nearest_neighbors(chunk_view(table, mapping, "id"), 3).collect()) == want and len(want) == 3
    assert seen.value <= 6
    seen.value = 0
    scan(table, mapping, "id", limits=Limits(None, 3))
    assert seen.value <= 300


def test_a_whole_scan_drops_nothing(spark, monkeypatch):
    """Every chunk is a probe, texts are judged to their end, and rows beyond those listed count in queries and actions."""
    from evidentia.plans.scan import WHOLE

    late = lambda i: healthy(i) + f" Filler words of number {i} that say little. " * 20
    rows = [row(i, late(i), unit(i, 40)) for i in range(40)] + [row(100 + i, f"short {i}", unit(i % 4, 41)) for i in range(5)] + [row(200 + i, late(50 + i) + "TODO: more.", None) for i in range(3)]
    # Two that are alike at the end of the table, where two probes do not come.
    rows.append(row(300, late(300), [2 * x for x in unit(39, 40)]))
    monkeypatch.setattr("evidentia.plans.scan.ROW_FINDINGS", 2)
    mapping = Mapping.of("public.chunks", "text", "embedding", "meta")
    some, whole = (run(spark, rows, mapping, limits=x) for x in (Limits(None, 2), WHOLE))
    count = lambda r, kind: sum(f.type == kind for f in r.findings) + sum(u.findings for u in r.unlisted if u.type == kind)
    assert [count(some, k) for k in ("near_duplicate", "thin_chunk", "risky_chunk")] == [0, 2, 0]
    assert whole.stats["nearDuplicatePairs"] == count(whole, "near_duplicate") > 0 and [count(whole, k) for k in ("thin_chunk", "risky_chunk")] == [5, 3]
    assert {"39", "300"} in [set(f.evidence["refs"]) for f in whole.findings if f.type == "near_duplicate"]
    held = {a["title"]: a["n"] for a in report.ranked([f.to_dict() for f in whole.findings], [u.to_dict() for u in whole.unlisted])}
    assert held["Chunk contains a risk marker"] == 3 and next((n for t, n in held.items() if t.startswith("Thin")), 5) == 5
    monkeypatch.setattr(queries, "whole_scan", lambda *_: whole)
    assert {r["type"]: r["n"] for r in queries.findings_by_type(spark, "").collect() if r["type"] in ("thin_chunk", "risky_chunk")} == {"thin_chunk": 5, "risky_chunk": 3}


def test_all_near_equals_all_pairs(spark, monkeypatch):
    """Blocks and tiles of few rows tell what one look at all pairs tells: lengths, copies, ties, names, and vectors without likenesses."""
    import numpy as np

    from evidentia.operators import knn
    from evidentia.sources.chunks import chunk_view

    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 6))
    vectors = [[float(x) for x in base[rng.integers(30)] + rng.normal(size=6) * 0.05 * rng.integers(3)][: 6 if rng.random() < 0.8 else 3] for _ in range(300)]
    vectors += [[0.0] * 6, [float("nan")] + [1.0] * 5, None, [], [1.0] * 9]
    rows = [(i, f"text {i}", v) for i, v in enumerate(vectors)]
    view = chunk_view(spark.createDataFrame(rows, "id long, content string, embedding array<double>"), Mapping.of("public.chunks", "content", "embedding"), "id")
    for name, value in (("BLOCK_ROWS", 40), ("TILE", 16)):
        monkeypatch.setattr(knn, name, value)
    found, probes = knn.all_near(view, 0.97)
    got = {r["ref"]: (r["neighbor_ref"], round(r["similarity"], 9)) for r in found.collect()}
    held = knn.nearest_neighbors(view, len(rows)).collect()
    assert got == {r["ref"]: (r["neighbor_ref"], round(r["similarity"], 9)) for r in held if r["similarity"] >= 0.97} and 100 < len(got) < 302
    assert probes == len(held)
