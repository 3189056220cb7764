"""Detectors from outside, freshness by source, deltas of reports, index relations."""

import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import freshness
from evidentia.plans import delta, report
from evidentia.plans import findings as N
from evidentia.plans.detectors import Detector, DetectorError
from evidentia.plans.scan import Limits, scan
from evidentia.sources.indexes import described
from evidentia.sources.mapping import Mapping

SCHEMA = "id long, content string, embedding array<float>, url string, updated_at timestamp"
TEXT = "A sentence that is long enough to be no thin chunk, as it says something of {} and goes on until it is done, which is here."
MAPPING = Mapping.of("public.chunks", "content", "embedding", None, None, "url", "updated_at")


def table(spark, rows):
    return spark.createDataFrame([(i, TEXT.format(what), [float(i), 1.0], url, at) for i, what, url, at in rows], SCHEMA).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def rows(n=30):
    from datetime import datetime

    return [(i, f"item {i}" if i % 3 else f"item 2024{i}", f"https://s{i % 4}.org" if i % 5 else None, datetime(2024, 1, 1 + i % 20) if i % 7 else None) for i in range(n)]


def numbers(cost=7.0, kind="architecture"):
    told = lambda v, s: [N.Finding(kind, "info", "Chunks hold years", {"chunks": v["n"], "of": s.scanned}, None, v["n"])] if v["n"] else []
    return Detector("years", {"n": F.count_if(F.col("has_year")), "longest": F.max("length")}, told, {"has_year": F.col("content_sample").rlike("2024")}, lambda v, s: {"quality": cost})


def jobs(spark, run):
    group = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return out, n


def test_a_detector_from_outside(spark):
    df = table(spark, rows())
    plain, n = jobs(spark, lambda: scan(df, MAPPING, "id", limits=Limits(None, 5)))
    more, m = jobs(spark, lambda: scan(df, MAPPING, "id", limits=Limits(None, 5), detectors=[numbers()]))
    # It adds no pass: as many jobs, and a finding and points of its own.
    assert n == m
    (own,) = [f for f in more.findings if f.title == "Chunks hold years"]
    assert own.affected == 10 and own.evidence == {"chunks": 10, "of": 30} and len(more.findings) == len(plain.findings) + 1
    assert more.subscores["quality"] == plain.subscores["quality"] - 7 and more.score < plain.score
    stack = {"fingerprintHash": "x"}
    out = report.build(more, MAPPING, stack, "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:01+00:00")
    assert any(f["title"] == "Chunks hold years" for f in out["findings"])
    # Points do not go below nothing.
    assert scan(df, MAPPING, "id", limits=Limits(None, 5), detectors=[numbers(1000)]).subscores["quality"] == 0
    assert [f for f in scan(df.where("false"), MAPPING, "id", detectors=[numbers()]).findings if f.title == "Chunks hold years"] == []


def test_detectors_that_are_refused(spark):
    df = table(spark, rows(3))
    bad = [
        lambda: Detector("a b", {"n": F.count("*")}, lambda v, s: []), lambda: Detector("a", {}, lambda v, s: []), lambda: scan(df, MAPPING, "id", detectors=[numbers(), numbers()]),
        lambda: scan(df, MAPPING, "id", detectors=[Detector("a", {"n": F.count("*")}, lambda v, s: [], {"length": F.lit(1)})]),
        lambda: scan(table(spark, rows(30)), MAPPING, "id", limits=Limits(None, 2), detectors=[numbers(kind="nonsense")]),
        lambda: scan(df, MAPPING, "id", limits=Limits(None, 2), detectors=[Detector("a", {"n": F.count("*")}, lambda v, s: [], costs=lambda v, s: {"beauty": 1})]),
    ]
    for make in bad:
        with pytest.raises(DetectorError):
            make()


def test_stale_by_source(spark):
    df = table(spark, rows())
    seen = [("https://s1.org", "etag", "2024-01-05T00:00:00Z", True), ("https://s1.org", "etag", "2024-01-10T00:00:00Z", True), ("https://s1.org", "etag", "2024-01-19T00:00:00Z", False), (" https://s2.org ", "etag", "2024-01-15T00:00:00Z", True), ("https://s3.org", "etag", "no time", True), (None, "etag", "2024-01-30T00:00:00Z", True)]
    seen = spark.createDataFrame(seen, "locator string, signal_kind string, observed_at string, changed boolean")
    got = {int(r["ref"]): r for r in freshness.stale_by_source(df, MAPPING, "id", seen).collect()}
    limit = {1: 10, 2: 15}
    for i, _, url, at in rows():
        source = i % 4 if i % 5 else None
        assert (got[i]["locator_hash"] is None) == (url is None)
        assert got[i]["stale"] == bool(source in limit and at is not None and at.day < limit[source]), i
    known = freshness.stale_by_source(df, MAPPING, "id", seen, F.lit("2024-01-06").cast("timestamp")).where("stale")
    assert all(r["changed_at"].day == 5 for r in known.collect()) and known.count() < sum(r["stale"] for r in got.values())
    sources = {r["locator_hash"]: r for r in freshness.stale_sources(freshness.stale_by_source(df, MAPPING, "id", seen)).collect()}
    assert len(sources) == 2 and sum(r["stale"] for r in sources.values()) == sum(r["stale"] for r in got.values())
    # In a scan, each chunk is measured against its own source; the list measures all against the newest change.
    result = scan(df, MAPPING, "id", limits=Limits(None, 2), snapshots=seen)
    stale = sum(r["stale"] for r in got.values())
    assert [f.affected for f in result.findings if f.type == "stale_document"] == [stale] and sum(f.type == "stale_source" for f in result.findings) == 2
    listed = scan(df, MAPPING, "id", limits=Limits(None, 2), snapshots=[N.Snapshot("https://s2.org", "etag", "1", "2024-01-15T00:00:00Z", True)])
    assert [f.affected for f in listed.findings if f.type == "stale_document"][0] > stale


def test_very_many_snapshots(spark):
    """A hundred thousand snapshots, most of one source: combined by Spark; a report lists the first and counts the others."""
    seen = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, "https://s1.org").otherwise(F.concat(F.lit("https://x.org/"), F.col("id") % 2000)).alias("locator"), F.lit("etag").alias("signal_kind"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id)").alias("observed_at"), F.lit(True).alias("changed"))
    n = freshness.latest_changes(seen).count()
    result = scan(table(spark, rows()), MAPPING, "id", limits=Limits(None, 2), snapshots=seen)
    assert sum(f.type == "stale_source" for f in result.findings) == 500 and [u.findings for u in result.unlisted if u.type == "stale_source"] == [n - 500]
    assert any(a["n"] == n for a in report.ranked([f.to_dict() for f in result.findings], [u.to_dict() for u in result.unlisted]))


def test_delta(spark):
    def told(n, **more):
        return report.build(scan(table(spark, rows(n)), MAPPING, "id", limits=Limits(None, 2), **more), MAPPING, {"fingerprintHash": "x"}, "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:01+00:00")

    changed = [N.Snapshot("https://secret.example/path", "etag", "1", "2024-01-09T00:00:00Z", True)]
    old, new = told(30), told(25, snapshots=changed, detectors=[numbers()])
    rows_of = [delta.rows(spark, r) for r in (old, new)]
    got = {(r["action"], r["subject"]): r for r in delta.between(*rows_of).collect()}
    status = {a: r["status"] for (a, _), r in got.items()}
    assert status["stale_source:Source changed since last scan"] == "new" and status["architecture:Chunks hold years"] == "new"
    assert {r["status"] for r in delta.between(rows_of[0], rows_of[0]).collect()} <= {"same"}
    back = {(r["action"], r["subject"]): r["status"] for r in delta.between(rows_of[1], rows_of[0]).collect()}
    assert all({"new": "gone", "gone": "new"}.get(r["status"], r["status"]) == back[k] for k, r in got.items())
    assert delta.between(rows_of[0].where("false"), rows_of[0].where("false")).count() == 0
    assert not re.search("secret.example", str(got))
    assert delta.with_delta(new, old)["health"]["delta"] == {"previousScore": old["health"]["score"], "previousScanAt": old["scan"]["finishedAt"]}


def test_index_relations(spark):
    indexes = [
        ("t", "plain", "hnsw", [2], 1, [10], []), ("t", "cast", "hnsw", [0], 1, [11], ["((embedding)::vector(1536))"]), ("t", "wide", "btree", [3, 0, 1, 2], 2, [12, 13], ["lower(body)"]),
        ("t", "gone", "btree", [9], 1, [12], []), ("u", "none", "btree", [], 0, [], []), ("u", "null", "btree", None, None, None, None),
    ]
    df = spark.createDataFrame(indexes, "table_name string, name string, method string, keys array<int>, key_count int, opclass_ids array<long>, expressions array<string>")
    attributes = spark.createDataFrame([("t", 1, "id"), ("t", 2, "embedding"), ("t", 3, "tenant"), ("u", 1, "other")], "table_name string, attnum int, attname string")
    classes = spark.createDataFrame([(10, "vector_cosine_ops"), (11, "vector_l2_ops"), (12, "int8_ops"), (13, "text_ops")], "opclass_id long, opclass string")
    got = {r["name"]: (r["columns"], r["included"], r["opclasses"], r["expressions"]) for r in described(df, attributes, classes).collect()}
    assert got == {
        "plain": (["embedding"], [], ["vector_cosine_ops"], []), "cast": ([], [], ["vector_l2_ops"], ["((embedding)::vector(1536))"]), "wide": (["tenant"], ["id", "embedding"], ["int8_ops", "text_ops"], ["lower(body)"]),
        "gone": ([], [], ["int8_ops"], []), "none": ([], [], [], []), "null": ([], [], [], []),
    }


def test_a_detector_sees_whole_texts(spark):
    """With whole texts asked for, what stands behind the first 500 characters is seen by detectors too."""
    df = spark.createDataFrame([(1, "Words. " * 100 + "2024", [1.0]), (2, "Words. " * 100, [2.0])], "id long, content string, embedding array<float>")
    mapping = Mapping.of("public.chunks", "content", "embedding")
    told = [[f.affected for f in scan(df, mapping, "id", limits=limits, detectors=[numbers()]).findings if f.title == "Chunks hold years"] for limits in (Limits(None, 1), Limits(None, 1, whole_texts=True))]
    assert told == [[], [1]]
