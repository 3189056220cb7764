"""The inverted file: recall against the exact operator, lists read, appended chunks, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import ivf, knn
from evidentia.plans.scan import Limits, scan
from evidentia.sources.mapping import Mapping
from evidentia.stores import vectors as vectors_store

CHUNKS = "ref string, ord long, content_hash string, embedding array<float>"


def clustered(n, d, groups, seed, start=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(groups, d))
    return [(f"r{i + start}", i + start, f"h{i + start}", (centres[rng.integers(groups)] + rng.normal(size=d) * 0.3).astype("float32").tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(clustered(4000, 16, 60, 2) + [(f"s{i}", 10_000 + i, f"g{i}", v[3][:8]) for i, v in enumerate(clustered(300, 16, 5, 3))], CHUNKS).repartition(5)


def exact(chunks, probes):
    return knn.nearest_neighbors(chunks, probes)


def test_recall_and_exact_likeness(spark, chunks, tmp_path):
    index = ivf.fit(chunks)
    assert {d: len(m) for d, m in index.centroids.items()} == {8: 17, 16: 63}
    vectors_store.write(index, chunks, str(tmp_path))
    again, vectors = vectors_store.read(spark, str(tmp_path))
    assert all(np.array_equal(again.centroids[d], m) for d, m in index.centroids.items())
    assert vectors.count() == 4300 and vectors.select("cell").distinct().count() <= 80
    probes = chunks.orderBy("ord").limit(400)
    found, best = ivf.nearest_neighbors(again, vectors, probes), exact(chunks, 400)
    assert ivf.recall(found, best) >= 0.9
    # Every likeness told is the exact one of the pair told.
    held = {r["ref"]: np.array(r["embedding"], float) for r in chunks.collect()}
    for r in found.collect():
        a, b = held[r["ref"]], held[r["neighbor_ref"]]
        assert r["ref"] != r["neighbor_ref"] and abs(a @ b / np.linalg.norm(a) / np.linalg.norm(b) - r["similarity"]) < 1e-9
    # Looking into all lists is the exact way.
    assert ivf.recall(ivf.nearest_neighbors(again, vectors, probes, look=10_000), best) == 1.0


def test_lists_are_tuned_where_vectors_form_no_groups(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"r{i}", i, "h", rng.normal(size=24).astype("float32").tolist()) for i in range(1500)], CHUNKS)
    index = ivf.fit(df)
    vectors = index.assign(df)
    look = ivf.tune(index, vectors, df.where("ord >= 1300"))
    assert look > ivf.LEAST
    assert ivf.recall(ivf.nearest_neighbors(index, vectors, df.where("ord < 300"), look), exact(df, 300)) >= 0.9


def test_few_probes_read_few_lists(spark, chunks, tmp_path):
    vectors_store.write(ivf.fit(chunks, lists=40), chunks, str(tmp_path))
    index, vectors = vectors_store.read(spark, str(tmp_path))
    probe = chunks.where("ord = 7")
    cells = index.nearest(np.array(probe.first()["embedding"], float))
    assert len(cells) == ivf.LEAST
    plan = vectors.where(F.col("cell").isin(cells))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert ivf.recall(ivf.nearest_neighbors(index, vectors, probe), exact(chunks, 8).where("ref = 'r7'")) == 1.0


def test_chunks_are_appended(spark, chunks, tmp_path):
    vectors_store.write(ivf.fit(chunks), chunks, str(tmp_path))
    index, _ = vectors_store.read(spark, str(tmp_path))
    more = spark.createDataFrame(clustered(500, 16, 60, 9, 50_000), CHUNKS)
    vectors_store.write(index, more, str(tmp_path), mode="append")
    _, vectors = vectors_store.read(spark, str(tmp_path))
    assert vectors.count() == 4800
    best = exact(chunks.unionByName(more.withColumn("ord", F.col("ord") - 100_000)), 500)
    assert ivf.recall(ivf.nearest_neighbors(index, vectors, more), best) >= 0.9


def test_same_table_same_index(chunks):
    one, two = ivf.fit(chunks), ivf.fit(chunks.repartition(3))
    assert all(np.allclose(one.centroids[d], two.centroids[d]) for d in one.centroids)


def test_odd_vectors(spark):
    rows = [("a", 1, "a", None), ("b", 2, "b", []), ("c", 3, "c", [0.0, 0.0]), ("d", 4, "d", [float("nan"), 1.0]), ("e", 5, "e", [None, 1.0]), ("f", 6, "f", [1.0, 0.0]), ("g", 7, "g", [2.0, 0.0]), ("h", 8, "h", [3.0]), (None, None, "i", [1.0, 0.5])]
    df = spark.createDataFrame(rows, CHUNKS)
    index = ivf.fit(df, lists=2)
    assert set(index.centroids) == {1, 2}
    vectors = index.assign(df)
    assert sorted(r["ref"] or "" for r in vectors.collect()) == ["", "f", "g", "h"]
    got = {r["ref"]: (r["neighbor_ref"], r["similarity"]) for r in ivf.nearest_neighbors(index, vectors.where("ref is not null"), df.where("ref is not null")).collect()}
    assert got == {"f": ("g", 1.0), "g": ("f", 1.0)}
    empty = ivf.fit(df.where("false"))
    assert empty.centroids == {} and empty.assign(df).count() == 0
    assert ivf.nearest_neighbors(empty, vectors, df).count() == 0


def test_scan_by_an_index(spark, chunks, tmp_path):
    """A scan that is given an index finds the same near duplicates, where they lie close."""
    twins = chunks.where("ord < 20").withColumns({"ref": F.concat(F.lit("t"), "ref"), "ord": F.col("ord") + 20_000, "content_hash": F.lit("t")})
    both = chunks.unionByName(twins)
    table = both.select(F.col("ord").alias("id"), F.concat(F.lit("Text of chunk number "), "ref", F.lit(" that is long enough to be no thin chunk at all, by any measure of a length of one hundred and twenty.")).alias("content"), "embedding")
    index = ivf.fit(both.withColumn("ref", F.col("ord").cast("string")))
    vectors_store.write(index, both.withColumn("ref", F.col("ord").cast("string")), str(tmp_path))
    mapping = Mapping.of("public.chunks", "content", "embedding")
    one, two = (scan(table, mapping, "id", limits=Limits(None, 100), index=kept) for kept in (None, vectors_store.read(spark, str(tmp_path))))
    assert one.stats["nearDuplicatePairs"] >= 20 and one.stats == two.stats and one.score == two.score


def test_probes_of_many_lists_are_sent_once(spark):
    """What goes to each task, and what a task gives back, does not grow with the lists that a probe looks into."""
    from pyspark import cloudpickle

    rng = np.random.default_rng(7)
    lists, d = 200, 32
    vectors = rng.normal(size=(600, d)).astype("float32")
    df = spark.createDataFrame([(f"r{i}", i, v.tolist(), i % lists) for i, v in enumerate(vectors)], "ref string, ord long, embedding array<float>, cell int").repartition(3)
    rows = [(f"r{i}", i, vectors[i].astype(float)) for i in range(100)]

    class Told:
        def mapInArrow(self, run, schema):
            self.sent = len(cloudpickle.dumps(run))
            self.given = df.mapInArrow(run, schema).count()
            return df.mapInArrow(run, schema)

    told = Told()
    got = {r["ref"]: (r["neighbor_ref"], r["similarity"]) for r in knn.best_of(spark, rows, [list(range(lists))] * 100, told).collect()}
    assert told.sent < 100 * (8 * d + 8 * lists) + 100_000 and told.given <= 3 * 100
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    likeness = unit[:100] @ unit.T
    likeness[np.arange(100), np.arange(100)] = -2
    assert all(got[f"r{i}"] == (f"r{likeness[i].argmax()}", pytest.approx(likeness[i].max(), abs=1e-11)) for i in range(100))
    # Equal likenesses over cells and batches: the first by order; lists that a probe does not ask for are not looked at.
    same = spark.createDataFrame([("a", 9, [1.0, 0.0], 1), ("b", 5, [2.0, 0.0], 2), ("c", 7, [3.0, 0.0], 0), ("d", 1, [1.0, 0.0], 3)], "ref string, ord long, embedding array<float>, cell int")
    for n in (1, 4):
        (r,) = knn.best_of(spark, [("p", 0, np.array([1.0, 0.0]))], [[0, 1, 2]], same.repartition(n)).collect()
        assert (r["neighbor_ref"], r["neighbor_ord"]) == ("b", 5)
