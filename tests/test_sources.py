import ast
import re
from pathlib import Path

import pytest
from fixtures import healthy, unit
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.operators import knn
from evidentia.sources import config as C
from evidentia.sources.catalog import Catalog, soft_delete_columns, soft_delete_counts
from evidentia.sources.chunks import chunk_view, deterministic_sample
from evidentia.sources.introspect import IntrospectError, Prompts, content_score, introspect, match_generic, model_guess, rows_score, table_score
from evidentia.sources.mapping import Mapping, MappingError, column_expr

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", ["content", "a_1", "schema.col", "meta:props.key", "meta:props.key.with.dots"])
def test_safe_names(spark, name):
    df = spark.createDataFrame([("x",)], "content string").withColumns({"a_1": F.lit("x"), "schema": F.struct(F.lit("x").alias("col")), "props": F.lit('{"key": "x", "key.with.dots": "x"}')})
    mapping = Mapping.of("t", name, "e")
    assert df.select(column_expr(mapping, "content", df).alias("x")).first()["x"] == "x"
    assert column_expr(mapping, "metadata", df) is None


@pytest.mark.parametrize("name", ["a b", "a;drop", 'a"b', "a`b", "a..b", ".a", "a.", "meta:a", "meta:.k", "meta:a.", "meta:a b.k", "meta:a.k'"])
def test_unsafe_names(spark, name):
    df = spark.createDataFrame([("x",)], "content string")
    with pytest.raises(MappingError):
        column_expr(Mapping.of("t", name, "e"), "content", df)


def test_mapping_round_trip():
    m = Mapping.of("t", "c", "e", "m", joins={"collectionTable": "x", "collectionFk": "y", "collectionNameColumn": "z"})
    assert Mapping.from_dict(m.to_dict()) == m
    for bad in ({}, m.to_dict() | {"version": 2}, m.to_dict() | {"dialect": "x"}, m.to_dict() | {"table": ""}, m.to_dict() | {"columns": {"content": "c"}}):
        with pytest.raises(MappingError):
            Mapping.from_dict(bad)


def test_view_kinds(spark):
    rows = [(1, "A", [1.0], '{"a": 1}', "2024-01-01", " "), (2, None, None, "[1]", "no time", None), (3, "b", [1.0, 2.0], "{}", None, "u"), (4, "b", [1.0], None, "", "u")]
    df = spark.createDataFrame(rows, "id long, c string, e array<float>, m string, u string, s string")
    out = chunk_view(df, Mapping.of("t", "c", "e", "m", None, "s", "u"), "id").orderBy("ord").collect()
    assert [r["embedding_dims"] for r in out] == [1, None, 2, 1]
    assert [r["metadata_keys"] for r in out] == [["a"], None, [], None]
    assert [r["updated_present"] for r in out] == [True, True, False, False] and [r["updated_at"] is None for r in out] == [False, True, True, True]
    assert [r["source_locator_present"] for r in out] == [False, False, True, True]
    bare = chunk_view(df, Mapping.of("t", "c", "e"), "id").first()
    assert bare["source_locator_present"] is None and bare["metadata"] is None


def test_sample_is_deterministic(spark):
    df = spark.range(100).select("id", F.lit("x").alias("c"), F.array(F.lit(1.0)).cast("array<float>").alias("e"))
    view = chunk_view(df, Mapping.of("t", "c", "e"), "id")
    pick = lambda n, seed: {r["ref"] for r in deterministic_sample(view.repartition(n), seed, 10).collect()}
    assert pick(1, "a") == pick(7, "a") != pick(3, "b")


def test_neighbors_by_blocks(spark, monkeypatch):
    rows = [(i, f"t{i}", [float(x) for x in unit(i, 8 if i % 3 else 5)]) for i in range(40)] + [(40, "t40", None), (41, "t41", [float(x) for x in unit(3, 5)]), (42, "lonely", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, c string, e array<float>").repartition(5)
    view = chunk_view(df, Mapping.of("t", "c", "e"), "id")
    want = knn.nearest_neighbors(view, 100).orderBy("ord").collect()
    monkeypatch.setattr(knn, "PROBE_BYTES", 500)
    assert knn.nearest_neighbors(view, 100).orderBy("ord").collect() == want
    assert len(want) == 41 and next(r for r in want if r["ref"] == "3")["neighbor_ref"] == "41"
    assert knn.near_pairs(knn.nearest_neighbors(view, 100), 0.999).count() == 1
    assert knn.nearest_neighbors(view.limit(0), 5).count() == 0


def candidates(spark):
    text = F.lit(healthy(1))
    vector = F.array(*map(F.lit, [0.1, 0.2])).cast("array<float>")
    return {
        "plain": spark.range(5).select("id", text.alias("content"), vector.alias("embedding"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata")),
        "two": spark.range(5).select("id", text.alias("body_text"), text.alias("summary"), vector.alias("vec")),
        "chain": spark.range(5).select(F.lit("c").alias("collection_id"), text.alias("document"), vector.alias("embedding"), F.lit('{"source": "a"}').alias("cmetadata")),
        "other": spark.range(5).select("id"),
    }


def test_introspection(spark):
    t = candidates(spark)
    docs = introspect(Catalog({"documents": t["plain"], "other": t["other"]}))
    assert (docs.recipe, docs.stack["frameworkGuess"], docs.stack["embeddingDims"]) == ("supabase-docs-tutorial", "generic", 2)
    chain = introspect(Catalog({"langchain_pg_embedding": t["chain"]}))
    assert chain.mapping.columns["sourceUrl"] == "meta:cmetadata.source" and chain.mapping.joins["collectionTable"] == "public.langchain_pg_collection"
    generic = introspect(Catalog({"document_chunks": t["plain"], "embedding_cache": t["plain"]}))
    assert generic.recipe == "generic-single-table" and generic.mapping.table == "public.document_chunks"
    unclear = Catalog({"kb_entries": t["two"]})
    assert match_generic(unclear, unclear.candidates()) is None
    with pytest.raises(IntrospectError):
        introspect(unclear)
    with pytest.raises(IntrospectError):
        introspect(Catalog({"other": t["other"]}))
    asked = introspect(unclear, Prompts(lambda m: True, lambda m, choices: choices[0], lambda m, choices: None))
    assert (asked.recipe, asked.mapping.columns["content"], asked.mapping.columns["embedding"]) == ("manual", "body_text", "vec")
    with pytest.raises(IntrospectError):
        introspect(unclear, Prompts(lambda m: False, lambda m, choices: choices[0], lambda m, choices: None))
    again = introspect(Catalog({"documents": t["plain"].select("metadata", "embedding", "content", "id"), "other": t["other"]}))
    assert again.stack["fingerprintHash"] == docs.stack["fingerprintHash"]


def test_scores():
    assert [content_score(n) for n in ("content", "text", "body", "chunk_text", "summary", "title", "content_hash", "x")] == [10, 9, 6, 6, 3, 0, 0, 2]
    assert [table_score(n) for n in ("document_chunks", "documents", "kb_documents", "my_chunks", "embedding_cache", "x")] == [10, 7, 5, 5, -12, 0] and table_score("tool_chunks", ("tool_",)) == -5
    assert [rows_score(n) for n in (None, 0, 1, 100, 1000, 10_000)] == [0, 0, 1, 3, 4, 5]
    assert model_guess(None) is None and model_guess(5) == "unknown model (guess)" and "3-large" in model_guess(3072)


def test_small_looks(spark):
    t = candidates(spark)
    held = Catalog({"documents": t["plain"], "a.b": t["chain"]})
    assert held.json_keys("documents", "metadata") == ["k"] and held.json_keys("a.b", "cmetadata") == ["source"]
    assert held.average_length("documents", "content") > 80 and len(held.sample_rows("documents", ["id"])) == 3
    assert held.has_embeddings("documents", "embedding") and held.count("documents") == 5
    with pytest.raises(KeyError):
        held.frame("none")


def test_soft_delete(spark):
    df = spark.createDataFrame([(1, None, True, "x"), (2, None, None, "x"), (3, None, False, None)], "id long, deleted_at timestamp, archived boolean, removed_at string")
    assert soft_delete_columns(df) == ["deleted_at", "archived"] and soft_delete_counts(df) == (1, 3)


def test_config(tmp_path):
    assert C.load(tmp_path) is None
    base = {"version": 1, "system": {"name": "s"}, "connection": {"env": "E"}}
    C.save(base, tmp_path)
    held = C.load(tmp_path)
    assert held["telemetryConfigured"] is False and held["telemetry"] is False
    C.save(base | {"telemetry": True, "inventory": {"minChunks": 1}, "thresholds": {"linkNavDensity": 0.5}, "mapping": Mapping.of("t", "c", "e").to_dict()}, tmp_path)
    assert C.load(tmp_path)["telemetryConfigured"] is True
    for bad in ({}, base | {"inventory": {}}, base | {"thresholds": {"linkNavDensity": 2}}, base | {"thresholds": {"maxChunks": 0}}, base | {"sources": [{"kind": "x", "locator": "y"}]}, base | {"connection": {"env": ""}}):
        with pytest.raises(C.ConfigError):
            C.validate(bad)


def test_commands(spark, tmp_path):
    folder = tmp_path / "tables"
    candidates(spark)["plain"].write.parquet(str(folder / "documents.parquet"))
    _, new = cli.run_init(spark, str(folder), str(tmp_path))
    assert new and cli.run_init(spark, str(folder), str(tmp_path))[1] is False
    out, code, recipe = cli.run_scan(spark, str(folder), "id", str(tmp_path), ci=True, min_score=100)
    assert code == 1 and recipe is None and out["stack"]["frameworkGuess"] == "generic" and out["totals"]["chunks"] == 5


def test_no_writes_to_sources():
    """Nothing under operators and sources writes a table (the configuration file apart)."""
    for p in [*ROOT.glob("evidentia/operators/*.py"), *ROOT.glob("evidentia/sources/*.py"), *ROOT.glob("evidentia/functions/*.py")]:
        names = {n.attr for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.Attribute)}
        assert not names & {"write", "writeTo", "saveAsTable", "insertInto"}, p


def test_training_data_operators_are_apart():
    """The rest of the library does not import the subpackage llm."""
    for p in ROOT.glob("evidentia/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_vectors_with_odd_elements_are_like_no_other(spark):
    """NaN, null and infinite elements neither erase others' neighbours nor get any, whatever the batches."""
    nan, inf = float("nan"), float("inf")
    good = [(i, f"t{i}", [float(x) for x in unit(i, 4)]) for i in range(12)] + [(12, "t12", [float(x) for x in unit(3, 4)])]
    odd = [(20, "a", [nan, 1.0, 0.0, 0.0]), (21, "b", [1.0, None, 0.0, 0.0]), (22, "c", [inf, 1.0, 0.0, 0.0]), (23, "d", [nan] * 4)]
    view = lambda rows, n: chunk_view(spark.createDataFrame(rows, "id long, c string, e array<float>").repartition(n), Mapping.of("t", "c", "e"), "id")
    want = knn.nearest_neighbors(view(good, 1), 100).orderBy("ord").collect()
    assert len(want) == 13 and next(r for r in want if r["ref"] == "3")["neighbor_ref"] == "12"
    for n in (1, 5):
        assert knn.nearest_neighbors(view([*odd, *good], n), 100).orderBy("ord").collect() == want
    zeros = knn.nearest_neighbors(view([(1, "x", [0.0, 0.0]), (2, "y", [1.0, 0.0])], 1), 5).orderBy("ord").collect()
    assert [(r["ref"], r["similarity"]) for r in zeros] == [("1", 0.0), ("2", 0.0)]


def test_neighbors_by_small_products(spark, monkeypatch):
    rows = [(i, f"t{i}", [float(x) for x in unit(i, 8)]) for i in range(60)]
    view = chunk_view(spark.createDataFrame(rows, "id long, c string, e array<float>").coalesce(1), Mapping.of("t", "c", "e"), "id")
    want = knn.nearest_neighbors(view, 30).orderBy("ord").collect()
    monkeypatch.setattr(knn, "STEP_BYTES", 2000)
    assert knn.nearest_neighbors(view, 30).orderBy("ord").collect() == want and len(want) == 30


def test_a_sample_reads_names_first(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("text "), "id").alias("c"), F.array(F.lit(1.0)).cast("array<float>").alias("e"))
    whole = {r["id"] for r in deterministic_sample(df, "s", 50, "id").collect()}
    known = deterministic_sample(df, "s", 50, "id", 5000)
    assert len(whole) == 50 and {r["id"] for r in known.collect()} == whole
    text = chunk_view(known, Mapping.of("t", "c", "e"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("sha2") < text.index("Join LeftSemi") < text.index("md5")  # hashes of texts above the choice, names below


def test_names_sort_alike_on_driver_and_executors(spark):
    from evidentia.sources.introspect import fingerprint, places

    names = ["b", "B", "a", "_b", "a_b", "ab", "Á", "z", "ä", "Zeta"]
    got = sorted(names, key=places(spark, names).get)
    sorted_by_spark = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.collate("n", "UNICODE")).collect()]
    assert got == sorted_by_spark and got != sorted(names) and got.index("B") == got.index("b") + 1
    frame = spark.createDataFrame([], "b string, B2 int, _c string, a_b string, ab string, embedding array<float>")
    held = Catalog({"T": frame, "_s": frame}, {"T": 0, "_s": 0})
    found, _ = fingerprint(held, held.candidates())
    assert [c["name"] for c in found[0]["columns"]] == ["_c", "a_b", "ab", "b", "B2", "embedding"] and [t["table"] for t in found] == ["public._s", "public.T"]
    assert fingerprint(held, [])[0] == [] and places(spark, []) == {}
