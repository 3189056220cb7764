"""Databases behind JDBC, by the embedded one that comes with Spark; its catalog stands in for PostgreSQL's."""

import pytest
from fixtures import healthy

from evidentia import cli
from evidentia.sources import config as C
from evidentia.sources import jdbc as J
from evidentia.sources.introspect import Prompts

NAMED = "FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID"
USERS = "t.TABLETYPE = 'T' AND s.SCHEMANAME IN ('public', 'vecs')"
DERBY = J.Dialect(
    columns=f"SELECT s.SCHEMANAME AS table_schema, t.TABLENAME AS table_name, c.COLUMNNAME AS column_name, c.COLUMNNUMBER AS place, CASE WHEN c.COLUMNNAME IN ('embedding', 'vec') THEN 'vector' WHEN c.COLUMNNAME = 'metadata' THEN 'jsonb' ELSE 'other' END AS kind {NAMED} JOIN SYS.SYSCOLUMNS c ON c.REFERENCEID = t.TABLEID WHERE {USERS}",
    sizes=f"SELECT s.SCHEMANAME AS table_schema, t.TABLENAME AS table_name, CAST(500000 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_pages {NAMED} WHERE {USERS}",
    indexes="SELECT TABLENAME || '_i' AS name, 'CREATE INDEX i ON ' || TABLENAME || ' USING hnsw (other vector_cosine_ops)' AS definition FROM SYS.SYSTABLES WHERE TABLENAME = '{table}' AND '{schema}' = 'public'",
    as_text="CAST({0} AS VARCHAR(4000))",
)


@pytest.fixture(scope="module")
def url(spark):
    at = "jdbc:derby:memory:evidence"
    spark._jvm.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    con = spark._jvm.java.sql.DriverManager.getConnection(at + ";create=true")
    run = con.createStatement().execute
    run('CREATE SCHEMA "public"')
    run('CREATE TABLE "public"."document_chunks" ("id" BIGINT, "content" VARCHAR(4000), "embedding" VARCHAR(4000), "metadata" VARCHAR(400), "deleted" BOOLEAN)')
    run('CREATE TABLE "public"."other" ("id" BIGINT, "content" VARCHAR(4000))')
    for k in range(120):
        vector = "NULL" if k == 5 else f"'[{k % 7}.5,1,{k % 3}]'"
        text = healthy(k).replace("'", "")[:3000]
        run(f"INSERT INTO \"public\".\"document_chunks\" VALUES ({k}, '{text}', {vector}, '{{\"source\": \"s{k}\"}}', {'true' if k < 3 else 'false'})")
    con.close()
    yield at


def test_tables_look_as_in_other_sources(spark, url):
    held = J.Database(spark, url, DERBY)
    (t,) = held.candidates()
    assert (t.qualified, t.estimated_rows, t.vectors) == ("public.document_chunks", 500_000, ["embedding"])
    assert dict(t.columns)["metadata"] == "jsonb" and dict(t.columns)["deleted"] == "bool"
    assert held.embedding_dims(t.qualified, "embedding") == 3 and held.json_keys(t.qualified, "metadata") == ["source"]
    by_key = held.keyed("document_chunks", "id")
    assert by_key.rdd.getNumPartitions() == 3 and by_key.count() == 120 and sorted(r["id"] for r in by_key.select("id").collect()) == list(range(120))
    assert by_key.where("embedding is null").count() == 1 and by_key.where("id = 8").first()["embedding"] == [1.5, 1.0, 2.0]
    with pytest.raises(KeyError):
        held.frame("other")


def test_scan_of_the_environment_s_connection(spark, url, tmp_path, monkeypatch):
    monkeypatch.setenv("MY_RAG_DB", url)
    assert cli.run_init(spark, None, str(tmp_path), env="MY_RAG_DB", dialect=DERBY)[1]
    assert C.load(tmp_path)["connection"] == {"env": "MY_RAG_DB"} and url not in (tmp_path / C.FILE).read_text()
    out, _, recipe = cli.run_scan(spark, None, "id", str(tmp_path), dialect=DERBY)
    titles = {f["title"] for f in out["findings"]}
    assert recipe is None and out["totals"]["chunks"] == 120 and out["stack"]["embeddingDims"] == 3
    # The index is on another column, and three rows are marked as deleted.
    assert "Mapped embedding column has no approximate vector index yet" in titles
    assert "Rows marked deleted or archived are still in the mapped chunk table" in titles
    monkeypatch.delenv("MY_RAG_DB")
    with pytest.raises(ValueError, match="MY_RAG_DB"):
        cli.run_scan(spark, None, "id", str(tmp_path), dialect=DERBY)


def test_found_mappings_are_agreed_to(spark, url, tmp_path):
    said = []
    answers = iter(["n", "1", "1", "1", "", "", "", "y"])
    prompts = cli.terminal_prompts(lambda m: (said.append(m), next(answers))[1], said.append)
    held, new = cli.run_init(spark, url, str(tmp_path), prompts=prompts, dialect=DERBY)
    assert new and held["mapping"]["columns"]["content"] == "content" and any("document_chunks" in m for m in said)
    with pytest.raises(RuntimeError):
        cli.run_init(spark, url, str(tmp_path), force=True, prompts=Prompts(lambda m: False, lambda m, cs: cs[0], lambda m, cs: None), dialect=DERBY)


def test_connections():
    assert J.parse_url("postgresql://me:p%40ss@db.example.org:5433/rag?sslmode=require") == ("jdbc:postgresql://db.example.org:5433/rag", {"user": "me", "password": "p@ss", "sslmode": "require"})
    assert J.parse_url("jdbc:x:y") == ("jdbc:x:y", {})
    with pytest.raises(ValueError):
        J.parse_url("mysql://x/y")


def test_large_tables_are_read_by_pages(spark, monkeypatch):
    seen = {}
    held = object.__new__(J.Database)
    held.spark, held.dialect, held.url, held.options = type("S", (), {"read": None})(), J.POSTGRESQL, "jdbc:postgresql://h/d", {}
    held.columns, held.estimates, held.pages = {"public.t": [("id", "int8"), ("embedding", "vector")]}, {"public.t": 1_000_000}, {"public.t": 1000}
    frame = spark.createDataFrame([(1, "[1,2]", "x")], "id long, embedding string, ctid string")

    class Reader:
        format = options = lambda self, *a, **k: self

        def jdbc(self, url, table, predicates, properties):
            seen.update(table=table, predicates=predicates)
            return frame

    held.spark.read = Reader()
    assert held.read("public.t").first().asDict() == {"id": 1, "embedding": [1.0, 2.0]}
    assert len(seen["predicates"]) == 5 and seen["predicates"][1] == "ctid >= '(200,0)'::tid AND ctid < '(400,0)'::tid" and 'CAST("embedding" AS text) AS "embedding"' in seen["table"]


@pytest.mark.parametrize(
    ("definition", "want"),
    [
        ("CREATE INDEX i ON public.t USING hnsw (embedding vector_cosine_ops)", ("i", "hnsw", ["embedding"])),
        ("CREATE INDEX i ON public.t USING ivfflat (vec vector_l2_ops) WITH (lists='100')", ("i", "ivfflat", ["vec"])),
        ("CREATE UNIQUE INDEX i ON public.t USING btree (a, b DESC)", ("i", "btree", ["a", "b"])),
    ],
)
def test_index_definitions(definition, want):
    assert J.parse_index("i", definition) == want


def test_all_parts_read_one_snapshot(spark, url, monkeypatch):
    """The connection that gives the snapshot is open while parts are read, each of which begins by taking it, and closed behind."""
    import dataclasses

    run = lambda sql: spark._jvm.java.sql.DriverManager.getConnection(url).createStatement().execute(sql)
    run('CREATE TABLE "public"."taken" ("name" VARCHAR(40))')
    dialect = dataclasses.replace(DERBY, export="VALUES 'snap-1'", share="INSERT INTO \"public\".\"taken\" VALUES '{snapshot}'")
    held = J.Database(spark, url, dialect)
    before = dict(held.options)
    with held.snapshot() as name:
        rows = held.keyed("document_chunks", "id")
        assert name == "snap-1" and rows.rdd.getNumPartitions() == 3 and rows.count() == 120
    taken = spark.read.format("jdbc").options(url=url, query='SELECT "name" FROM "public"."taken"').load().collect()
    # Each part's session took it, and those that looked up the key's range.
    assert len(taken) >= 3 and {r[0] for r in taken} == {"snap-1"}
    assert held.options == before and held.keyed("document_chunks", "id").count() == 120
    with pytest.raises(ZeroDivisionError), held.snapshot():
        raise ZeroDivisionError
    assert held.options == before
    with pytest.raises(ValueError, match="name"), J.Database(spark, url, dataclasses.replace(dialect, export="VALUES 'a; DROP'")).snapshot():
        pass
    with J.Database(spark, url, DERBY).snapshot() as none:
        assert none is None
    assert J.POSTGRESQL.share.format(snapshot="x-1").endswith("SET TRANSACTION SNAPSHOT 'x-1'")


def test_indexes_by_relations(spark, url):
    """Expression and included columns, operator classes, columns by their numbers: the catalog's relations, not a definition's text."""
    import dataclasses

    rows = lambda names, *values: f"SELECT * FROM (VALUES {', '.join(values)}) AS t({names})"
    text = lambda x: f"CAST({x} AS VARCHAR(40))"
    index = lambda name, method, keys, classes, n, expression: f"({text(repr(name))}, {text(repr(method))}, {text(repr(keys))}, {text(repr(classes))}, {n}, {text(expression)})"
    relations = {
        "indexes": rows("name, method, keys, opclass_ids, key_count, expressions", index("by_vector", "hnsw", "3", "7", 1, "NULL"), index("wide", "btree", "2 0 1", "8 8", 2, "'lower(content)'")),
        "attributes": rows("attnum, attname", *(f"({k}, {text(repr(n))})" for k, n in ((1, "id"), (2, "content"), (3, "embedding")))),
        "classes": rows("opclass_id, opclass", f"(7, {text(repr('vector_cosine_ops'))})", f"(8, {text(repr('text_ops'))})"),
    }
    held = J.Database(spark, url, dataclasses.replace(DERBY, relations=relations))
    assert held.indexes("document_chunks") == [("by_vector", "hnsw", ["embedding"]), ("wide", "btree", ["content"])]
    wide = held.index_columns("public", "document_chunks").where("name = 'wide'").first()
    assert (wide["included"], wide["opclasses"], wide["expressions"]) == (["id"], ["text_ops", "text_ops"], ["lower(content)"])


def test_rows_of_files_are_counted_by_their_footers(spark, tmp_path):
    from evidentia.sources.catalog import Catalog

    spark.range(1000).selectExpr("id", "array(cast(id as float)) AS embedding", "cast(id as string) AS content").write.parquet(str(tmp_path / "t"))
    held = Catalog.of_parquet(spark, {"t": str(tmp_path / "t")})
    assert held.estimate("public.t") == 1000
    plan = held.tables["public.t"].groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan
