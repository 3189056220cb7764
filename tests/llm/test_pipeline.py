import os

import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from evidentia.llm import quality
from evidentia.llm.oracle import oracle_sql

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_stages_are_brute_force_in_turn(spark):
    """Each stage keeps what its plain version keeps of its own input, and the columns of documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    before = rows(docs)
    stage = dict(P.STAGES)
    assert list(stage) == ["quality_classifier", "line_dedup", "jaccard_join", "benchmark_decontamination", "packing"]

    out = stage["quality_classifier"](spark, docs, SMALL)
    good = {r["doc_id"] for r in quality.score_with_labels(docs, labels).where("predicted = 1").collect()}
    assert out.columns == names and rows(out) == [r for r in before if r[0] in good] and len(good) < len(before)
    docs, before = spark.createDataFrame(out.collect(), out.schema), rows(out)

    out = stage["line_dedup"](spark, docs, SMALL)
    assert out.columns == names and rows(out) == sorted((i, t) for i, _, k, t in brute.lines(before, P.MIN_RUN, P.LONG_WORDS) if not (k and not t.strip()))
    docs, before = spark.createDataFrame(out.collect(), out.schema), rows(out)

    out = stage["jaccard_join"](spark, docs, SMALL)
    first = {i for i, _, c in brute.linked(before) if c == i}
    assert out.columns == names and rows(out) == [r for r in before if r[0] in first]
    docs, before = spark.createDataFrame(out.collect(), out.schema), rows(out)

    out = stage["benchmark_decontamination"](spark, docs, SMALL)
    clean = {r[0] for r in brute.contamination(before, items, P.WINDOW) if not r[5]}
    assert out.columns == names and rows(out) == [r for r in before if r[0] in clean]
    docs, before = spark.createDataFrame(out.collect(), out.schema), rows(out)

    out = stage["packing"](spark, docs, SMALL).collect()
    held = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    n = {i: len(held.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before}
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == n and sum(r["length"] for r in out) == sum(n.values())


def test_run(spark):
    import __spark_entry__ as entry

    assert P.ORACLE_SQL is None and "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    out = entry.queries()["pipeline"](spark, SMALL).collect()
    assert out and max(r["offset"] + r["length"] for r in out) <= 4096


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    from evidentia.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SMALL).toPandas(), con.sql(oracle_sql()[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    plain = lambda df: sorted(tuple(str(v) for v in r) for r in df[names].astype(object).itertuples(index=False))
    assert plain(ours) == plain(theirs)


