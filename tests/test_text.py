import pytest
from pyspark.sql import functions as F

from evidentia.functions import metadata as M
from evidentia.functions import text as X

NBSP, WIDE, ZERO, BOM, NEL = chr(0xA0), chr(0x2003), chr(0x200B), chr(0xFEFF), chr(0x85)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("  A\t B ", "a b"), (f"A{NBSP}{WIDE}b", "a b"), (f"a{ZERO}b{BOM}", "ab"), (None, ""), ("", ""), ("a\x0bb", "a b"), (f"a{NEL}b", f"a{NEL}b")])
def test_normalized(spark, text, want):
    assert one(spark, text, X.normalized) == want


@pytest.mark.parametrize(("text", "want"), [("", 0.0), ("see https://a.b www.c.d now", 0.5), ("Home | About » Blog", 0.4), ("a — b", 1 / 3), ("HTTP://x", 1.0), ("a-b", 0.0)])
def test_link_density(spark, text, want):
    assert one(spark, text, X.link_density) == pytest.approx(want)


@pytest.mark.parametrize(
    ("text", "want"),
    [("and then it went on", True), ("And then", False), ("and then.", False), ("- item here", False), ("1. item here", False), ("", False), ("  ", False), (f"{NBSP}mid way", True), ("ends with quote\"", False), ("9 lives of a cat", False), (f"end.{NEL}", True)],
)
def test_mid_sentence(spark, text, want):
    assert one(spark, text, X.mid_sentence) is want


def test_secrets_are_redacted(spark):
    text = "sk-" + "a" * 20 + " AKIA" + "B" * 16 + " xoxb-123-abc"
    found = one(spark, text, X.secrets)
    assert [(r["pattern"], r["redacted"]) for r in found] == [("openai_key", "sk-a…"), ("aws_access_key", "AKIA…"), ("slack_token", "xoxb…")]
    assert one(spark, "sk-short AKIAlow", X.secrets) == []


@pytest.mark.parametrize(("text", "want"), [("éTODO x", ["TODO"]), ("TODOs", []), ("DRAFT and DRAFT, INTERNAL ONLY", ["DRAFT", "INTERNAL ONLY"]), ("todo", []), ("x_TODO", [])])
def test_markers(spark, text, want):
    assert one(spark, text, X.markers) == want


def test_emails(spark):
    assert one(spark, "a@b.c, d.e+f@g-h.i and @j", X.email_count) == 2


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("|a|b|c|\n|1|2|3|\n|4|5|6|", True), ("|a|b|c|\n|---|---|---|\n|1|2|3|", True), ("a,b,c\n1,2,3\n4,5,6", True), ("a\tb\tc\n1\t2\t3\n4\t5\t6", True), ("a,b,c\n1,2,3", False),
        ("a,b,c\n1,2,3,4\n1,2,3,4,5", False), ("one\ntwo\nthree", False), ("\n".join(["plain"] * 24 + ["a,b,c"] * 3), False), ("a,b,c\n" + "x" * 221 + ",y,z\n1,2,3", False),
    ],
)
def test_table_like(spark, text, want):
    assert one(spark, text, X.table_like) is want


@pytest.mark.parametrize(
    ("json", "want"),
    [('{"source": "a"}', True), ('{"source": "  "}', False), ('{"source": null}', False), ('{"source": []}', False), ('{"source": {}}', False), ('{"source": 0}', True), ('{"source": false}', True), ('{"other": 1}', False), ("[1]", False), (None, False), ("broken", False)],
)
def test_locator_values(spark, json, want):
    out = one(spark, json, lambda c: M.has_locator(M.object_only(c), M.keys(M.object_only(c)), M.SOURCE_KEYS))
    assert out is want


def test_safe_keys(spark):
    assert one(spark, "tenant_id", M.safe_key) == "tenant_id"
    assert one(spark, "region", M.safe_key).startswith("sha256:")


def test_texts_without_signs_are_not_split(spark):
    """What is cheap to see comes first, and says no only where the whole expression does."""
    texts = ["one, two\nthree, four\nfive", "a,b,c\n1,2,3\n4,5,6", "a|b|c\r\n---|---|---\r\n1|2|3", "1\t2\t3\n" * 3, "plain", "x — y", "a-b www.c", f"A {NBSP} B", f"a{ZERO} b  c", f"{NBSP}x", " a b ", "É  Ü", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.may_hold_rows(F.col("t")).alias("may"), X.table_like(F.col("t")).alias("is"), X.normalized(F.col("t")).alias("n"), F.col("t").rlike(X.LINK_SIGN).alias("sign"), X.link_density(F.col("t")).alias("share")).collect()
    assert [r["may"] for r in got][:5] == [False, True, True, True, False] and all(r["may"] or not r["is"] for r in got) and [r["is"] for r in got][1:4] == [True] * 3
    assert all(r["sign"] or r["share"] == 0 for r in got) and [r["share"] for r in got][4:7] == [0.0, pytest.approx(1 / 3), 0.5]
    assert [r["n"] for r in got][5:] == ["x — y", "a-b www.c", "a b", "a b c", "x", "a b", "é ü", ""]


def test_long_runs_take_one_look(spark):
    """Long runs of white space or of an address's characters are passed once, and addresses are the ones a plain search finds."""
    import time

    texts = ["x" + " " * 200_000 + "y", "b" * 200_000 + " a@b.org", "a@b.c+d@e.f a@b@c.d x@y z.w@v.u.t@s.r"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.perf_counter()
    got = [tuple(r) for r in df.select(F.length(X.stripped(F.col("t"))), X.email_count(F.col("t"))).collect()]
    assert got == [(200_002, 0), (200_008, 1), (37, 4)] and time.perf_counter() - began < 30
