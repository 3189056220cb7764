"""Repaired conversations against a search over all edits: whole, in pieces, over partitions' edges, with odd rows and hot conversations."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from evidentia.llm import conversation_repair

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def talks(seed, conversations, longest, roles=("user", "assistant", "system", "tool", "", None)):
    rng = random.Random(seed)
    out = []
    for c in range(conversations):
        expected = "user"
        for t in range(rng.randrange(1, longest)):
            role = expected if rng.random() < 0.7 else rng.choice(roles)
            expected = "assistant" if expected == "user" else "user"
            text = rng.choice(["Yes.", "No!", "cut short", "", " \t\n", "Why?\n", None, "é中.", "a.b"]) if rng.random() < 0.5 else f"said {rng.randrange(99)}."
            out.append((c, None if rng.random() < 0.03 else t + rng.choice([0, 0, 0, 2]), role, text))
    rng.shuffle(out)
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for name in ("part", "number", "copies", "digest", "cut"):
        df = df.withColumn(name, F.lit("x"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation_repair.damage_and_repair(df).collect()}
    want = brute.conversations(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, [r for r in rows if r[0] == c], got[c], want[c])


def test_many_conversations(spark):
    check(spark, talks(1, 400, 9))


@pytest.mark.parametrize("size", [1, 2, 5])
def test_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", size)
    check(spark, talks(2, 30, 25))


def test_ties_in_a_few_roles(spark, monkeypatch):
    """Few roles and texts make many equal costs."""
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", 3)
    rows = talks(3, 150, 14, ("user", "assistant", "system"))
    check(spark, [(c, t, r, f"{c}-{t}{k}" + random.Random(k).choice([".", ""])) for k, (c, t, r, _) in enumerate(rows)])


def test_one_conversation_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", 50)
    check(spark, [(7, t, r, x) for t, (_, _, r, x) in enumerate(talks(4, 80, 10))] + talks(5, 3, 5))


def test_equal_rows_and_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "assistant", "Hi."), (1, None, "user", "Hi."), (1, None, None, None)] * 20
    check(spark, [*rows, (None, None, None, None), (None, 1, "user", "Q."), (2, 5, "s", "x."), (3, 1, "unknown", "x" * 300_000)])


def test_dropped_conversations_and_empty_table(spark):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "Hello."), (gone + 1, 9, "user", "Hello.")])
    check(spark, [(gone, 0, "user", "Hello.")])
    assert conversation_repair.damage_and_repair(spark.createDataFrame([], KIND)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], "conv_id string, turn int, role string, text string")
    assert [r["conv_id"] for r in conversation_repair.damage_and_repair(df).collect()] == ["a"]
