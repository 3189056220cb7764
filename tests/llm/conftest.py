import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd():
    """Rows with nulls, empty and long texts, equal rows, copies, near copies, shared passages and lines."""
    rng = random.Random(7)
    out = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9004, "ONE  two"), (9005, "a b c d e"), (9006, "é ß Ünicode 中文 " * 3), (9007, "x" * 5000), (9008, "ab " * 3000), (9009, "<|endoftext|> don't 12 a_b")]
    passage = " ".join(words(rng, 60))
    for i in range(60):
        text = words(rng, rng.choice([8, 30, 80, 200]))
        for k in range(10, len(text), 17):
            text[k] += "\n"
        out.append((i, " ".join(text).replace("\n ", "\n")))
        if i % 4 == 0:
            copy = list(text)
            copy[rng.randrange(len(copy))] = "changed"
            out.append((200 + i, " ".join(copy).replace("\n ", "\n")))
        if i % 5 == 0:
            out.append((400 + i, out[-1][1]))
        if i % 3 == 0:
            out.append((600 + i, f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 20))}"))
        if i % 6 == 0:
            out.append((800 + i, "License line one.\nLicense line two here.\n" + " ".join(words(rng, 30)) + "\n\nLicense line one.\nLicense line two here."))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def frame(spark):
    """rows of (doc_id, text) as documents with all their columns, and some whose names operators use themselves."""

    def make(rows, extra=False):
        held = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(held, DOCS).repartition(5)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "spans", "items", "score", "_kept", "starts", "k0", "d", "n", "key", "rank", "label"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
