"""Planted corpora: how many of each fault a table holds is known."""

from __future__ import annotations

import json
import random

import numpy as np

WORDS = "harbour lantern meadow copper violet signal granite orchard timber canyon ribbon velvet anchor marble thunder quartz".split()
SECRET_TEXTS = ["The key is sk-" + "a1B2" * 6 + " and must not be here.", "Use AKIA" + "ABCDEFGH12345678" + " to sign in to the store.", "-----BEGIN RSA PRIVATE KEY-----\nAAAA"]


def healthy(i: int) -> str:
    """More than 200 characters, capitalised and ended, different for each number."""
    rng = random.Random(i)
    return f"Passage number {i} speaks of " + " ".join(rng.choice(WORDS) for _ in range(40)) + f" and ends with item {i}."


def unit(i: int, dims: int = 64) -> np.ndarray:
    v = np.random.default_rng(i).normal(size=dims)
    return v / np.linalg.norm(v)


def near(base: np.ndarray, i: int) -> np.ndarray:
    v = base + 0.1 * unit(i, len(base))
    return v / np.linalg.norm(v)


def row(i: int, text: str | None, vector, meta: dict | None = None) -> tuple:
    return (i, text, None if vector is None else [float(x) for x in vector], None if meta is None else json.dumps(meta))


def rotten() -> list[tuple]:
    """298 rows: 200 healthy, 10 groups of 3 equal chunks, 20 near pairs, 25 thin, 3 with secrets."""
    out, i = [], 0

    def add(text: str, vector) -> None:
        nonlocal i
        out.append(row(i, text, vector, {"source": f"https://example.org/{i}"}))
        i += 1

    for k in range(200):
        add(healthy(k), unit(k))
    for g in range(10):
        text = healthy(1000 + g)
        for k, t in enumerate((text, text.upper() if g < 3 else text, text.replace(" ", "  ") if g < 3 else text)):
            add(t, unit(5000 + 3 * g + k))
    for p in range(20):
        base = unit(7000 + p)
        add(healthy(2000 + 2 * p), base)
        add(healthy(2001 + 2 * p), near(base, 8000 + p))
    for k in range(25):
        add(f"Note {k}.", unit(9000 + k))
    for k, t in enumerate(SECRET_TEXTS):
        add(t + " " + healthy(3000 + k), unit(9500 + k))
    return out


SCHEMA = "id long, text string, embedding array<float>, meta string"
