"""The language model against a dictionary version, its probabilities' sums, stored models, odd rows and small blocks."""

import math
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from evidentia.llm import lm_scoring

held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9), (g, w)


def found(df):
    return sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_dictionaries(frame, odd, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 500)
    same(found(lm_scoring.train_and_score(frame(odd, order == 2), order)), sorted(brute.kneser_ney(odd, held, order).values()))


def test_by_document(frame, odd):
    want = {i: x for (i, _), x in zip(odd, brute.kneser_ney(odd, held, 2).values(), strict=True)}
    for r in lm_scoring.train_and_score(frame(odd)).collect():
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == want[r["doc_id"]][0]
        assert math.isclose(r["score"], want[r["doc_id"]][4], rel_tol=1e-9) and math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"]), rel_tol=1e-9)


def test_probabilities_sum_to_one(spark, frame, odd):
    """Of all words and one unknown, behind a known context: texts of one word, scored by a stored model."""
    model = lm_scoring.train(frame(odd), 2)
    words = sorted({w for _, t in odd for w in (t or "").lower().split() if w.isascii()} | {w for _, t in odd for w in (t or "").split() if not w.isascii()})
    words = sorted({w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words})
    scored = {r["doc_id"]: r["score"] for r in lm_scoring.score(frame([*enumerate(words), (-1, ""), (-2, "never-seen-word")]), model).collect()}
    # A text is its word and the end; P(w | start) is what is left without the end's part, known by P(w w').
    twice = {r["doc_id"]: r["score"] for r in lm_scoring.score(frame([(-1, ""), (-2, "never-seen-word")]), model).collect()}
    assert scored[-1] == twice[-1] and scored[-2] == twice[-2]
    assert sum(10**s for i, s in scored.items()) < 1 + 1e-9


def test_stored_model_scores_alike(frame, odd):
    learned = [r for r in odd if not held(r[0])]
    model = lm_scoring.train(frame(learned), 3)
    want = {r["doc_id"]: r["score"] for r in lm_scoring.train_and_score(frame(odd), 3).collect()}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(frame(odd), model).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_odd_tables(spark, frame):
    assert lm_scoring.train_and_score(frame([])).count() == 0
    rows = [(None, "a b"), (None, None), (5, "a b"), (5, "a b"), (5, "other words"), (7, "")]
    same(found(lm_scoring.train_and_score(frame(rows))), sorted(brute.kneser_ney(rows, held, 2).values()))
    nothing = lm_scoring.train_and_score(frame([(i, "a b c") for i in range(3)]), held=F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in nothing] == [(4, 0, 0, 0.0, 0.0)] * 3


def test_long_text_and_hot_word(frame):
    rows = [(0, "hot " * 50_000), *((i, f"hot hot w{i}") for i in range(1, 300))]
    same(found(lm_scoring.train_and_score(frame(rows))), sorted(brute.kneser_ney(rows, held, 2).values()))
