"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BASE_2, LOWER, bound_batches, byte_class, grams, large, mix, slices, utf8, word_hash, word_spans

#: Hash buckets of the n-grams.
BUCKETS = 1 << 18
#: Labelled rows that training uses at most (those with the smallest hashes of their ids), and passes over them.
MAX_LABELLED, EPOCHS = 8000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

SPACE = byte_class([(0x09, 0x0D), (0x20, 0x20)])
#: Kinds of bytes in a word's shape: lower, upper, digit, beyond ASCII; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = ord("x"), ord("X"), ord("9"), ord("u")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every word 1-gram and 2-gram of the texts, of the words and of their shapes, two arrays
    of words by 2; each word's text; words per text. A text's first word pairs with nothing (bucket 0)."""
    starts, ends, first = word_spans(SPACE[data], offsets)
    counts = first[1:] - first[:-1]
    owner = np.repeat(np.arange(len(counts)), counts)
    if not len(starts):
        return np.zeros((0, 4), np.int64), owner, counts
    words = word_hash(LOWER[data], starts, ends)
    kinds = SHAPE[data]
    upper = np.zeros(len(kinds) + 1, np.int32)
    np.cumsum(kinds == ord("X"), out=upper[1:])
    size = ends - starts
    last = [kinds[at].astype(np.uint64) for at in (starts, ends - 1, np.maximum(ends - 2, starts))]
    shape = last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)
    shape |= np.minimum(size, 3).astype(np.uint64) << np.uint64(24) | (2 * (upper[ends] - upper[starts]) > size).astype(np.uint64) << np.uint64(32)
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    out = np.zeros((len(words), 4), np.int64)
    pair = np.zeros(len(words), bool)
    pair[1:] = owner[1:] == owner[:-1]
    for k, (one, tag) in enumerate(((words, 1), (mix(shape + np.uint64(7)), 2))):
        out[:, 2 * k] = 1 + mix(one + np.uint64(tag)) % np.uint64(BUCKETS - 1)
        two = np.zeros(len(words), np.uint64)
        two[1:] = grams(one, 2, BASE_2) + same[1:] * np.uint64(k)
        out[:, 2 * k + 1] = np.where(pair, 1 + mix(two + np.uint64(tag + 8)) % np.uint64(BUCKETS - 1), 0)
    return out, owner, counts


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sparse dot products: the mean weight of a text's n-grams, scaled as in training."""
        buckets, owner, counts = features(data, offsets)
        each = self.weights[buckets].sum(1)
        total = np.bincount(owner, each, len(counts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.sqrt(np.maximum(counts, 1)), -35, 35)))


def ftrl(batches, prior: float = 0.0) -> tuple[np.ndarray, float]:
    """One pass over (label, text) batches in their order, updating after each text; prior: log odds to begin with."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = 0.0
    for batch in batches:
        texts = large(batch.column(1))
        labels = batch.column(0).to_pylist()
        data, offsets = utf8(texts)
        for a, b in slices(offsets):
            buckets, _, counts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.concatenate([[0], np.cumsum(counts)])
            for k in range(b - a):
                index, count = np.unique(buckets[at[k] : at[k + 1]], return_counts=True)
                x = count / np.sqrt(max(1, counts[k]))
                zi, ni = z[index], n[index]
                w = np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
                wb = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
                p = 1 / (1 + np.exp(-np.clip(prior + wb + w @ x, -35, 35)))
                g, gb = (p - labels[a + k]) * x, p - labels[a + k]
                z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[index] = ni + g * g
                zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * wb
                nb += gb * gb
    w = np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, float(prior - zb / ((BETA + np.sqrt(nb)) / ALPHA))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most MAX_LABELLED labelled documents, in one task that streams them; the driver gets the weights.

    labels: id_col, label_col (0 or 1; rows of other or null labels or ids are not used). A repeated label row is used as often as it
    stands there, within the bound. Of documents of one id one is used, the one whose text has the least hash, so rows of one id don't
    widen the bound; null texts are empty. Other columns of both tables are not read. No usable label: a model that scores 0.5.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keys = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    keys = keys.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "label").limit(MAX_LABELLED)
    n, ones = keys.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(keys.select("id").distinct()), "id", "left_semi")
    rows = texts.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(keys), "id")
    # Epochs are made behind the shuffle, so each text crosses it once.
    rows = rows.repartition(1).withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
    rows = rows.sortWithinPartitions("epoch", "h", "id", "label").select("label", "text")

    def fit(batches):
        weights, bias = ftrl(batches, prior)
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype("<i4").tobytes()]), pa.array([weights[kept].astype("<f8").tobytes()]), pa.array([bias])], ["at", "w", "bias"])

    row = rows.mapInArrow(fit, "at binary, w binary, bias double").first()
    weights = np.zeros(BUCKETS)
    if row is None:
        return Model(weights, 0.0)
    weights[np.frombuffer(bytes(row["at"]), "<i4")] = np.frombuffer(bytes(row["w"]), "<f8")
    weights[0] = 0
    return Model(weights, row["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, score (0 to 1), and the columns named in `keep`.

    Null and empty texts score by the bias alone. Repeated rows score alike, one row each; an empty
    table gives none. Whole texts are read. Only the text is an input of the score. Kept columns may have any names but
    `score`, which is refused (ValueError).
    """
    bound_batches(docs.sparkSession)
    if "score" in (id_col, *keep):
        raise ValueError("a kept column has the name of the result, score")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(large(batch.column(0)))
            out = np.zeros(batch.num_rows)
            for a, b in slices(offsets):
                out[a:b] = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*batch.schema.names[1:], "score"])

    columns = [id_col, *(c for c in keep if c != id_col)]
    named = docs.select(F.col(f"`{text_col}`"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[1:])
    scored = named.mapInArrow(run, f"{schema}, score double")
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)), "score")


def held_out(id_col: str = "doc_id"):
    """Rows that no label may be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels outside the held-out fold and score every document: id, held_out, score, predicted.

    Null texts and ids are scored, too (a missing id counts as the empty text for the fold); rows of one id each score by their own text; other
    columns, and their names, do not matter; an empty table gives no rows; without usable labels every score is 0.5."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that a model of the labels outside the held-out fold does not reject (score of 0.5 or
    more), all their columns unchanged. Each row is judged by its own text, so repeated rows, rows of one id and rows
    without one stay or go by their texts; null and empty texts score by the bias alone; columns may have any
    names; without usable labels, or rows, all (0.5 each), or none, stay."""
    names = docs.columns
    model = train(docs, labels.where(~held_out()))
    renamed = docs.select(F.col(text_col).alias("_text"), *(F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)))
    scored = score(renamed, model, "k0", "_text", tuple(f"k{i}" for i in range(len(names))))
    return scored.where(F.col("score") >= 0.5).select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)))
