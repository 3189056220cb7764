"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark.

Documents are cut into blocks of tokens. For each order, a block sends its different n-grams' hashes with what it
counted of them to the shards that they belong to; a shard (a range of hashes) sums up, keeps the result as one sorted array of
hashes with its counts, mapped into memory, and answers each block by binary search: the count of all documents, and which block is
the first that counted the n-gram. That block alone counts it as a type for its context and for its suffix, so the
counts of the next lower order travel with that order's own hashes. Nothing but sums of a few numbers reaches the driver.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BASE_2, LOWER, bound_batches, buckets, byte_class, large, materialize, mix, release, shared_dir, slices, utf8, word_hash, word_spans

#: Words of the longest n-gram.
ORDER = 2
#: Tokens and documents after which a block is full; a longer document is a block of its own.
BLOCK_TOKENS, BLOCK_DOCUMENTS = 1 << 20, 1 << 16
#: Discounts of counts of 1, 2 and more, where the counts of counts are too few to tell them.
DISCOUNTS = (0.5, 1.0, 1.5)

SPACE = byte_class([(0x09, 0x0D), (0x20, 0x20)])
#: Places of the sentinels in a block's list of words, and their hashes: what stands before a text, and the end token.
START, END = 0, 1
SENTINELS = mix(np.array([11, 12], np.uint64))
#: What a shard sums up of an n-gram: as a type (raw counts of the longest and of those at a text's start, else how many types it ends);
#: as a context of longer ones: their counts' sum and how many have count 1, 2 and more; and how often it occurs.
FIELDS = ("count", "total", "ones", "twos", "more", "raw")
COUNT, TOTAL, ONES, TWOS, MORE, RAW = range(6)

BLOCKS = "block long, ids array<{kind}>, held binary, sizes binary, words binary, tokens binary"
ASKED = "shard int, block long, n long, hashes binary, counts binary"
SETTLED = "kind string, shard int, block long, n long, hashes binary, counts binary, types array<long>"


def matrix(data, n: int) -> np.ndarray:
    """Counts of n n-grams, a row for each field."""
    return unplanes(data, "<i8").reshape(-1, n) if n else np.zeros((len(FIELDS), 0), np.int64)


def planes(x: np.ndarray) -> bytes:
    """An array's bytes by significance, so that what is alike in neighbours stands together and compresses."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(data, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def listed(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def mapped(x: np.ndarray) -> np.ndarray:
    """A copy of an array in an anonymous memory map, whose pages go back to the system as soon as nothing reads it."""
    if not x.nbytes:
        return x
    out = np.frombuffer(mmap.mmap(-1, x.nbytes), x.dtype).reshape(x.shape)
    out[:] = x
    return out


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents (id, held, text) as blocks: ids, held flags, tokens of each, the block's different words' hashes, and tokens as places among them."""

    def close(ids, flags, sizes, hashes, number):
        found, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        words = np.concatenate([SENTINELS, found])
        counts = np.concatenate(sizes)
        # The end token behind each text.
        at = np.cumsum(counts) + np.arange(len(counts))
        out = np.full(len(tokens) + len(counts), END, np.uint32)
        inside = np.ones(len(out), bool)
        inside[at] = False
        out[inside] = tokens + 2
        block = (TaskContext.get().partitionId() << 32) + number
        columns = [pa.array([block]), listed(pa.concat_arrays(ids)), pa.array([np.concatenate(flags).tobytes()]), pa.array([planes(counts + 1)]), pa.array([words.tobytes()]), pa.array([planes(out)])]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "held", "sizes", "words", "tokens"])

    def run(batches):
        parts, n, rows, number = ([], [], [], []), 0, 0, 0
        for batch in batches:
            data, offsets = utf8(large(batch.column(2)))
            flags = np.asarray(batch.column(1).fill_null(False)).astype(np.uint8)
            for a, b in slices(offsets):
                lower = LOWER[data[offsets[a] : offsets[b]]]
                starts, ends, first = word_spans(SPACE[lower], offsets[a : b + 1] - offsets[a])
                for held, x in zip(parts, (batch.column(0).slice(a, b - a), flags[a:b], np.diff(first), word_hash(lower, starts, ends)), strict=True):
                    held.append(x)
                n, rows = n + len(starts), rows + b - a
                if n >= BLOCK_TOKENS or rows >= BLOCK_DOCUMENTS:
                    yield close(*parts, number)
                    parts, n, rows, number = ([], [], [], []), 0, 0, number + 1
        if rows:
            yield close(*parts, number)

    kind = docs.schema["id"].dataType.simpleString()
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, BLOCKS.format(kind=kind))


class Block:
    """A block's n-grams: for each order the hash of each different one, which one ends at each token (-1: none so long),
    and its context and suffix among those of the order below."""

    def __init__(self, row: dict, order: int):
        release()
        self.block, self.ids = row["block"], row.get("ids")
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.sizes = unplanes(row["sizes"], "<i8")
        words, tokens = np.frombuffer(row["words"], "<u8"), unplanes(row["tokens"], "<u4").astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(tokens)) - np.repeat(first, self.sizes)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~self.held[self.owner]
        self.hashes, self.at, self.context, self.suffix = [words], [tokens], [None], [None]
        before = np.concatenate([[START], tokens[:-1]]) if len(tokens) else tokens
        before[self.place == 0] = START
        for k in range(2, order + 1):
            there = np.flatnonzero(self.place >= k - 2)
            context = before[there] if k == 2 else self.at[-1][there - 1]
            key, which = np.unique(context * len(words) + tokens[there], return_inverse=True)
            word = key % len(words)
            at = np.full(len(tokens), -1, np.int64)
            at[there] = which
            suffix = np.empty(len(key), np.int64)
            suffix[which] = self.at[-1][there]
            del which, there
            self.context.append(key // len(words))
            self.suffix.append(suffix)
            self.hashes.append(mix(self.hashes[-1][self.context[-1]] * BASE_2 + words[word]))
            self.at.append(at)

    def starts(self, k: int) -> np.ndarray:
        """How often each n-gram of order k stands at a training text's start (the sentinel its first word)."""
        there = self.train & (self.place == k - 2)
        return np.bincount(self.at[k - 1][there], minlength=len(self.hashes[k - 1]))

    def raw(self, k: int) -> np.ndarray:
        there = self.train & (self.at[k - 1] >= 0)
        return np.bincount(self.at[k - 1][there], minlength=len(self.hashes[k - 1]))

    def counts(self, k: int, order: int, above: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """What this block counts of its n-grams of order k, a row for each of FIELDS (the longest: COUNT alone). above: of the order above, the counts
        of all documents and which n-grams are this block's to count as types."""
        n = len(self.hashes[k - 1])
        if above is None and k > 1:
            return self.raw(k)[None]
        out = np.zeros((len(FIELDS), n), np.int64)
        if k == 1:
            out[RAW] = self.raw(k)
        if above is None:
            out[COUNT] = out[RAW]
            return out
        count, mine = above
        out[COUNT] = np.bincount(self.suffix[k][mine], minlength=n) + (self.starts(k) if k > 1 else 0)
        context, c = self.context[k][mine], count[mine]
        out[TOTAL] = np.bincount(context, c, n).astype(np.int64)
        for field, is_it in ((ONES, c == 1), (TWOS, c == 2), (MORE, c > 2)):
            out[field] = np.bincount(context[is_it], minlength=n)
        return out


def ask(block: Block, k: int, counts: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard: the hashes there of a block's n-grams of order k, ascending, and their counts."""
    hashes = block.hashes[k - 1]
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[:, order]
    shard = shard_of(hashes, shards)
    held, first = np.unique(shard, return_index=True)
    last = np.append(first[1:], len(shard))
    rows = [(s, block.block, b - a, planes(hashes[a:b]), planes(counts[:, a:b].ravel())) for s, a, b in zip(held.tolist(), first.tolist(), last.tolist(), strict=True)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "block", "n", "hashes", "counts"])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def settle(keep: bool):
    """Of one shard: sum up what all blocks counted (or take a stored model's counts), and answer each block. keep: yield the sums, too."""

    def run(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        known = [r for r in rows if r["block"] is None]
        asks = [r for r in rows if r["block"] is not None]
        shard, out = rows[0]["shard"], []
        asked = [unplanes(r["hashes"], "<u8") for r in asks]
        if known:
            stored = known[0]
            hashes = unplanes(stored["hashes"], "<u8")
            total = matrix(stored["counts"], len(hashes))
            first = np.full(len(hashes), -1, np.int64)
        else:
            flat = np.concatenate(asked)
            counts = np.concatenate([matrix(r["counts"], r["n"]) for r in asks], 1)
            block = np.repeat(np.array([r["block"] for r in asks], np.int64), [r["n"] for r in asks])
            # Blocks that counted the n-gram as a type come first among those that only ask for it.
            order = np.lexsort([block, counts[COUNT] == 0, flat])
            flat, counts, block = flat[order], counts[:, order], block[order]
            opens = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            hashes, total = flat[opens], np.add.reduceat(counts, opens, 1)
            first = np.where(counts[COUNT][opens] > 0, block[opens], -1)
        hashes, total, first = mapped(hashes), mapped(total), mapped(first)
        for r, own in zip(asks, asked, strict=True):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            there = hashes[at] == own
            found = np.where(there, total[:, at], 0)
            mine = there & (first[at] == r["block"])
            out.append(("answer", shard, r["block"], len(own), np.packbits(mine).tobytes(), planes(found.ravel()), None))
        if keep:
            c, some, raw = total[COUNT], total.any(0), total[RAW] if len(total) > 1 else total[COUNT]
            types = [int((c > 0).sum()), int(c.sum()), *(int((c == i).sum()) for i in (1, 2, 3, 4)), int(raw.sum()), int((raw > 0).sum())]
            out.append(("model", shard, None, int(some.sum()), planes(hashes[some]), planes(np.ascontiguousarray(total[:, some]).ravel()), types))
        kinds = {"kind": pa.string(), "shard": pa.int32(), "block": pa.int64(), "n": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "types": pa.list_(pa.int64())}
        return pa.table({name: pa.array([r[i] for r in out], t) for i, (name, t) in enumerate(kinds.items())})

    return run


def answered(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shards' answers to a block about order k, in the order of its sorted hashes: FIELDS, and what is the block's to count."""
    own = sorted((r for r in rows.to_pylist() if r["k"] == k), key=lambda r: r["shard"])
    counts = np.concatenate([matrix(r["counts"], r["n"]) for r in own], 1)
    return counts, np.concatenate([np.unpackbits(np.frombuffer(r["hashes"], np.uint8), count=r["n"]) for r in own]).astype(bool)


def in_place(block: Block, k: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    counts, mine = answered(rows, k)
    order = np.argsort(block.hashes[k - 1], kind="stable")
    out, own = np.empty_like(counts), np.empty_like(mine)
    out[:, order], own[order] = counts, mine
    return out, own


@dataclass
class Model:
    """order; shards; levels: for each order the written table of its shards; sums: of each order types, their counts' sum, how many
    have count 1, 2, 3 and 4, occurrences, and different n-grams that occur."""

    order: int
    shards: int
    levels: dict[int, DataFrame]
    sums: dict[int, list[int]]

    def discounts(self, k: int) -> tuple[float, float, float]:
        """Modified Kneser-Ney discounts of counts of 1, 2 and more, by the counts of counts."""
        _, _, one, two, three, four = self.sums[k][:6]
        if not (one and two and three and four):
            return DISCOUNTS
        y = one / (one + 2 * two)
        found = (1 - 2 * y * two / one, 2 - 3 * y * three / two, 3 - 4 * y * four / three)
        return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1)) if min(found) > 0 else DISCOUNTS

    def unigrams(self) -> tuple[float, float, float, float]:
        """Sum of counts, mass left for unseen words, words to share it, and log10 base terms' denominator."""
        types, total, one, two = self.sums[1][:4]
        d = self.discounts(1)
        return float(total), d[0] * one + d[1] * two + d[2] * (types - one - two), types + 1.0, self.train_tokens + 0.5 * (self.sums[1][7] + 1)

    @property
    def train_tokens(self) -> int:
        return self.sums[1][6]


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)


def scores(block: Block, found: dict[int, np.ndarray], order: int, discounts: dict, unigram: tuple, names: list[str]) -> pa.Table:
    """Each document's sums over its tokens."""
    total, left, share, base = unigram
    tok, one = block.at[0], found[1]
    p = (discounted(one[COUNT], discounts[1]) + left / share) / total if total else np.full(one.shape[1], 1 / share)
    p = p[tok]
    for k in range(2, order + 1):
        there = np.flatnonzero(block.at[k - 1] >= 0)
        gram = block.at[k - 1][there]
        context = block.context[k - 1][gram]
        d, all_of = discounts[k], found[k - 1]
        mass = (d[0] * all_of[ONES] + d[1] * all_of[TWOS] + d[2] * all_of[MORE])[context]
        many = all_of[TOTAL][context]
        better = (discounted(found[k][COUNT][gram], d) + mass * p[there]) / np.maximum(many, 1)
        p[there] = np.where(many > 0, better, p[there])
    raw, n = one[RAW][tok], len(block.sizes)
    each = [np.bincount(block.owner, x, n) for x in (raw > 0, np.log10((raw + 0.5) / base), np.log10(p))]
    columns = [block.ids, pa.array(block.held), pa.array(block.sizes), pa.array(each[0].astype(np.int64)), pa.array(each[1]), pa.array(each[2])]
    return pa.table(columns, names=names)


def bucketed(df: DataFrame, label: str, n: int, on: str) -> tuple[DataFrame, str]:
    """A table in the shared folder that is written in buckets, so that later groupings by them need no shuffle; and its name."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, on).saveAsTable(name)
    return spark.table(name), name


def hashed_bytes(docs: DataFrame, text_col: str) -> int:
    """About 8 bytes for each token, of about 6 bytes."""
    return (docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) * 4 // 3


class _Run:
    """Blocks of one table of documents and the answers they got, order by order."""

    def __init__(self, docs: DataFrame, held, order: int, id_col: str, text_col: str, shards: int | None):
        self.spark: SparkSession = docs.sparkSession
        self.order, self.kind = order, docs.schema[id_col].dataType.simpleString()
        named = docs.select(F.col(f"`{id_col}`").alias("id"), held.alias("held"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
        self.shards = shards or buckets(self.spark, hashed_bytes(named, "text"))
        self.blocks, self.name = bucketed(blocks_of(named), "lm_blocks", max(8, self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))), "block")
        self.answers: DataFrame | None = None

    def ask(self, k: int) -> DataFrame:
        """What all blocks count of order k, by shard."""
        order, shards = self.order, self.shards
        if self.answers is None:

            def top(batches):
                for batch in batches:
                    for row in batch.to_pylist():
                        block = Block(row, order)
                        yield from ask(block, k, block.counts(k, order, None), shards)

            return self.blocks.drop("ids").mapInArrow(top, ASKED)

        def lower(own: pa.Table, answers: pa.Table) -> pa.Table:
            block = Block(own.to_pylist()[0], order)
            counts, mine = in_place(block, k + 1, answers)
            return pa.Table.from_batches(ask(block, k, block.counts(k, order, (counts[COUNT], mine)), shards))

        return self.blocks.drop("ids").groupBy("block").cogroup(self.answers.where(f"k = {k + 1}").groupBy("block")).applyInArrow(lower, ASKED)

    def settle(self, k: int, asked: DataFrame, keep: bool) -> DataFrame:
        out = materialize(asked.groupBy("shard").applyInArrow(settle(keep), SETTLED), f"lm-{k}")
        own = out.where("kind = 'answer'").select(F.lit(k).alias("k"), "shard", "block", "n", "hashes", "counts")
        self.answers = own if self.answers is None else self.answers.unionByName(own)
        return out

    def score(self, model: Model, names: list[str]) -> DataFrame:
        order, unigram, discounts = self.order, model.unigrams(), {k: model.discounts(k) for k in range(1, model.order + 1)}

        def final(own: pa.Table, answers: pa.Table) -> pa.Table:
            release()
            row = own.drop_columns(["ids"]).to_pylist()[0] | {"ids": own.column("ids").combine_chunks().flatten()}
            block = Block(row, order)
            found = {k: in_place(block, k, answers)[0] for k in range(1, order + 1)}
            return scores(block, found, order, discounts, unigram, names)

        kinds = [self.kind, "boolean", "long", "long", "double", "double"]
        return self.blocks.groupBy("block").cogroup(self.answers.groupBy("block")).applyInArrow(final, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 1 (a missing id: that of the empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _fit(run: _Run) -> Model:
    levels, sums = {}, {}
    for k in range(run.order, 0, -1):
        settled = run.settle(k, run.ask(k), True)
        levels[k] = settled.where("kind = 'model'")
        row = levels[k].select(*(F.sum(F.col("types")[i]).alias(f"s{i}") for i in range(8))).first()
        sums[k] = [int(x or 0) for x in row]
    return Model(run.order, run.shards, levels, sums)


NAMES = ["held_out", "n_tokens", "n_known", "base_score", "score"]


def _named(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    return rows.select(id_col, "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def train(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of all rows' texts; its tables lie in the shared folder."""
    return _fit(_Run(docs, F.lit(False), order, id_col, text_col, None))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score documents by a stored model: its shards are met by the hashes that the documents ask for. Columns and odd rows as in
    train_and_score; held_out is true, as nothing is learned."""
    run = _Run(docs, F.lit(True), model.order, id_col, text_col, model.shards)
    for k in range(model.order, 0, -1):
        stored = model.levels[k].select("shard", F.lit(None).cast("long").alias("block"), "n", "hashes", "counts")
        run.settle(k, run.ask(k).unionByName(stored), False)
    return _named(run.score(model, [id_col, *NAMES]), model, id_col)


def train_and_score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """Learn from all rows but those that `held` (a condition; held_out(id_col) by default) sets aside, and score every row.

    One row per document: id, held_out, n_tokens (words and the end), n_known (tokens that the training rows have), train_tokens, base_score (log10
    probability by additive smoothing of single tokens), score (log10 probability by the model), perplexity. Null texts are empty: the
    end token alone. Repeated rows are learned from each, and score alike; rows without an id take part. An empty table gives none. Without training
    rows, every token has the probability of one unknown word. Whole texts are read, a long one as a block of its own; other
    columns are not read. Words are told apart by 64-bit hashes, as are n-grams.
    """
    run = _Run(docs, held_out(id_col) if held is None else held, order, id_col, text_col, None)
    model = _fit(run)
    return _named(run.score(model, [id_col, *NAMES]), model, id_col)
