"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BASE_2, LOWER, bound_batches, byte_class, few, grams, large, let, materialize, mix, ranges, slices, utf8, word_hash, word_spans

#: Words of the k-grams whose minima are kept.
K = 5
#: Bits of a sieve for each fingerprint, and at most; a benchmark of more windows is taken in several passes.
SIEVE_SHARE, SIEVE_BITS = 32, 1 << 27

#: Bytes of words after lower-casing: digits, a to z, everything beyond ASCII.
WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
FOUND = "array<struct<place:int,n:int,full:bigint,phrase:binary>>"


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, word starts and ends, each text's first word, and word hashes."""
    lower = LOWER[data]
    starts, ends, first = word_spans(WORD[lower], offsets)
    return lower, starts, ends, first, word_hash(lower, starts, ends)


def phrase(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    """n words from word `at` on, with one space between them."""
    whole = lower[starts[at] : ends[at + n - 1]].tobytes()
    a = int(starts[at])
    return b" ".join([whole[s - a : e - a] for s, e in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)])


def minima(h: np.ndarray, n: int) -> np.ndarray:
    """Winnowing: of each window of n words the least hash of its K-grams."""
    k = min(K, n)
    each = grams(h, k)
    least = each[: len(h) - n + 1].copy()
    for i in range(1, n - k + 1):
        np.minimum(least, each[i : len(least) + i], out=least)
    return least


def full_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    full = h[at].copy()
    for i in range(1, n):
        full *= BASE_2
        full += h[at + i]
    return mix(full)


def benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """A table of the different windows of the items (item, text): n (words), print (the least hash), full (the hash of the
    whole window), phrase (its words), items (sorted), and of_items, a digest that names these. An item of fewer words than `width` is one window."""

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(large(batch.column(1)))
            names = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                lower, starts, ends, first, h = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows: dict[tuple[str, bytes], tuple[int, int, int]] = {}
                for k in range(b - a):
                    x, y = int(first[k]), int(first[k + 1])
                    n = min(width, y - x)
                    if not n:
                        continue
                    own = h[x:y]
                    least, full = minima(own, n).view(np.int64).tolist(), full_hash(own, np.arange(y - x - n + 1), n).view(np.int64).tolist()
                    for i, (p, f) in enumerate(zip(least, full, strict=True)):
                        rows[names[a + k], phrase(lower, starts, ends, x + i, n)] = (n, p, f)
                held = list(rows.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v[0] for _, v in held], pa.int32()), pa.array([v[1] for _, v in held], pa.int64()), pa.array([v[2] for _, v in held], pa.int64()), pa.array([k[1] for k, _ in held], pa.binary()), pa.array([k[0] for k, _ in held], pa.string())],
                    ["n", "print", "full", "phrase", "item"],
                )

    rows = items.mapInArrow(cut, "n int, print long, full long, phrase binary, item string")
    held = rows.groupBy("n", "print", "full", "phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Lengths in front keep apart what the joined names alone would not.
    named = F.concat(F.array_join(F.transform("items", lambda x: F.octet_length(x).cast("string")), ","), F.lit(";"), F.array_join("items", ","))
    return materialize(held.withColumn("of_items", F.unhex(F.sha2(named, 256))), "benchmark-windows")


def sieve(windows: DataFrame, column: str, size: int) -> np.ndarray:
    """Which remainders modulo `size` the column has; four bytes a window come to the driver, in one pass at most SIEVE_BITS / SIEVE_SHARE."""

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(np.asarray(batch.column(0), np.int64)).astype("<u4").tobytes()])], ["x"])

    bits = np.zeros(size, bool)
    for row in windows.select(F.pmod(column, F.lit(size))).mapInArrow(mark, "x binary").collect():
        bits[np.frombuffer(bytes(row["x"]), "<u4")] = True
    return np.packbits(bits)


def low_bits(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(held) - 1)).astype(np.int64)
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def candidates(docs: DataFrame, windows: DataFrame, width: int, all_rows: bool) -> DataFrame:
    """Of documents (text, id, print): id, print, n_words and the windows whose fingerprint and whole hash pass the sieves of
    the benchmark's (found: place, n, full, phrase); rows without any only if all_rows."""
    spark = docs.sparkSession
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # width numbers at most
    bits = 1 << max(16, (windows.count() * SIEVE_SHARE - 1).bit_length())
    least, whole = (spark.sparkContext.broadcast(sieve(windows, c, bits)) for c in ("print", "full"))
    kind = pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int32()), ("full", pa.int64()), ("phrase", pa.binary())]))

    def look(batches):
        for batch in batches:
            data, offsets = utf8(large(batch.column(0)))
            for a, b in slices(offsets):
                lower, starts, ends, first, h = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                owner = np.repeat(np.arange(b - a), np.diff(first))
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for n in sizes:
                    if len(h) < n:
                        continue
                    # A minimum holds for a run of windows; all windows of a run that passes are taken as a whole.
                    each = minima(h, n)
                    change = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
                    run = np.diff(np.append(change, len(each)))
                    maybe = np.flatnonzero(low_bits(least.value, each[change]))
                    at = ranges(change[maybe], run[maybe])
                    at = at[owner[at] == owner[at + n - 1]]
                    full = full_hash(h, at, n)
                    good = low_bits(whole.value, full)
                    for word, f in zip(at[good].tolist(), full[good].view(np.int64).tolist(), strict=True):
                        k = int(owner[word])
                        found[k].append({"place": word - int(first[k]), "n": n, "full": f, "phrase": phrase(lower, starts, ends, word, n)})
                keep = np.arange(b - a) if all_rows else np.array([k for k in range(b - a) if found[k]], np.int64)
                held = batch.slice(a, b - a).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([held.column(1), held.column(2), pa.array(np.diff(first)[keep], pa.int64()), pa.array([found[k] for k in keep.tolist()], kind)], ["id", "print", "n_words", "found"])

    id_kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(look, f"id {id_kind}, print long, n_words long, found {FOUND}")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(text.alias("text"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("print"))


def looked_up(docs: DataFrame, benchmark: DataFrame, width: int, all_rows: bool) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """The documents (id, print, n_words), if asked for, their occurrences of benchmark windows (id, print, place, n, of_items), and what of_items
    stands for (of_items, items): fingerprints and windows of both sides are joined, and a window's words compared as they are."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    windows = benchmark_windows(items, width)
    passes = max(1, -(-windows.count() * SIEVE_SHARE // SIEVE_BITS))
    rows, hits = None, []
    for k in range(passes):
        mine = materialize(windows.where(F.pmod(F.xxhash64("full"), F.lit(passes)) == k), "benchmark-part") if passes > 1 else windows
        held = materialize(candidates(docs, mine, width, all_rows and not k), "fingerprints")
        if all_rows and not k:
            rows = held.select("id", "print", "n_words")
        asked = held.select("id", "print", F.explode("found").alias("f")).select("id", "print", "f.*")
        hits.append(few(asked, mine.select("n", "full", "phrase", "of_items"), ["n", "full", "phrase"], "inner").select("id", "print", "place", "n", "of_items"))
    return rows, reduce(DataFrame.union, hits), windows.select("of_items", "items").dropDuplicates(["of_items"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which words of each document stand in windows of `width` consecutive words of benchmark items.

    One row per document: id, n_words, spans (disjoint hit spans [a, b) of word numbers), items
    (sorted ids, as text, of items with occurring windows). An item of fewer words is one window of its own; an item
    without words is none. Winnowing keeps the least hash of the K-grams of each window, of documents and
    benchmark alike, so every shared span of `width` words has a fingerprint in common. Documents' windows
    whose fingerprint passes a sieve of the benchmark's are joined with the benchmark's windows and compared word by word.

    Nothing of the benchmark but the sieve (SIEVE_SHARE bits a window, SIEVE_BITS at most) goes to all tasks; a larger
    benchmark is taken in passes. Texts are read once a pass and never shuffled. Null texts have no words.
    Repeated rows give a row each; equal item ids count once; a null item id is the empty text; ids are of
    any type. An empty table gives none. Whole texts are read; other columns are neither read nor changed.
    """
    rows, hits, items = looked_up(keyed(docs, id_col, text_col), benchmark, width, True)
    hits = materialize(hits, "hits")
    places = hits.groupBy("id", "print").agg(F.collect_set(F.struct("place", "n")).alias("hit"))
    # A window may stand in very many items: their names meet a document once for each different set of items, not for each occurrence.
    told = few(hits.select("id", "print", "of_items").distinct(), items, "of_items", "inner").groupBy("id", "print").agg(F.collect_set("items").alias("items"))
    told = told.select(F.col("id").alias("_ti"), F.col("print").alias("_tp"), "items")
    each = places.join(told, F.col("id").eqNullSafe(F.col("_ti")) & F.col("print").eqNullSafe(F.col("_tp")), "left")
    words = F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda h: F.sequence(h["place"], h["place"] + h["n"] - 1)))))
    spans = F.when(F.col("hit").isNotNull(), let(words, islands)).otherwise(F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"))
    names = F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.expr("cast(array() as array<string>)"))
    each = each.select(F.col("id").alias("_i"), F.col("print").alias("_p"), "hit", "items")
    rows = rows.join(each, F.col("id").eqNullSafe(F.col("_i")) & F.col("print").eqNullSafe(F.col("_p")), "left")
    return rows.select(F.col("id").alias(id_col), "n_words", spans.alias("spans"), names.alias("items"))


def islands(words: Column) -> Column:
    """Runs of consecutive numbers of a sorted array, as [a, b)."""
    begin = F.filter(words, lambda x, i: (i == 0) | (F.get(words, F.greatest(i - 1, F.lit(0))) < x - 1))
    end = F.filter(words, lambda x, i: (i == F.size(words) - 1) | (F.get(words, i + 1) > x + 1))
    return F.zip_with(begin, end, lambda a, b: F.struct(a.cast("long").alias("a"), (b + 1).cast("long").alias("b")))


def contamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Counts per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark, width)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any word in a benchmark window, all their columns unchanged, repeated rows each; rows of one id are
    judged each by its own text, null texts and ids stay like any others, an empty table stays empty."""
    names = docs.columns
    _, hits, _ = looked_up(keyed(docs, id_col, text_col), benchmark, width, False)
    gone = materialize(hits.select(F.col("id").alias("_i"), F.col("print").alias("_p")).distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"), F.xxhash64(F.col(f"`{text_col}`")).alias("_print"))
    same = F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_i")) & (F.col("_print") == F.col("_p"))
    return few(rows, gone, same, "left_anti").select("_row.*")
