"""Packing of documents into token sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tokens
from ._shared import bound_batches, few, large, materialize, slices, utf8

#: A sequence has this many units at most; the linear program has a row for each length in units.
CLASSES = 512
#: Pieces of one length that are ranked together: so many at least, or so that there are about SALTS such groups; a
#: frequent length is dealt to as many salts as it needs.
TOGETHER, SALTS = 1_000, 100_000
#: The program ends when no pattern is worth more than 1 + TOLERANCE, or after so many columns, MANY a pricing at most.
TOLERANCE, MAX_COLUMNS, MANY = 1e-3, 4000, 24


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids every `capacity` tokens: id, start, length, ids_crc32, doc_tokens; and number, which counts the pieces of a task."""
    bound_batches(docs.sparkSession)
    proof = docs.sparkSession.sparkContext.broadcast(_tokens.prove(tokenizer))

    def cut(batches):
        held = _tokens.encoder(tokenizer, proof.value)
        end = np.array([] if end_id is None else [end_id], "<u4")
        number = 0
        for batch in batches:
            data, offsets = utf8(large(batch.column(1)))
            for a, b in slices(offsets, _tokens.STEP_BYTES):
                rows: tuple[list, ...] = ([], [], [], [], [])
                found, first = held.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found = found.astype("<u4")
                for at, x, y in zip(range(a, b), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ids = np.append(found[x:y], end)
                    n = len(ids)
                    for start in range(0, n, capacity):
                        part = ids[start : start + capacity]
                        for column, value in zip(rows, (at, start, len(part), zlib.crc32(part.tobytes()), n), strict=True):
                            column.append(value)
                numbers = pa.array(np.arange(number, number + len(rows[0])))
                number += len(rows[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:]), numbers], ["id", "start", "length", "ids_crc32", "doc_tokens", "number"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, number long")


def price(widths: np.ndarray, values: np.ndarray, size: int, many: int = MANY) -> tuple[float, list[np.ndarray]]:
    """The most valuable pattern within `size` units (unbounded knapsack by dynamic programming) and its value; after it
    the best patterns that are sure to have one given width, up to `many` in all."""
    worth = np.flatnonzero(values > 1e-12)
    w, v = widths[worth], values[worth]
    best = np.zeros(size + 1)
    took = np.full(size + 1, -1)
    reach = np.searchsorted(w, np.arange(size + 1), "right")
    for c in range(int(w[0]) if len(w) else size + 1, size + 1):
        total = best[c - w[: reach[c]]] + v[: reach[c]]
        j = int(total.argmax())
        if total[j] > best[c - 1] + 1e-12:
            best[c], took[c] = total[j], j
        else:
            best[c] = best[c - 1]

    def pattern(first: int | None) -> np.ndarray:
        out, c = np.zeros(len(widths), int), size
        if first is not None:
            out[worth[first]] += 1
            c -= w[first]
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                out[worth[took[c]]] += 1
                c -= w[took[c]]
        return out

    with_one = best[size - w] + v
    order = np.argsort(-with_one, kind="stable")[: many - 1]
    return float(best[size]), [pattern(None), *(pattern(int(j)) for j in order)]


def first_patterns(widths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis to begin with, how often each pattern of it is used, and the order in which the widths left: the largest widths
    that fit, again and again, each pattern as often as the first of its widths lasts, which then leaves. A pattern has no
    width that left before, so the patterns are independent, and triangular in that order."""
    m = len(widths)
    patterns, level, left, gone = np.zeros((m, m), int), np.zeros(m), demand.astype(float), []
    alive = np.arange(m)
    for _ in range(m):
        pattern, room, top = np.zeros(m, int), size, len(alive)
        while top := min(top, int(np.searchsorted(widths[alive], room, "right"))):
            k = alive[top - 1]
            pattern[k] = room // widths[k]
            room -= pattern[k] * widths[k]
            top -= 1
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        out = used[int(ratio.argmin())]
        patterns[out], level[out] = pattern, ratio.min()
        left = np.maximum(left - level[out] * pattern, 0)
        left[out] = 0
        alive = alive[alive != out]
        gone.append(out)
    return patterns, level, np.array(gone, np.int64)


def triangular_inverse(patterns: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The inverse of the basis (a column for each pattern), by substitution from the last that left to the first."""
    m = len(gone)
    upper = patterns[np.ix_(gone, gone)].astype(float)
    inverse = np.zeros((m, m))
    for k in range(m - 1, -1, -1):
        used = k + 1 + np.flatnonzero(upper[k, k + 1 :])
        inverse[k] = -(upper[k, used, None] * inverse[used]).sum(0)
        inverse[k, k] += 1
        inverse[k] /= upper[k, k]
    out = np.empty((m, m))
    out[np.ix_(gone, gone)] = inverse.T
    return out


def column_generation(widths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often the linear program uses them, to cover `demand` pieces of `widths`. It ends
    at the optimum or, as early, within TOLERANCE of what the tokens need without any gap. Sums and products stay within
    NumPy's own loops: the threads of a linear algebra library can block in a driver beside Spark."""
    m = len(widths)
    patterns, level, gone = first_patterns(widths, demand, size)
    inverse = triangular_inverse(patterns, gone)
    enough = (1 + TOLERANCE) * float((widths * demand).sum()) / size
    columns, duals = 0, np.maximum(inverse.sum(0), 0)
    while columns < MAX_COLUMNS and level.sum() > enough:
        value, found = price(widths, duals, size)
        if value <= 1 + TOLERANCE:
            break
        for pattern in found:
            used = np.flatnonzero(pattern)
            # Those that are still worth more than a sequence after the pivots before them.
            if (duals[used] * pattern[used]).sum() <= 1 + TOLERANCE:
                continue
            step = (inverse[:, used] * pattern[used]).sum(1)
            ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
            out = int(ratio.argmin())
            inverse[out] /= step[out]
            others = np.arange(m) != out
            inverse[others] -= np.outer(step[others], inverse[out])
            level = np.maximum(level - ratio[out] * step, 0)
            level[out] = ratio[out]
            patterns[out] = pattern
            columns, duals = columns + 1, np.maximum(inverse.sum(0), 0)
    return patterns, level


def plan(classes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Which ranks of each class go where: rows (class, first rank, per sequence, first sequence), sorted.

    The program's patterns are used as often as their whole part says; what they leave, at most a
    sequence or so for each pattern, is filled by first fit over the classes from the largest down.
    """
    left, rows, sequence = counts.copy(), [], 0
    at = np.zeros(len(classes), np.int64)

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        for k in np.flatnonzero(pattern):
            rows.append((classes[k], at[k], pattern[k], sequence))
            at[k] += times * pattern[k]
            left[k] -= times * pattern[k]
        sequence += times

    if len(classes) and classes[-1] == size:  # full pieces stand alone
        use(np.eye(len(classes), dtype=np.int64)[-1], int(left[-1]))
    if small := int((classes < size).sum()):
        patterns, level = column_generation(classes[:small], counts[:small], size)
        for k in np.argsort(-level, kind="stable"):
            pattern = np.zeros(len(classes), np.int64)
            pattern[:small] = patterns[k]
            used = pattern > 0
            times = min(int(level[k] + 1e-6), int((left[used] // pattern[used]).min()) if used.any() else 0)
            if times > 0:
                use(pattern, times)
    while left.any():
        pattern, room = np.zeros(len(classes), np.int64), size
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], room // classes[k])
            room -= pattern[k] * classes[k]
        used = pattern > 0
        use(pattern, int((left[used] // pattern[used]).min()))
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def bundles(lengths: np.ndarray, counts: np.ndarray, capacity: int, width: int) -> dict[str, np.ndarray]:
    """How pieces of each length become entries of the program, whose unit is `width` tokens, arrays by length:
    each (pieces of a bundle), full (bundles), their class and first rank, and class and first rank of those left over.

    As many pieces of one length as make a whole number of units are one entry, so nothing is lost by rounding; the few
    that are left of each length, and pieces too long for it, are rounded up one by one."""
    each = width // np.gcd(width, lengths)
    each = np.where(each * lengths <= capacity, each, 1)
    whole = each * lengths % width == 0
    full = np.where(whole, counts // each, 0)
    kinds = {"bundle": (np.where(whole, each * lengths // width, 0), full), "single": (-(-lengths // width), counts - full * each)}
    out = {"each": each, "full": full}
    total = np.zeros(capacity // width + 2, np.int64)
    for name, (kind, n) in kinds.items():
        order = np.argsort(kind, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        opens = np.searchsorted(kind[order], kind[order])
        first = np.zeros(len(lengths), np.int64)
        first[order] = before - before[opens] + total[kind[order]] if len(order) else before
        np.add.at(total, kind, n)
        out |= {f"{name}_class": kind, f"{name}_first": first}
    total[0] = 0
    return out | {"total": total}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids into sequences of at most `capacity` tokens.

    One row per piece: id, start (the document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (gapless from 0 within the sequence). Documents are cut only every `capacity`
    tokens. The histogram of exact lengths (at most `capacity` numbers) goes to the driver, which solves the
    cutting-stock program over bundles (see `bundles`) in units of capacity / CLASSES tokens; pieces are ranked within
    their length, by as many salts as the length needs, and ranks are dealt to the patterns' places. Only
    the plan, bounded by classes, goes to the executors.

    Null and empty texts are end_id alone (without end_id: no row). Repeated rows are packed each.
    An empty table gives no rows. Long texts are encoded whole, whatever their ids' type. Other columns are not read.
    """
    spark = docs.sparkSession
    width = -(-capacity // CLASSES)
    size = capacity // width
    capacity_in_units = size * width  # a capacity that is no multiple of the unit: only its whole units are filled with several pieces
    rows = materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    # At most `capacity` rows, whatever the input.
    counted = sorted((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    lengths, counts = np.array([x for x, _ in counted], np.int64), np.array([n for _, n in counted], np.int64)
    held = bundles(np.minimum(lengths, capacity_in_units), counts, capacity_in_units, width)
    classes = np.flatnonzero(held["total"])
    places = plan(classes, held["total"][classes], size)
    together = max(TOGETHER, sum(n for _, n in counted) // SALTS)
    salts = spark.createDataFrame([(x, int(-(-n // together))) for x, n in counted], "length long, salts int")
    rows = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("number"), F.col("salts")).cast("int")).drop("salts", "number")
    # SALTS rows or so, and one for each length; summed up on the executors.
    offsets = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = materialize(offsets.select("length", "salt", before.alias("before")), "salts")
    order = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32", "doc_tokens")
    ranked = few(rows.withColumn("rank", F.row_number().over(order)), offsets, ["length", "salt"], "inner")
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank") - 1).alias("rank"))
    first = np.searchsorted(places[:, 0], np.arange(size + 2))

    def deal(batches):
        for batch in batches:
            at, rank = np.searchsorted(lengths, np.asarray(batch.column(2))), np.asarray(batch.column(5))
            each, single = held["each"][at], rank >= (held["full"] * held["each"])[at]
            kind = np.where(single, held["single_class"][at], held["bundle_class"][at])
            entry = np.where(single, held["single_first"][at] + rank - (held["full"] * held["each"])[at], held["bundle_first"][at] + rank // each)
            row = np.zeros(len(kind), np.int64)
            for k in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == k)
                a, b = first[k], first[k + 1]
                row[mine] = a + np.searchsorted(places[a:b, 1], entry[mine], "right") - 1
            within = entry - places[row, 1]
            found = (places[row, 3] + within // places[row, 2], kind, entry, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], [*batch.schema.names[:5], "sequence_id", "class", "entry", "rank"])

    kind = rows.schema["id"].dataType.simpleString()
    dealt = ranked.mapInArrow(deal, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, class long, entry long, rank long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "entry", "length", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"))
