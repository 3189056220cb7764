"""Nearest neighbours of probe chunks, and near duplicates among them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stores.shared import kept

#: Bytes of probe vectors that go to the executors at once; more probes are taken in blocks of that size.
PROBE_BYTES = 64 << 20
#: Bytes of vectors, and of likenesses, that one matrix product works on.
STEP_BYTES = 32 << 20
#: Probes whose names, and their neighbours', are sent to all tasks at most; those of more are joined by a shuffle.
SENT = 100_000
#: Probes whose names, and their neighbours', are part of a query at most.
NAMED = 5_000
#: Likenesses that differ by less are equal.
DIGITS, TIE = 12, 1e-12


def best_of(spark: SparkSession, rows: list[tuple], asked: list[list[int]], corpus: DataFrame) -> DataFrame:
    """The nearest other row of each probe, by cosine, among the corpus's rows of the cells it asks for: ref, ord, neighbor_ref, neighbor_ord, similarity.

    rows: probes (ref, ord, vector), a stated number; asked: cells of each; corpus: ref, ord, embedding, cell. Probes go to all tasks in blocks of
    bounded size, each vector once, whatever number of cells it asks for; each batch of the corpus is one matrix product for each cell, a task gives one row
    per probe, and partial maxima meet in the shuffle.
    """
    sizes = [8 * (len(v) + len(a)) for (*_, v), a in zip(rows, asked, strict=True)]
    step = max(1, len(rows) * PROBE_BYTES // max(PROBE_BYTES, sum(sizes)))
    schema = "probe int, similarity double, neighbor_ord long, neighbor_ref string"
    out = None

    def search(block):
        by_length: dict = {}
        for k, ref, v in block:
            by_length.setdefault(len(v), []).append((k, ref, v))
        units = {}
        for d, g in by_length.items():
            m = np.stack([v for *_, v in g])
            with np.errstate(invalid="ignore", over="ignore"):
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            # Pairs of a cell and a probe's place, by cell: eight bytes each.
            pairs = np.concatenate([np.asarray(asked[k], np.int32) for k, *_ in g])
            who = np.repeat(np.arange(len(g), dtype=np.int32), [len(asked[k]) for k, *_ in g])
            by_cell = np.argsort(pairs, kind="stable")
            units[d] = (np.array([k for k, *_ in g], np.int32), [ref for _, ref, _ in g], m, pairs[by_cell], who[by_cell])

        def run(batches):
            # The best so far of each probe, over all batches and cells of the task: likeness, order and name.
            held = {d: (np.full(len(ks), -np.inf), np.zeros(len(ks), np.int64), np.full(len(ks), None, object)) for d, (ks, *_) in units.items()}
            for batch in batches:
                vectors = batch.column(2)
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                cells = np.asarray(batch.column(3))
                begin = np.concatenate([[0], np.cumsum(lengths)])
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                refs, ords = (batch.column(i).to_pylist() for i in range(2))
                for d in set(lengths.tolist()) & set(units):
                    if not d:
                        continue
                    _, names, units_of, pairs, who = units[d]
                    most_of, ord_of, ref_of = held[d]
                    here = np.flatnonzero(lengths == d)
                    here = here[np.argsort(cells[here], kind="stable")]
                    found, starts = np.unique(cells[here], return_index=True)
                    for cell, at in zip(found.tolist(), np.split(here, starts[1:]), strict=True):
                        asking = who[np.searchsorted(pairs, cell) : np.searchsorted(pairs, cell, "right")]
                        if not len(asking):
                            continue
                        m = units_of[asking]
                        order = at[np.argsort(np.array([ords[i] for i in at], np.int64), kind="stable")]
                        place = {refs[i]: j for j, i in enumerate(order)}
                        mine = np.array([place.get(names[p], -1) for p in asking])
                        best, value = np.zeros(len(asking), np.int64), np.full(len(asking), -np.inf)
                        step = max(1, STEP_BYTES // (8 * max(d, len(asking))))
                        for a in range(0, len(order), step):
                            x = flat[begin[order[a : a + step]][:, None] + np.arange(d)]
                            with np.errstate(invalid="ignore", over="ignore"):
                                sim = m @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                            sim[~np.isfinite(sim)] = -np.inf
                            own = np.flatnonzero((mine >= a) & (mine < a + len(x)))
                            sim[own, mine[own] - a] = -np.inf
                            # Sums of products differ in their last bits with the shape of a product: what is closer than that is a tie.
                            most = sim.max(1)
                            top = (sim >= most[:, None] - TIE).argmax(1)
                            most = np.round(most, DIGITS)
                            better = most > value
                            best[better], value[better] = a + top[better], most[better]
                        for p, v, i in zip(asking.tolist(), value.tolist(), order[best].tolist(), strict=True):
                            if v > most_of[p] or (v == most_of[p] > -np.inf and ords[i] < ord_of[p]):
                                most_of[p], ord_of[p], ref_of[p] = v, ords[i], refs[i]
            for d, (most_of, ord_of, ref_of) in held.items():
                at = np.flatnonzero(most_of > -np.inf)
                columns = [pa.array(units[d][0][at]), pa.array(most_of[at]), pa.array(ord_of[at]), pa.array(ref_of[at].tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["probe", "similarity", "neighbor_ord", "neighbor_ref"])

        return run

    for a in range(0, max(1, len(rows)), step):
        block = [(k, rows[k][0], rows[k][2]) for k in range(a, min(a + step, len(rows)))]
        part = corpus.mapInArrow(search(block), schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("probe").agg(F.max_by(F.struct("similarity", "neighbor_ref", "neighbor_ord"), F.struct("similarity", -F.col("neighbor_ord"))).alias("b"))
    named = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "probe int, ref string, ord long")
    return named.join(best, "probe").select("ref", "ord", "b.neighbor_ref", "b.neighbor_ord", "b.similarity")


def nearest_neighbors(chunks: DataFrame, probes: int, hashes: DataFrame | None = None) -> DataFrame:
    """The nearest other chunk, by cosine, of each of the first `probes` chunks that have an embedding.

    ref, ord, content_hash, neighbor_ref, neighbor_hash, similarity. Only vectors of one length are compared;
    of equal likenesses the first chunk counts; a probe without any neighbour has no row. A vector with a null, NaN or
    infinite element has no likeness to any other, as probe or neighbour; neither has one of zeros only, but 0. The neighbours, two
    rows a probe at most, are found once and held by the driver and the tasks, not in a cache. hashes: ref and content_hash of all chunks, where they
    are kept already; else they are computed for probes and neighbours.
    """
    spark = chunks.sparkSession
    first = chunks.where("embedding is not null").select("ref", "ord", "embedding").orderBy("ord", "ref").limit(probes)
    rows = [(r["ref"], r["ord"], np.array(r["embedding"], np.float64)) for r in first.toLocalIterator()]
    corpus = chunks.where("embedding is not null").select("ref", F.col("ord").cast("long").alias("ord"), "embedding", F.lit(0).alias("cell"))
    found = best_of(spark, rows, [[0]] * len(rows), corpus)
    found = spark.createDataFrame([tuple(r) for r in found.toLocalIterator()], found.schema)
    return hashed(found, chunks if hashes is None else hashes, len(rows))


def hashed(found: DataFrame, chunks: DataFrame, probes: int) -> DataFrame:
    """Neighbours with the hashes of both contents: ref, ord, content_hash, neighbor_ref, neighbor_hash, similarity. Texts are normalised and
    hashed for probes and their neighbours alone, once."""
    asked = found.select(F.explode(F.array("ref", "neighbor_ref")).alias("ref")).distinct()
    if probes <= NAMED:
        # A filter goes below the columns of the view and the joins it is made of, a join does not: other rows' texts are neither moved nor hashed.
        names = [r["ref"] for r in asked.where("ref is not null").collect()]
        hashes = chunks.select("ref", "content_hash").where(F.col("ref").isin(names)).dropDuplicates(["ref"])
    else:
        hashes = chunks.select("ref", "content_hash").join(F.broadcast(asked) if probes <= SENT else asked, "ref").dropDuplicates(["ref"])
    if probes <= SENT:
        hashes = F.broadcast(chunks.sparkSession.createDataFrame([tuple(r) for r in hashes.toLocalIterator()], hashes.schema))
    own, other = hashes, hashes.select(F.col("ref").alias("neighbor_ref"), F.col("content_hash").alias("neighbor_hash"))
    return found.join(own, "ref").join(other, "neighbor_ref").select("ref", "ord", "content_hash", "neighbor_ref", "neighbor_hash", "similarity")


#: Of all vectors of one length: bytes of a block at most, and blocks at least, if each has so many rows.
BLOCK_BYTES, BLOCKS, BLOCK_ROWS = 64 << 20, 16, 1024
#: Rows of one product, and what a product of single precision may miss.
TILE, SLACK = 2048, 1e-4


def all_near(chunks: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """The nearest other chunk, by cosine, of each chunk that has one at or above the threshold: ref, ord, neighbor_ref, neighbor_ord, similarity; and how many
    chunks have a neighbour at all. No chunk is left out and none goes through the driver.

    Vectors of one length are dealt to blocks by a hash of their names; each two blocks meet once, in one task, by products of bounded size, and partial
    maxima meet in a shuffle. A block is sent once for each block of its length: what is moved and computed grows with the square of the vectors, as
    the question does; memory does not. Ties and vectors without likenesses as in nearest_neighbors.
    """
    vectors = chunks.where("embedding is not null").select("ref", F.col("ord").cast("long").alias("ord"), "embedding")
    vectors = kept(vectors.withColumns({"d": F.size("embedding"), "h": F.xxhash64("ref")}), "vectors")
    sizes = {r["d"]: r["n"] for r in vectors.where("d > 0").groupBy("d").agg(F.count("*").alias("n")).collect()}
    of = {d: max(1, min(BLOCKS, -(-n // BLOCK_ROWS)), -(-n * 8 * d // BLOCK_BYTES)) for d, n in sizes.items()}

    def pack(batches):
        for batch in batches:
            ref, ord_, embedding, d, h = batch.columns
            d, h = np.asarray(d), np.asarray(h)
            begin = np.concatenate([[0], np.cumsum(d)])
            flat = embedding.flatten().to_numpy(zero_copy_only=False)
            # Nulls become NaN.
            flat = flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)
            ord_ = np.asarray(ord_.fill_null(0), np.int64)
            rows = []
            for size in sorted(set(d.tolist()) - {0}):
                here = np.flatnonzero(d == size)
                x = flat[begin[here][:, None] + np.arange(size)]
                fine = np.isfinite(x).all(1)
                here, x = here[fine], x[fine]
                block = h[here] % of[size]
                for k in np.unique(block).tolist():
                    at = np.flatnonzero(block == k)
                    rows.append((size, of[size], k, len(at), ref.take(pa.array(here[at])).to_pylist(), ord_[here[at]].tobytes(), x[at].astype(np.float64 if x.dtype == np.float64 else np.float32).tobytes(), x.dtype.itemsize))
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "blocks", "block", "n", "refs", "ords", "vectors", "width"])

    packs = kept(vectors.where("d > 0").mapInArrow(pack, "d int, blocks int, block int, n long, refs array<string>, ords binary, vectors binary, width int"), "blocks")
    probes = packs.groupBy("d").agg(F.sum("n").alias("n")).where("n > 1").agg(F.sum("n")).first()[0] or 0

    def near_of_blocks(a: tuple, b: tuple, same: bool) -> list[tuple]:
        """Of two blocks (names' numbers, orders, unit vectors; by order) the nearest row of the other for each row of both that has one at or above the threshold:
        for either side places, the other's places and likenesses."""
        sides = [(np.zeros(len(x[1]), np.int64), np.full(len(x[1]), -np.inf)) for x in (a, b)]
        single = [x[2].astype(np.float32) for x in (a, b)]
        for p in range(0, len(a[1]), TILE):
            for q in range(p if same else 0, len(b[1]), TILE):
                rough = single[0][p : p + TILE] @ single[1][q : q + TILE].T >= threshold - SLACK
                rows, cols = np.flatnonzero(rough.any(1)) + p, np.flatnonzero(rough.any(0)) + q
                if not len(rows):
                    continue
                # What may be near enough is taken again, exactly.
                sim = np.round(a[2][rows] @ b[2][cols].T, DIGITS)
                sim[(sim < threshold) | (a[0][rows][:, None] == b[0][cols][None, :])] = -np.inf
                for (place, value), mine, others, s in ((sides[0], rows, cols, sim), (sides[1], cols, rows, sim.T)):
                    # Rows and blocks are by order, so the first of equal ones is the first in order.
                    top = s.argmax(1)
                    most = s[np.arange(len(mine)), top]
                    better = most > value[mine]
                    place[mine[better]], value[mine[better]] = others[top[better]], most[better]
        out = [(np.flatnonzero(value > -np.inf), place, value) for place, value in sides]
        if same:
            # One block, seen from above and from below the diagonal: the better of both, of equal ones the first.
            (place, value), (place_2, value_2) = sides
            swap = (value_2 > value) | ((value_2 == value) & (place_2 < place))
            place, value = np.where(swap, place_2, place), np.where(swap, value_2, value)
            out = [(np.flatnonzero(value > -np.inf), place, value)]
        return [(at, place[at], value[at]) for at, place, value in out]

    def meet(table: pa.Table) -> pa.Table:
        blocks = np.asarray(table.column("block").combine_chunks())
        held = []
        for k in sorted(set(blocks.tolist())):
            rows = table.take(pa.array(np.flatnonzero(blocks == k)))
            refs = np.array([r for x in rows.column("refs").to_pylist() for r in x], object)
            ords = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("ords")])
            d = rows.column("d")[0].as_py()
            x = np.concatenate([np.frombuffer(v.as_buffer(), np.float32 if w.as_py() == 4 else np.float64).astype(np.float64).reshape(-1, d) for v, w in zip(rows.column("vectors"), rows.column("width"), strict=True)])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            order = np.argsort(ords, kind="stable")
            held.append((refs[order], ords[order], x[order]))
        names: dict = {}
        numbers = [np.array([names.setdefault(r, len(names)) for r in refs], np.int64) for refs, *_ in held]
        a, b = held[0], held[-1]
        found = near_of_blocks((numbers[0], *a[1:]), (numbers[-1], *b[1:]), len(held) == 1) if table.num_rows else []
        # Of two blocks one may have no rows.
        if table.column("i")[0].as_py() != table.column("j")[0].as_py() and len(held) == 1:
            found = []
        parts = [(mine[0][at], mine[1][at], other[0][place], other[1][place], value) for (mine, other), (at, place, value) in zip(((a, b), (b, a)), found, strict=False)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (object, np.int64, object, np.int64, np.float64)]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c.tolist(), t) for c, t in zip(columns, kinds, strict=True)], ["ref", "ord", "neighbor_ref", "neighbor_ord", "similarity"])

    pairs = packs.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")})
    best = pairs.groupBy("d", "i", "j").applyInArrow(meet, "ref string, ord long, neighbor_ref string, neighbor_ord long, similarity double")
    best = best.groupBy("ref", "ord").agg(F.max_by(F.struct("neighbor_ref", "neighbor_ord", "similarity"), F.struct("similarity", -F.col("neighbor_ord"))).alias("b"))
    return best.select("ref", "ord", "b.*"), probes


def hashed_all(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours of any number with the hashes of both contents, by joins; as hashed."""
    hashes = chunks.select("ref", "content_hash").dropDuplicates(["ref"])
    other = hashes.select(F.col("ref").alias("neighbor_ref"), F.col("content_hash").alias("neighbor_hash"))
    return found.join(hashes, "ref").join(other, "neighbor_ref").select("ref", "ord", "content_hash", "neighbor_ref", "neighbor_hash", "similarity")


def near_pairs(neighbors: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs of different content at or above the threshold; of a pair found twice the first probe's row."""
    rows = neighbors.where((F.col("similarity") >= threshold) & (F.col("content_hash") != F.col("neighbor_hash")))
    return (
        rows.groupBy(F.least("ref", "neighbor_ref").alias("low"), F.greatest("ref", "neighbor_ref").alias("high"))
        .agg(F.min(F.struct("ord", "ref", "neighbor_ref", "similarity")).alias("r")).select("r.*")
    )
