"""An inverted file over vectors: approximate nearest neighbours that read a few lists instead of every vector.

The exact way (knn.nearest_neighbors) is the default: for one scan its matrix products cost about what assigning every vector to its list
costs. An index pays where it is kept: it is built once, gets new chunks appended, and each search reads only the lists that its probes ask for, as
they are the partitions of a table. Likenesses are exact; what is approximate is which vectors are looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stores.shared import kept
from . import knn

#: Vectors of one length that centroids are fitted on at most: those with the smallest hashes of their names.
SAMPLE = 50_000
#: Rounds of k-means, and its seed.
ROUNDS, SEED = 15, 42
#: Lists of one length of vectors at most; their centroids go to all tasks.
MAX_LISTS = 16_384
#: Lists that a probe looks into, as a share of all, and at least.
SHARE, LEAST = 0.05, 4


def usable(embedding) -> F.Column:
    """Vectors that have a direction: not empty, all elements finite, not all zero."""
    each = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(each, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """centroids: by length of vectors, a matrix of unit rows; list k of a length is the cell first[length] + k."""

    centroids: dict[int, np.ndarray]

    @property
    def first(self) -> dict[int, int]:
        out, at = {}, 0
        for d in sorted(self.centroids):
            out[d], at = at, at + len(self.centroids[d])
        return out

    def assign(self, chunks: DataFrame) -> DataFrame:
        """The chunks that have a usable vector of a known length, with the cell of their nearest centroid: one matrix product a batch."""
        centroids, first = self.centroids, self.first
        names = [c for c in chunks.columns if c != "embedding"]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                vectors = batch.column(batch.schema.get_field_index("embedding"))
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                begin = np.concatenate([[0], np.cumsum(lengths)])
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                cell = np.full(batch.num_rows, -1, np.int32)
                for d, m in centroids.items():
                    at = np.flatnonzero(lengths == d)
                    for a in range(0, len(at), step := max(1, knn.STEP_BYTES // (8 * max(d, len(m))))):
                        some = at[a : a + step]
                        cell[some] = first[d] + (flat[begin[some][:, None] + np.arange(d)] @ m.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*names, "embedding").schema)
        held = chunks.where(usable(F.col("embedding")) & F.size("embedding").isin(sorted(centroids))).select(*names, "embedding")
        return held.mapInArrow(run, f"{kinds}, cell int").where("cell >= 0")

    def nearest(self, vector: np.ndarray, look: int | None = None) -> list[int]:
        """Cells of the lists that a probe looks into, the nearest first; none for a vector without a direction or of an unknown length."""
        m = self.centroids.get(len(vector))
        norm = np.linalg.norm(vector) if m is not None else 0
        if m is None or not np.isfinite(norm) or norm == 0:
            return []
        look = look or max(LEAST, math.ceil(len(m) * SHARE))
        return (self.first[len(vector)] + np.argsort(-(m @ (vector / norm)), kind="stable")[:look]).tolist()


def fit(chunks: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Centroids by spherical k-means over a bounded sample, for each length of vectors that the table has.

    lists: of one length; by default the square root of its number of vectors. The sample is chosen by the hash of `ref`, so the same table
    gives the same one. A table without usable vectors gives an index without lists.
    """
    rows = chunks.where(usable(F.col("embedding"))).select("ref", "embedding", F.size("embedding").alias("d"))
    counts = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    centroids = {}
    for d, n in sorted(counts.items()):
        k = max(1, min(lists or round(n**0.5), n, MAX_LISTS))
        some = rows.where(F.col("d") == d).select("ref", "embedding", F.xxhash64("ref").alias("h")).orderBy("h", "ref").limit(sample).coalesce(1)
        some = some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
        if k == 1:
            centroids[d] = np.ones((1, d)) / d**0.5
            continue
        found = KMeans(k=k, seed=SEED, maxIter=ROUNDS, distanceMeasure="cosine", initSteps=2).fit(some)
        m = np.array(found.clusterCenters())
        centroids[d] = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return Index(centroids)


def nearest_neighbors(index: Index, vectors: DataFrame, probes: DataFrame, look: int | None = None) -> DataFrame:
    """The nearest other chunk of each probe among the lists it looks into: ref, ord, neighbor_ref, neighbor_ord, similarity.

    vectors: ref, ord, embedding, cell, as `assign` or stores.vectors.read give them; probes: ref, ord, embedding, a stated number of rows. Only the cells that some
    probe asks for are read. Ties, odd vectors and rounding are those of knn; a probe without a usable vector has no row.
    """
    rows = [(r["ref"], r["ord"], np.array(r["embedding"], np.float64)) for r in probes.where("embedding is not null").select("ref", "ord", "embedding").orderBy("ord", "ref").toLocalIterator()]
    asked = [index.nearest(v, look) for *_, v in rows]
    cells = sorted({c for held in asked for c in held})
    return knn.best_of(probes.sparkSession, rows, asked, vectors.where(F.col("cell").isin(cells)).select("ref", "ord", "embedding", "cell"))


def tune(index: Index, vectors: DataFrame, probes: DataFrame, goal: float = 0.95) -> int:
    """Lists that a probe must look into, so that `goal` of these probes find a neighbour as near as the exact one: measured, by doubling. How many
    that is depends on how far the vectors form groups; without groups it is a good part of all lists."""
    most = max((len(m) for m in index.centroids.values()), default=1)
    exact = kept(nearest_neighbors(index, vectors, probes, most), "exact")
    look = LEAST
    while look < most and recall(nearest_neighbors(index, vectors, probes, look), exact) < goal:
        look *= 2
    return min(look, most)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of probes whose neighbour is as near as the exact one."""
    both = exact.select("ref", F.col("similarity").alias("best")).join(found.select("ref", "similarity"), "ref", "left")
    row = both.agg(F.avg((F.coalesce(F.col("similarity"), F.lit(-2.0)) >= F.col("best") - knn.TIE).cast("double")).alias("r")).first()
    return 1.0 if row["r"] is None else row["r"]
