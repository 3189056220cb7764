"""Kept inverted files: centroids, and the vectors by the partition of their cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ivf import Index

#: Tasks that a list's rows are dealt to when an index is written.
FILES = 4


def write(index: Index, chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keep an index: centroids, and every chunk's name, order and vector in the partition of its cell. mode `append` adds chunks to one that is there."""
    spark = chunks.sparkSession
    if mode == "overwrite":
        rows = [(index.first[d] + k, d, v.tolist()) for d, m in index.centroids.items() for k, v in enumerate(m)]
        spark.createDataFrame(rows, "cell int, d int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    held = index.assign(chunks.select("ref", F.col("ord").cast("long").alias("ord"), "embedding"))
    held = held.repartition(F.col("cell"), F.pmod(F.xxhash64("ref"), F.lit(FILES)))
    held.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("cell").parquet(f"{path}/vectors")


def read(spark: SparkSession, path: str) -> tuple[Index, DataFrame]:
    """A kept index and its vectors: ref, ord, embedding, cell."""
    by: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect():
        by.setdefault(r["d"], []).append(r["centroid"])
    vectors = spark.read.schema("ref string, ord long, embedding array<float>, cell int").parquet(f"{path}/vectors")
    return Index({d: np.array(m) for d, m in by.items()}), vectors
