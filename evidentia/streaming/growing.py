"""Scans of growing tables: summaries of each micro-batch that add up to those of the whole table.

A batch is summed up once, when it arrives, and its summary is written under its number; a batch that is run again replaces its own. What
is told of the whole table is made of the summaries alone, so no text is read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..operators.duplicates import REFS
from ..operators.features import LARGE_CHARS

#: First hexadecimal digits of a hash that name a part of the groups.
SHARD_DIGITS = 1


def _first(rows: DataFrame, by: list[str], refs: int) -> DataFrame:
    """The first rows of each key by ord and ref. Spark limits the ranking in each task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("ord", "ref"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= refs)


def partial_groups(chunks: DataFrame, refs: int = REFS) -> DataFrame:
    """Of a batch of chunks (content_hash, ord, ref), each hash once: members, and the first chunks as (ord, ref). Hashes of
    one chunk are kept, as a later batch may hold another."""
    rows = chunks.select("content_hash", "ord", "ref")
    counted = rows.groupBy("content_hash").agg(F.count("*").alias("members"))
    first = _first(rows, ["content_hash"], refs).groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("ord", "ref"))).alias("first"))
    return counted.join(first, "content_hash")


def merged_groups(parts: DataFrame, refs: int = REFS) -> DataFrame:
    """Groups of two or more chunks over all batches: content_hash, members, first_ord, refs, as operators.duplicates.exact_groups has them.
    A hash brings a few references for each batch, whatever its number of chunks."""
    counted = parts.groupBy("content_hash").agg(F.sum("members").alias("members")).where("members > 1")
    rows = parts.select("content_hash", F.inline("first")).join(counted.select("content_hash"), "content_hash", "left_semi")
    first = _first(rows, ["content_hash"], refs).groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("_rank", "ord", "ref"))).alias("f"))
    return counted.join(first, "content_hash").select("content_hash", "members", F.col("f")[0]["ord"].alias("first_ord"), F.col("f.ref").alias("refs"))


def partial_profile(rows: DataFrame, by: str) -> DataFrame:
    """Of a batch of features, for each value of `by` and each length: chunks, and how many are thin, risky and without a vector; and a sketch
    of the documents. The histogram of lengths adds up exactly, the sketch within its error (about 0.8 % at 14 bits)."""
    counts = (F.count("*").alias("chunks"), F.count("thin_reason").alias("thin"), F.count("risk").alias("risky"), F.count_if(F.col("embedding_dims").isNull()).alias("null_embeddings"))
    return rows.groupBy(by, F.col("length").cast("long").alias("length")).agg(*counts, F.hll_sketch_agg("document_id", F.lit(14)).alias("documents"))


def merged_profile(parts: DataFrame, by: str, percentiles: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Over all batches, for each value of `by`: chunks, thin, risky, null_embeddings, large, max_chars, documents (estimated) and the nearest-rank
    percentiles of lengths, exact. The histogram has a row per length, so running sums over it are small."""
    sums = ("chunks", "thin", "risky", "null_embeddings")
    lengths = parts.groupBy(by, "length").agg(*(F.sum(c).alias(c) for c in sums), F.hll_union_agg("documents").alias("documents"))
    upto = F.sum("chunks").over(Window.partitionBy(by).orderBy("length"))
    total = F.sum("chunks").over(Window.partitionBy(by))
    lengths = lengths.withColumns({"_upto": upto, "_total": total})
    least = lambda p: F.min(F.when(F.col("_upto") * 100 >= F.col("_total") * p, F.col("length"))).alias(f"p{p}_chars")
    large = F.coalesce(F.sum(F.when(F.col("length") >= LARGE_CHARS, F.col("chunks"))), F.lit(0)).alias("large")
    return lengths.groupBy(by).agg(*(F.sum(c).alias(c) for c in sums), large, F.max("length").alias("max_chars"), F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("documents"), *map(least, percentiles))


def summed_up(stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Start to take all that is new in a stream: each micro-batch's summary is written under its number. A checkpoint remembers what was
    taken. The stream's rows should be narrow by now, hashes and features without texts: a batch is kept on disk while it is summed up, so that its texts are read once."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist(StorageLevel.DISK_ONLY)
        try:
            summarise(held).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches' summaries; none yet is an empty table."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
