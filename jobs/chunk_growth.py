"""Exact duplicates of a chunk table that grows: takes the files that are new, and brings the list of duplicate groups up to date.

A folder of Parquet files gets new files as chunks are ingested. Each run reads those that no run before has taken (the stream's checkpoint
knows), hashes their chunks' normal forms and writes one summary for each micro-batch; the groups are made of all summaries,
so a chunk that is equal to one of last month is found without reading last month's text. A run that is stopped is taken up again: its
batch is written once more in the same place. Without new files, the groups stay as they are.

    python -m jobs.chunk_growth --input hdfs:///chunks --output hdfs:///growth --checkpoint hdfs:///growth-checkpoint [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.chunks import chunk_view
from evidentia.sources.mapping import Mapping, quoted
from evidentia.streaming import growing

from . import _run
from ._run import log

#: The output's columns; shard, the first digit of the hash, is its partition.
OUTPUT = "content_hash string, members long, first_ord {ord}, refs array<string>, shard string"


def hashed(rows: DataFrame, config: dict) -> DataFrame:
    """Each chunk's name and the hash of its normal form."""
    table = rows.select(F.col(quoted(config["key"])).alias("key"), F.col(quoted(config["content"])).alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    return chunk_view(table, Mapping.of("chunks", "content", "embedding"), "key").select("content_hash", "ord", "ref")


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Take the new files under --input (a folder or a pattern), keep what was taken in --checkpoint, and bring the groups under --output up to date."""
    config = config or _run.defaults(__file__)
    kind = spark.read.parquet(input).schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(input)
    query = growing.summed_up(hashed(stream, config), lambda batch: growing.partial_groups(batch, config["refs"]), f"{output}/summaries", checkpoint)
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %s: %d new chunks in %d batches", input, taken, sum(p["numInputRows"] > 0 for p in query.recentProgress))
    ord_kind = kind[config["key"]].dataType.simpleString()
    parts = growing.summaries(spark, f"{output}/summaries", f"content_hash string, members long, first array<struct<ord:{ord_kind},ref:string>>")
    groups = growing.merged_groups(parts, config["refs"]).withColumn("shard", F.substring("content_hash", 1, growing.SHARD_DIGITS))
    groups.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("shard").parquet(f"{output}/groups")
    n = read(spark, output, ord_kind).count()
    log.info("wrote %s: %d groups", f"{output}/groups", n)
    return {"taken": taken, "groups": n}


def read(spark: SparkSession, output: str, ord_kind: str = "long") -> DataFrame:
    """The groups as they stand."""
    return spark.read.schema(OUTPUT.format(ord=ord_kind)).parquet(f"{output}/groups")


if __name__ == "__main__":
    _run.main("chunk_growth", __file__, run, {"input": "folder or pattern of the chunk files", "output": "folder of summaries and groups", "checkpoint": "folder of the stream's checkpoint"})
