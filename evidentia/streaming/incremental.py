"""Scans of growing tables: features and counters over a stream of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import Thresholds, features
from ..stores.shared import shared_folder

__all__ = ["ADDITIVE", "additive", "shared_folder", "total", "write_batches"]

#: Counters that can be added up batch by batch.
ADDITIVE = ("scanned", "thin", "critical", "warning", "null_embeddings", "missing_metadata", "missing_timestamps")


def additive(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("scanned"), F.count("thin_reason").alias("thin"), F.count_if(F.col("risk") == "secret").alias("critical"), F.count_if(F.col("risk").isin("marker", "emails")).alias("warning"),
        F.count_if(F.col("embedding_dims").isNull()).alias("null_embeddings"), F.count_if(F.coalesce(F.size("metadata_keys"), F.lit(0)) <= 0).alias("missing_metadata"), F.count_if(~F.col("updated_present")).alias("missing_timestamps"),
    )


def write_batches(chunks: DataFrame, path: str, checkpoint: str, thresholds: Thresholds = Thresholds()) -> StreamingQuery:
    """Counters of every micro-batch under its number; a batch that is run again replaces itself, so sums count each chunk once."""

    def write(batch: DataFrame, number: int) -> None:
        additive(features(batch, thresholds)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(*(F.sum(c).alias(c) for c in ADDITIVE))
