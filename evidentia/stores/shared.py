"""The folder that all executors share, and tables that are kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; only a local run may do without, in a folder that goes at its end."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="evidentia-stream-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder and read back, for what is read twice: it survives lost executors and holds none of their memory.
    Its files stay until that folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
