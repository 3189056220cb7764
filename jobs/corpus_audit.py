"""Work list of a chunk table: one row per chunk with what its owner should do about it, and why.

Owners of a retrieval index act on chunks, not on scores. This job reads a table of chunks and one of vectors, judges every chunk by
the scan's own detectors, by its whole text, and writes the most urgent action of each, by language. Texts are never written.

    python -m jobs.corpus_audit --input hdfs:///tables --output hdfs:///audit [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from evidentia.functions.vectors import dims
from evidentia.operators.duplicates import keepers
from evidentia.operators.features import Thresholds, features
from evidentia.sources.chunks import chunk_view
from evidentia.sources.mapping import Mapping, quoted

from . import _run
from ._run import log

#: Columns of the output; language is its partition.
OUTPUT = "ref string, source string, action string, reason string, keep_ref string, content_hash string, length long, language string"
UNKNOWN = "unknown"


def chunks(spark: SparkSession, folder: str, config: dict) -> DataFrame:
    """The chunk table: key, content, source, language."""
    held = spark.read.parquet(f"{folder}/{config['chunks']}")
    text = lambda name: F.coalesce(F.nullif(F.trim(F.col(quoted(config[name])).cast("string")), F.lit("")), F.lit(UNKNOWN))
    return held.select(F.col(quoted(config["key"])).alias("key"), F.col(quoted(config["content"])).alias("content"), text("source").alias("source"), text("language").alias("language"))


def lengths(spark: SparkSession, folder: str, config: dict) -> DataFrame:
    """The length of each key's vector, of several the longest: key, dims."""
    v = config["vectors"]
    vectors = spark.read.parquet(f"{folder}/{v['table']}").select(F.col(quoted(v["key"])).alias("key"), dims(F.col(quoted(v["column"]))).alias("dims"))
    return vectors.groupBy("key").agg(F.max("dims").cast("int").alias("dims"))


def judged(table: DataFrame, vectors: DataFrame, config: dict) -> DataFrame:
    """Each chunk's facts, without its text. Texts are judged where they are read; facts and lengths alone are moved to meet."""
    view = chunk_view(table.withColumn("embedding", F.lit(None).cast("array<float>")), Mapping.of("chunks", "content", "embedding"), "key", keep=("key", "source", "language"), chars=None)
    rows = features(view, Thresholds(**config["thresholds"]))
    rows = rows.select("key", "ref", "ord", "source", "language", "content_hash", F.col("length").cast("long").alias("length"), "thin_reason", "risk")
    return rows.join(vectors, "key", "left").drop("key")


def actions(rows: DataFrame, usual_dims: int | None, large_chars: int) -> DataFrame:
    """The first of these that holds: a secret, an earlier copy, too little text, a marker or many addresses, a bad cut, too much
    text, no vector or one of another length. Rows of one key and one text are one chunk, none a copy of the other."""
    copies = F.col("first_ref").isNotNull() & (F.struct("ord", "ref") != F.struct("first_ord", "first_ref"))
    thin, risk = F.col("thin_reason"), F.col("risk")
    wrong = F.when(F.col("dims").isNull(), "missing").when(F.col("dims") != F.lit(usual_dims), "dimensions")
    found = [
        (risk == "secret", "purge_secret", F.lit("secret")),
        (copies, "drop_duplicate", F.lit("exact")),
        (thin.isin("short", "linkDensity"), "drop_thin", thin),
        (risk.isNotNull(), "review", risk),
        (thin.isNotNull(), "recut", thin),
        (F.col("length") >= large_chars, "recut", F.lit("large")),
        (wrong.isNotNull(), "embed", wrong),
    ]
    action, reason = F.lit("keep"), F.lit(None).cast("string")
    for condition, name, why in reversed(found):
        held = F.coalesce(condition, F.lit(False))
        action, reason = F.when(held, F.lit(name)).otherwise(action), F.when(held, why).otherwise(reason)
    return rows.select("ref", "source", action.alias("action"), reason.alias("reason"), F.when(copies, F.col("first_ref")).alias("keep_ref"), "content_hash", "length", "language")


def run(spark: SparkSession, input: str, output: str, config: dict | None = None) -> dict[str, int]:
    """Audit the chunk table under --input and write the work list under --output, by language. A rerun replaces it as a whole."""
    config = config or _run.defaults(__file__)
    facts = judged(chunks(spark, input, config), lengths(spark, input, config), config).persist(StorageLevel.DISK_ONLY)
    try:
        usual = facts.where("dims is not null").groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
        log.info("read %s: %d chunks, vectors of %s", f"{input}/{config['chunks']}", facts.count(), usual["dims"] if usual else "no length")
        out = actions(facts.join(keepers(facts), "content_hash", "left"), usual["dims"] if usual else None, config["large_chars"])
        # A language may hold a third of all rows: its rows go to several tasks, one file each.
        out = out.repartition(F.col("language"), F.pmod(F.xxhash64("ref"), F.lit(config["files_per_language"])))
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("language").parquet(output)
    finally:
        facts.unpersist()
    wrote = {r["action"]: r["count"] for r in read(spark, output).groupBy("action").count().collect()}
    log.info("wrote %s: %s", output, wrote)
    return wrote


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(output)


if __name__ == "__main__":
    _run.main("corpus_audit", __file__, run, {"input": "folder of the tables", "output": "folder of the work list"})
