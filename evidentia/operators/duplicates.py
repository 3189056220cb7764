"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stores.shared import kept

REFS = 5


def exact_groups(chunks: DataFrame, hold: bool = True) -> DataFrame:
    """Groups of two or more chunks of one normal form: content_hash, members, first_ord, refs (first five).

    Counting is combined before the shuffle. First refs come from a ranking that Spark limits to five
    rows of a hash in each task before it shuffles, so a hash of a third of all rows is no burden. Both read
    the same hashes: hold writes these (three small columns) to the shared folder, so that texts are normalised once; not
    needed where the chunks are kept already.
    """
    rows = chunks.select("content_hash", "ord", "ref")
    if hold:
        rows = kept(rows, "hashes")
    counted = rows.groupBy("content_hash").agg(F.count("*").alias("members"), F.min("ord").alias("first_ord")).where("members > 1")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("content_hash").orderBy("ord", "ref"))).where(F.col("_rank") <= REFS)
    refs = ranked.groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("_rank", "ref"))).alias("_refs"))
    return counted.join(refs, "content_hash").select("content_hash", "members", "first_ord", F.col("_refs.ref").alias("refs"))


def exact_summary(chunks: DataFrame) -> DataFrame:
    """exact_groups, exact_rows over all hashes."""
    counted = chunks.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("exact_rows"))


def keepers(chunks: DataFrame) -> DataFrame:
    """Of each group the chunk that stays, the first: content_hash, members, first_ord, first_ref. Counted with map-side combination."""
    counted = chunks.groupBy("content_hash").agg(F.count("*").alias("members"), F.min(F.struct("ord", "ref")).alias("_first")).where("members > 1")
    return counted.select("content_hash", "members", F.col("_first.ord").alias("first_ord"), F.col("_first.ref").alias("first_ref"))
