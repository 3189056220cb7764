"""Stale chunks by the latest change of their own source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.chunks import chunk_view
from ..sources.mapping import Mapping, column_expr

#: Hexadecimal digits of a locator's digest.
DIGITS = 16


def locator_hash(locator: Column) -> Column:
    """The digest by which a locator is told in reports."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(locator, 256), 1, DIGITS))


def latest_changes(snapshots: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Of each source that changed: locator, changed_at (the latest observation of a change; those after `as_of` are not known yet), signal_kind of that.

    snapshots: locator, signal_kind, observed_at (a time, or text of one), changed. Rows without a locator, or whose time cannot be read,
    tell nothing. Combined before the shuffle, so a source with very many snapshots is no burden.
    """
    at = F.try_to_timestamp("observed_at") if dict(snapshots.dtypes)["observed_at"] == "string" else F.col("observed_at").cast("timestamp")
    rows = snapshots.where("changed and locator is not null").select("locator", "signal_kind", at.alias("at")).where("at is not null")
    rows = rows if as_of is None else rows.where(F.col("at") <= as_of)
    return rows.groupBy("locator").agg(F.max("at").alias("changed_at"), F.max_by("signal_kind", F.struct("at", "signal_kind")).alias("signal_kind"))


def stale_by_source(table: DataFrame, mapping: Mapping, key: str, snapshots: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Each chunk as of the latest change of its source: ref, locator_hash, updated_at, changed_at, stale.

    A chunk is stale if it has a time and that is before its source's latest change. Without a locator, or with one that never changed, changed_at is null and
    it is not stale. The join is by the locator itself, one row for each source: where few sources changed it is broadcast by size, else AQE splits a
    source that holds very many chunks.
    """
    locator = column_expr(mapping, "sourceUrl", table)
    locator = F.lit(None).cast("string") if locator is None else F.nullif(F.trim(locator.cast("string")), F.lit(""))
    view = chunk_view(table.withColumn("_locator", locator), mapping, key, keep=("_locator",)).select("ref", "_locator", "updated_at")
    changes = latest_changes(snapshots, as_of).select(F.trim("locator").alias("_at_locator"), "changed_at").groupBy("_at_locator").agg(F.max("changed_at").alias("changed_at"))
    held = view.join(changes, F.col("_locator") == F.col("_at_locator"), "left")
    return held.select("ref", locator_hash(F.col("_locator")).alias("locator_hash"), "updated_at", "changed_at", F.coalesce(F.col("updated_at") < F.col("changed_at"), F.lit(False)).alias("stale"))


def stale_sources(chunks: DataFrame) -> DataFrame:
    """Of stale_by_source's rows, by source: locator_hash, chunks, measured (with a time), stale, changed_at; sources that changed alone."""
    held = chunks.where("changed_at is not null").groupBy("locator_hash")
    return held.agg(F.count("*").alias("chunks"), F.count("updated_at").alias("measured"), F.count_if(F.col("stale")).alias("stale"), F.max("changed_at").alias("changed_at"))
