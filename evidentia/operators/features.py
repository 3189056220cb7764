"""Features of each chunk and the one pass that counts them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as X

# Results depend on them.
LARGE_CHARS, MANY_EMAILS = 4000, 3


@dataclass(frozen=True)
class Thresholds:
    near_duplicate_cosine: float = 0.97
    thin_chunk_min_chars: int = 120
    link_nav_density: float = 0.6
    many_emails: int = MANY_EMAILS


def features(chunks: DataFrame, thresholds: Thresholds = Thresholds(), table_lines: int | None = X.TABLE_LINES) -> DataFrame:
    """The chunk view with thin_reason, secrets, email_count, markers, risk, table_like (of so many lines, null: of all), has_source, has_structured."""
    sample = F.col("content_sample")
    held = chunks.withColumns({
        "thin_reason": X.thin_reason(sample, F.col("length"), thresholds.thin_chunk_min_chars, thresholds.link_nav_density),
        "secrets": X.secrets(sample), "email_count": X.email_count(sample), "markers": X.markers(sample), "table_like": X.table_like(sample, table_lines),
    })
    mapped = F.coalesce("source_locator_present", F.lit(False))
    keys = F.col("metadata_keys")
    return held.withColumns({
        # A secret outranks a marker, which outranks many addresses.
        "risk": F.when(F.size("secrets") > 0, "secret").when(F.size("markers") > 0, "marker").when(F.col("email_count") > thresholds.many_emails, "emails"),
        "has_source": mapped | M.has_locator(F.col("metadata"), keys, M.SOURCE_KEYS),
        "has_structured": mapped | M.has_locator(F.col("metadata"), keys, M.STRUCTURED_KEYS),
    })


def counters(rows: DataFrame, newest_change=None, more: dict[str, Column] | None = None) -> DataFrame:
    """Every count that findings and scores need, in one row and one pass over the features.

    newest_change: the newest time at which a source is known to have changed, a scalar or null; or a column of rows, each chunk's own. more: other aggregates
    by name, for the same pass.
    """
    change = newest_change if isinstance(newest_change, Column) else F.lit(newest_change)
    stale = F.lit(False) if newest_change is None else F.coalesce(F.col("updated_at") < change.cast("timestamp"), F.lit(False))
    count = lambda condition: F.count_if(condition)
    length = F.col("length").cast("long")
    return rows.agg(
        F.count("*").alias("scanned"),
        count(F.col("thin_reason") == "short").alias("short"), count(F.col("thin_reason") == "linkDensity").alias("link_density"), count(F.col("thin_reason") == "midSentence").alias("mid_sentence"),
        count(F.col("risk") == "secret").alias("critical"), count(F.col("risk").isin("marker", "emails")).alias("warning"),
        count(~F.col("updated_present")).alias("missing_timestamps"), count(F.col("updated_present")).alias("measured"), count(F.col("updated_present") & stale).alias("stale"),
        count(F.col("embedding_dims").isNull()).alias("null_embeddings"),
        count(length >= LARGE_CHARS).alias("large"), F.max(length).alias("max_chars"), F.expr("cast(percentile_disc(0.5) within group (order by length) as bigint)").alias("p50_chars"),
        F.expr("cast(percentile_disc(0.95) within group (order by length) as bigint)").alias("p95_chars"),
        count(F.coalesce(F.size("metadata_keys"), F.lit(0)) <= 0).alias("missing_metadata"),
        count(F.col("has_source")).alias("source_rows"), count(F.col("table_like")).alias("table_like"), count(F.col("table_like") & ~F.col("has_structured")).alias("table_like_unlocated"),
        *(column.alias(name) for name, column in (more or {}).items()),
    )


def dims_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding_dims is not null").groupBy(F.col("embedding_dims").cast("long").alias("dims")).agg(F.count("*").alias("n"))


def key_kinds(chunks: DataFrame) -> DataFrame:
    """Rows of each top-level metadata key and kind of value: key, kind, n."""
    rows = chunks.where("metadata is not null").select(F.try_parse_json("metadata").alias("v"))
    exploded = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return exploded.groupBy("key", M.kind_of(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


# Results depend on them.
KEY_MIN_ROWS, MIXED_MIN_ROWS, SHOWN = 10, 5, 8


def inconsistent_keys(kinds: DataFrame, scanned: int, shown: int | None = SHOWN) -> DataFrame:
    """Keys that many chunks have and many lack, the most frequent first, eight (null: all) of them; shares are rounded before they are compared."""
    rows = kinds.groupBy("key").agg(F.sum("n").alias("present_rows")).select(M.safe_key(F.col("key")).alias("key"), "present_rows")
    share = lambda n: F.round(n * 100.0 / F.lit(max(scanned, 1)), 1)
    rows = rows.withColumns({"present_pct": share(F.col("present_rows")), "missing_pct": share(F.lit(scanned) - F.col("present_rows"))})
    rows = rows.where((F.col("present_rows") >= KEY_MIN_ROWS) & (F.col("present_pct") < 80) & (F.col("missing_pct") >= 20))
    return rows if shown is None else rows.orderBy(F.desc("present_rows"), F.collate("key", "UNICODE")).limit(shown)


def mixed_keys(kinds: DataFrame, shown: int | None = SHOWN) -> DataFrame:
    """Keys whose values are of several kinds (null apart), the most frequent first, eight (null: all) of them: key, rows, types."""
    rows = kinds.where("kind <> 'null'").groupBy("key").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))).alias("t"))
    rows = rows.where((F.col("rows") >= MIXED_MIN_ROWS) & (F.size("t") > 1))
    rows = rows.select(M.safe_key(F.col("key")).alias("key"), "rows", F.transform("t", lambda x: F.struct(x["kind"].alias("kind"), (-x["m"]).alias("n"))).alias("types"))
    return rows if shown is None else rows.orderBy(F.desc("rows"), F.collate("key", "UNICODE")).limit(shown)
