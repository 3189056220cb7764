"""The chunk view that all detectors read, and the deterministic sample of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metadata as M
from ..functions import text as X
from ..functions.vectors import dims
from .mapping import Mapping, column_expr

VIEW = ["ref", "ord", "content_hash", "content_sample", "length", "metadata", "metadata_keys", "embedding", "embedding_dims", "updated_present", "updated_at", "document_id", "source_locator_present"]


def chunk_view(table: DataFrame, mapping: Mapping, key: str, order: str | None = None, keep: tuple[str, ...] = (), chars: int | None = X.SAMPLE_CHARS) -> DataFrame:
    """One row per row of the table.

    key: the column that names a row for good (tables have no physical row id here); order: what `first`
    means, the key if not given; keep: other columns to carry along, whose names are none of VIEW; chars: characters of each text that content_sample
    holds, null for all of them. Null content counts as empty. metadata is JSON text of an object or
    null; an embedding that nobody asks for is pruned from the scan. An updatedAt that cannot be read
    as a time is present but never stale.
    """
    get = {name: column_expr(mapping, name, table) for name in mapping.columns}
    content = get["content"].cast("string")
    norm = X.normalized(content)
    embedding = get["embedding"] if not mapping.columns["embedding"].startswith("meta:") else F.from_json(get["embedding"], "array<float>")
    json = F.lit(None).cast("string")
    if mapping.columns["metadata"] is not None:
        kind = table.select(get["metadata"].alias("m")).schema[0].dataType
        json = M.object_only(M.as_json(get["metadata"], kind))
    updated = get["updatedAt"]
    present, when = F.lit(False), F.lit(None).cast("timestamp")
    if updated is not None:
        text = isinstance(table.select(updated.alias("u")).schema[0].dataType, T.StringType)
        filled = updated != "" if text else F.lit(True)
        present = updated.isNotNull() & filled
        when = F.when(present, F.try_to_timestamp(updated) if text else updated.cast("timestamp"))
    places = [F.trim(get[n].cast("string")) != "" for n in ("sourceUrl", "documentId") if get[n] is not None]
    located = F.lit(None).cast("boolean")
    if places:
        located = F.coalesce(places[0], F.lit(False))
        for other in places[1:]:
            located = located | F.coalesce(other, F.lit(False))
    document = get["documentId"].cast("string") if get["documentId"] is not None else F.lit(None).cast("string")
    held = table.select(
        F.col(key).cast("string").alias("ref"), F.col(order or key).alias("ord"), norm.alias("_norm"), X.sample(content, chars).alias("content_sample"), json.alias("metadata"),
        embedding.alias("embedding"), present.alias("updated_present"), when.alias("updated_at"), document.alias("document_id"), located.alias("source_locator_present"), *(F.col(f"`{c}`") for c in keep),
    )
    return held.select(
        "ref", "ord", F.sha2("_norm", 256).alias("content_hash"), "content_sample", F.length("_norm").alias("length"), "metadata", M.keys(F.col("metadata")).alias("metadata_keys"),
        "embedding", dims(F.col("embedding")).alias("embedding_dims"), "updated_present", "updated_at", "document_id", "source_locator_present", *(F.col(f"`{c}`") for c in keep),
    )


def deterministic_sample(rows: DataFrame, seed: str, limit: int, key: str = "ref", total: int | None = None) -> DataFrame:
    """The `limit` rows with the smallest MD5 of row name and seed; the same rows every time, of a table or a chunk view.

    They are chosen by name alone and then fetched, so only their other columns are computed. With the number of
    rows known, names with a large MD5 (beyond what the limit can need) do not even take part in the sort.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    names = rows.select(F.col(key).alias("_key"), digest.alias("_digest"))
    if total and total > 4 * limit:
        share = (limit + 10 * limit**0.5 + 100) / total
        few = names.where(F.col("_digest") < f"{int(share * 16**12):012x}")
        names = few if few.count() >= limit else names
    chosen = names.orderBy("_digest", "_key").limit(limit).select("_key")
    return rows.join(F.broadcast(chosen), F.col(key) == F.col("_key"), "left_semi")
