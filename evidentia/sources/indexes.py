"""A database's index catalog as relations, joined by ordinal position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def described(indexes: DataFrame, attributes: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per index: table_name, name, method, columns, included, opclasses, expressions, all in the order of the index's keys.

    indexes: table_name, name, method, keys (attribute numbers in order, 0 for an expression), key_count (how many are keys; those behind are included
    ones), opclass_ids (of the keys in order), expressions (texts, in the order of the zeros among keys). attributes: table_name, attnum, attname. classes:
    opclass_id, opclass. A key whose attribute is gone (dropped columns) is left out; an index without columns has empty arrays.
    """
    zeros = lambda upto: F.size(F.filter(F.slice(F.col("keys"), F.lit(1), upto), lambda k: k == 0))
    each = indexes.select("table_name", "name", "method", "key_count", "opclass_ids", "expressions", "keys", F.posexplode_outer("keys").alias("place", "attnum"))
    each = each.select(
        "table_name", "name", "method", "place", "attnum", (F.col("place") >= F.col("key_count")).alias("is_included"), F.get("opclass_ids", F.col("place")).alias("opclass_id"),
        F.when(F.col("attnum") == 0, F.get("expressions", zeros(F.col("place") + 1) - 1)).alias("expression"),
    )
    each = each.join(attributes.select("table_name", "attnum", "attname"), ["table_name", "attnum"], "left").join(classes, "opclass_id", "left")
    part = F.struct("place", "attname", "is_included", "opclass", "expression")
    held = each.groupBy("table_name", "name", "method").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    of = lambda test, field: F.transform(F.filter("parts", test), lambda p: p[field])
    return held.select(
        "table_name", "name", "method", of(lambda p: ~p["is_included"] & p["attname"].isNotNull(), "attname").alias("columns"), of(lambda p: p["is_included"] & p["attname"].isNotNull(), "attname").alias("included"),
        of(lambda p: ~p["is_included"] & p["opclass"].isNotNull(), "opclass").alias("opclasses"), of(lambda p: p["expression"].isNotNull(), "expression").alias("expressions"),
    )
