"""Vectors: dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dims(vector: Column) -> Column:
    return F.when(vector.isNotNull(), F.size(vector))

