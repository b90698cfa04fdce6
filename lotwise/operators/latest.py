"""Newest or best row per key by max_by and min_by: sorted aggregation, which combines before the shuffle and spills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of the smallest `order` for each key (null is a key of its own); columns stay as they are."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def newest_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest (created_at, id) for each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def surest_row(df: DataFrame, keys: list[str], confidence: str = "extraction_confidence") -> DataFrame:
    """The row of the highest confidence, then the oldest, then the lowest id, for each key."""
    return best_row(df, keys, F.struct(-F.col(confidence), "created_at", "id"))
