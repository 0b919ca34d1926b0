"""Currency series: cross rates through a bridge currency, fills and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_rate(fx: DataFrame, bridge: str, *, digits: int = 4) -> DataFrame:
    """Rates between ``bridge`` and every other currency of the day, from quotes in a common unit.

    With quotes in US dollars per unit, bridge close / other close is *other currency per one bridge
    unit* (``foreign_per_bridge``); the inverse is ``bridge_per_foreign``. The bridge side is reduced to one
    row per day (the highest quote), so it is broadcast.
    """
    base = fx.where(F.col("currency") == bridge).groupBy("date").agg(F.max("close").alias("bridge_close"))
    other = fx.where(F.col("currency") != bridge).select("currency", "date", "close")
    joined = other.join(F.broadcast(base), "date")
    zero = F.lit(0.0)
    return joined.select(
        "currency", "date", "bridge_close", "close",
        F.round(F.col("bridge_close") / F.nullif("close", zero), digits).alias("foreign_per_bridge"),
        F.round(F.col("close") / F.nullif("bridge_close", zero), digits).alias("bridge_per_foreign"),
    )


def series_summary(df: DataFrame, by: Sequence[str], *, value: str, order: str = "date") -> DataFrame:
    """Rows, first and last day and missing values per series."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.min(order).alias("min_date"),
        F.max(order).alias("max_date"),
        F.sum(F.col(value).isNull().cast("int")).alias("missing"),
    )


def keyed_summary(df: DataFrame, key: str, *, value: str, order: str = "date") -> DataFrame:
    """Distinct keys, rows, first and last day and missing values of the whole table.

    Keys are first reduced to one row each, so the distinct count needs no second shuffle of the rows.
    """
    per_key = series_summary(df, [key], value=value, order=order)
    return per_key.agg(
        F.count(key).alias("keys"),
        F.sum("total").alias("total"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.sum("missing").alias("missing"),
    )
