"""Amplitude events: rolling bands over the days before, flags, abnormal measures, the event table.

All frames count rows of one security, not calendar days. A security has one row per day, so its group is
bounded by the calendar however large the panel is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from finpanel.functions.cleaning import day_to_int, flag
from finpanel.functions.measures import trimmed
from finpanel.plans.universe import is_stock


def by_security() -> WindowSpec:
    return Window.partitionBy("stock_code").orderBy("date")


def sorted_quantile(ordered: Column, size: int, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array that is known to hold ``size`` values."""
    at = p * (size - 1)
    low = int(at)
    step = round(at - low, 12)
    if step == 0.0:
        return ordered[low]
    return ordered[low] + (ordered[low + 1] - ordered[low]) * step


def rolling_band(df: DataFrame, col: str, *, window: int = 20, hi: float = 0.9, lo: float = 0.1, digits: int = 9) -> DataFrame:
    """Add ``roll_hi``, ``roll_lo``, ``roll_mean`` of the ``window`` rows before, today excluded.

    Null unless all those values are present. The frame is gathered once per row and sorted, which gives
    every band from one pass. Bands are rounded to ``digits`` so that a value equal to its band compares
    as equal whatever the last bit of the interpolation.
    """
    frame = by_security().rowsBetween(-window, -1)
    df = df.withColumn("_prev", F.sort_array(F.collect_list(col).over(frame)))
    full = F.size("_prev") == window
    prev = F.col("_prev")
    total = F.aggregate(prev, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumns(
        {
            "roll_hi": F.when(full, trimmed(sorted_quantile(prev, window, hi), digits)),
            "roll_lo": F.when(full, trimmed(sorted_quantile(prev, window, lo), digits)),
            "roll_mean": F.when(full, total / window),
        }
    ).drop("_prev")


def amplitude_events(df: DataFrame, *, window: int = 20, hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    """Add the band and the flags ``amp_big`` (above it) and ``amp_sml`` (below it)."""
    banded = rolling_band(df, "amp_pct", window=window, hi=hi, lo=lo)
    return banded.withColumns(
        {
            "amp_big": F.coalesce((F.col("amp_pct") > F.col("roll_hi")).cast("int"), F.lit(0)),
            "amp_sml": F.coalesce((F.col("amp_pct") < F.col("roll_lo")).cast("int"), F.lit(0)),
        }
    )


def abnormal(df: DataFrame, col: str, *, window: int = 20, to: str | None = None, missing: float | None = None) -> DataFrame:
    """Value over the mean of the ``window`` rows before, minus 1; null if the mean is not > 0.

    ``missing`` replaces null values first (volume counts as 0).
    """
    value = F.col(col) if missing is None else F.coalesce(F.col(col), F.lit(missing))
    frame = by_security().rowsBetween(-window, -1)
    mean = F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))
    df = df.withColumn("_mean", mean)
    return df.withColumn(to or f"abnormal_{col}", F.when(F.col("_mean") > 0, value / F.col("_mean") - 1.0)).drop("_mean")


def hump(df: DataFrame, *, horizon: int = 20) -> DataFrame:
    """Flag ``hump_event``: amplitude not lower the day after, but lower again at the horizon."""
    w = by_security()
    next_day, at_end = F.lead("amp_pct", 1).over(w), F.lead("amp_pct", horizon).over(w)
    hit = (next_day >= F.col("amp_pct")) & (at_end < next_day)
    return df.withColumn("hump_event", F.coalesce(hit.cast("int"), F.lit(0)))


def event_table(df: DataFrame, *, window: int = 20) -> DataFrame:
    """Wide 0/1 event table of stocks: rows with at least one flag. Order it when writing, not here."""
    events = amplitude_events(df.where(is_stock(F.col("stock_code"))), window=window)
    flags = {
        "attention_a": flag(F.col("alert_a"), "A"),
        "disposition_d": flag(F.col("disposition_d"), "D"),
        "full_delivery_y": flag(F.col("full_delivery_y"), "Y"),
        "amp_big": F.col("amp_big"),
        "amp_sml": F.col("amp_sml"),
    }
    wide = events.select("stock_code", day_to_int(F.col("date")).alias("ymd"), *[c.alias(n) for n, c in flags.items()])
    return wide.where(F.greatest(*flags) > 0)


EVENT_FLAGS = ("attention_a", "disposition_d", "full_delivery_y", "amp_big", "amp_sml")


def flag_totals(events: DataFrame) -> DataFrame:
    """Number of rows and of set flags of each kind."""
    return events.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in EVENT_FLAGS])
