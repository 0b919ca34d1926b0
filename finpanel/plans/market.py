"""Market-wide measures: breadth of amplitude events and index returns after market events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions.measures import trimmed
from finpanel.operators.stats import describe, unpivot
from finpanel.plans.events import sorted_quantile
from finpanel.plans.study import forward_returns


def daily_breadth(df: DataFrame) -> DataFrame:
    """Per day: number and share of securities with a big or a small event."""
    counts = df.groupBy("date").agg(
        F.sum("amp_big").alias("amp_big_cnt"),
        F.sum("amp_sml").alias("amp_sml_cnt"),
        F.count(F.lit(1)).alias("total_cnt"),
    )
    return counts.withColumns(
        {
            "amp_big_pct": F.col("amp_big_cnt") / F.col("total_cnt"),
            "amp_sml_pct": F.col("amp_sml_cnt") / F.col("total_cnt"),
        }
    )


def market_breadth(df: DataFrame, *, window: int = 20, hi: float = 0.9, lo: float = 0.1, digits: int = 9) -> DataFrame:
    """Daily breadth with rolling bands over the last ``window`` days, today included, and event flags.

    The bands run over one row per day, so their single ordered partition is bounded by the calendar.
    """
    days = daily_breadth(df)
    frame = Window.orderBy("date").rowsBetween(1 - window, 0)
    gathered = days.withColumns(
        {f"_{s}": F.sort_array(F.collect_list(f"amp_{s}_pct").over(frame)) for s in ("big", "sml")}
    )

    def band(side: str, p: float):
        values = F.col(f"_{side}")
        return F.when(F.size(values) == window, trimmed(sorted_quantile(values, window, p), digits))

    share = trimmed(F.col("amp_big_pct"), digits)
    return (
        gathered.withColumns(
            {
                "mkt_hi90": band("big", hi), "mkt_lo10": band("big", lo),
                "mkt_sml_hi90": band("sml", hi), "mkt_sml_lo10": band("sml", lo),
            }
        )
        .withColumns(
            {
                "mkt_amp_hi": F.coalesce((share > F.col("mkt_hi90")).cast("int"), F.lit(0)),
                "mkt_amp_lo": F.coalesce((share < F.col("mkt_lo10")).cast("int"), F.lit(0)),
            }
        )
        .drop("_big", "_sml")
    )


def amplitude_export(breadth: DataFrame) -> DataFrame:
    """The published daily series: date text, share of big events and its bands."""
    return breadth.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "amp_big_pct", "mkt_hi90", "mkt_lo10")


def index_after_events(breadth: DataFrame, index_rows: DataFrame, flag: str, *, horizons: Sequence[int] = (1, 5, 20), min_events: int = 3, min_n: int = 5) -> DataFrame:
    """Statistics of each index's return after market event days, per horizon.

    Horizons are rows of the index itself. An index needs ``min_events`` event days, a cell ``min_n``
    values. There are a handful of indices, so the per-cell tables are small.
    """
    names = [f"fwd_ret_{h}" for h in horizons]
    event_days = breadth.where(F.col(flag) == 1).select("date")  # one row per day
    after = forward_returns(index_rows, horizons=horizons).join(F.broadcast(event_days), "date", "left_semi")
    hits = Window.partitionBy("stock_code")
    after = after.withColumn("_n", F.count(F.lit(1)).over(hits)).where(F.col("_n") >= min_events)
    long = unpivot(after, ["stock_code"], names, label="horizon")
    return describe(long, "value", ["stock_code", "horizon"], min_n=min_n, few_groups=True)
