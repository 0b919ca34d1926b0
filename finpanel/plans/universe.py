"""Which rows of the price panel count as stocks, market or study universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions.cleaning import flag
from finpanel.schemas import INDEX_CODES, MARKET_CODE, MARKET_NAME_PART


def is_stock(code: Column) -> Column:
    """Codes that start with four digits."""
    return F.coalesce(code.rlike("^[0-9]{4}"), F.lit(False))


def is_market(code: Column, name: Column | None = None) -> Column:
    """The market index, by code or by a part of its name."""
    hit = code == MARKET_CODE
    return F.coalesce(hit if name is None else hit | name.contains(MARKET_NAME_PART), F.lit(False))


def market_series(df: DataFrame, *, ret: str = "return_pct") -> DataFrame:
    """One market return per day: (date, mkt_pct). Several market rows of a day: the lowest code wins."""
    rows = df.where(is_market(F.col("stock_code"), F.col("name") if "name" in df.columns else None))
    return rows.groupBy("date").agg(F.min_by(ret, "stock_code").alias("mkt_pct"))


def split_index(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stocks, index rows) by the list of index codes."""
    hit = F.col("stock_code").isin(*INDEX_CODES)
    return df.where(~hit), df.where(hit)


def apply_universe(df: DataFrame, *, min_days: int = 252) -> DataFrame:
    """Study universe, rules in this order.

    Drop securities that were ever under full delivery; drop disposition days; flag attention days; keep
    securities with at least ``min_days`` rows left; keep days with volume > 0. All rules work on one
    grouping by security, so the panel is shuffled once. A security has one row per day, which bounds
    its group by the calendar.
    """
    stocks, _ = split_index(df)
    # Ordered by day as the windows of the studies are, so that one sort serves both; the frame is the whole security all the same.
    every = Window.partitionBy("stock_code").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = F.when(flag(F.col("disposition_d"), "D") == 0, 1)
    marked = stocks.withColumns(
        {
            "_ever_y": F.max(flag(F.col("full_delivery_y"), "Y")).over(every),
            "_days": F.count(kept).over(every),
            "is_attention": flag(F.col("alert_a"), "A"),
        }
    )
    return marked.where(
        (F.col("_ever_y") == 0)
        & (flag(F.col("disposition_d"), "D") == 0)
        & (F.col("_days") >= min_days)
        & (F.coalesce(F.col("volume"), F.lit(0.0)) > 0)
    ).drop("_ever_y", "_days")
