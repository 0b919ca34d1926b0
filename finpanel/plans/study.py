"""Event-study panel: what follows each security-day, and the persistence estimates built on it.

Cumulated values are running totals per security, so every horizon is a difference of two totals. One
gathered frame per row then serves forward returns, curves, scores and drawdown alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions.measures import trimmed
from finpanel.operators.quantiles import quantiles
from finpanel.plans.events import abnormal, amplitude_events, by_security, hump


def attach_market(df: DataFrame, market: DataFrame) -> DataFrame:
    """Market return of the day as ``mkt_pct``; a day without one counts as 0. Reduced to one row per day (the highest), so broadcast."""
    daily = market.groupBy("date").agg(F.max("mkt_pct").alias("mkt_pct"))
    joined = df.join(F.broadcast(daily), "date", "left")
    return joined.withColumn("mkt_pct", F.coalesce("mkt_pct", F.lit(0.0)))


# The log that stands for a total loss of a stock: any return across the day is exactly -1, gains of a hundred logs notwithstanding.
STOCK_LOST = -128.0


def market_lost(rows: int) -> float:
    """The log that stands for a total loss of the market: in the excess total it outweighs a loss of the stock on each of ``rows`` rows, so that an excess
    return across it overflows and becomes null. No larger than that, as totals behind it lose digits in proportion."""
    return STOCK_LOST * (rows + 1) - 1024.0


def _log_growth(pct: str, lost: float) -> Column:
    """log(1 + r) of a return in percent; a missing return counts as 0, a loss of 100 % as ``lost``."""
    r = F.coalesce(F.col(pct), F.lit(0.0)) / 100.0
    return F.when(r > -1.0, F.log1p(r)).otherwise(lost)


def _grown(log: Column) -> Column:
    """Compounded return of a difference of log totals, cut to 12 decimals so that no change is exactly 0."""
    return trimmed(F.expm1(log), 12)


def _excess(log: Column) -> Column:
    """(1 + Rs) / (1 + Rm) - 1 from a difference of excess log totals; null where the market lost all."""
    value = _grown(log)
    return F.when(value < F.lit(float("inf")), value)


def _running(c: Column) -> Column:
    return F.sum(c).over(by_security().rowsBetween(Window.unboundedPreceding, 0))


def _drawdown(logs: Column, start: Column) -> Column:
    """min(path - running maximum) of the cumulated returns behind an array of log totals."""
    first = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, x: Column) -> Column:
        value = F.expm1(x - start)
        peak = F.greatest(acc["peak"], value)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], value - peak).alias("worst"))

    return F.aggregate(logs, first, step, lambda acc: acc["worst"])


def _ahead(total: str, k: int) -> Column:
    """The running total k rows on, null beyond the data end."""
    return F.col(total) if k == 0 else F.lead(total, k).over(by_security())


def forward_returns(df: DataFrame, *, horizons: Sequence[int] = (1, 5, 20), entry_lag: int = 0) -> DataFrame:
    """Add ``fwd_ret_h``: compounded return over the h rows after the entry row, null near the data end.

    ``entry_lag=0`` buys at the close of the row itself; 1 enters one row later.
    """
    df = df.withColumn("_s", _running(_log_growth("return_pct", STOCK_LOST)))
    start = _ahead("_s", entry_lag)
    return df.withColumns({f"fwd_ret_{h}": _grown(_ahead("_s", h + entry_lag) - start) for h in horizons}).drop("_s")


def study_panel(
    df: DataFrame,
    market: DataFrame,
    *,
    window: int = 20,
    horizon: int = 20,
    horizons: Sequence[int] = (1, 5, 20),
    entry_lag: int = 0,
) -> DataFrame:
    """Event-study panel over the study universe.

    Adds flags and bands, abnormal amplitude and volume, forward and excess returns, persistence scores,
    the curves ``cum_amp`` / ``cum_ret`` / ``cum_exc`` (arrays over k = 0..horizon, null beyond the data
    end), ``mdd`` and ``hump_event``. One shuffle by security carries all of it, and a column that is not
    read costs nothing: its window and curve are pruned.
    """
    df = amplitude_events(attach_market(df, market), window=window)
    df = df.withColumn("abnormal_amp", F.when(F.col("roll_mean") > 0, F.col("amp_pct") / F.col("roll_mean") - 1.0))
    df = abnormal(df, "volume", window=window, to="abnormal_vol", missing=0.0)
    df = hump(df, horizon=horizon)
    stock = _log_growth("return_pct", STOCK_LOST)
    df = df.withColumns(
        {
            "_s": _running(stock),
            "_x": _running(stock - _log_growth("mkt_pct", market_lost(max(horizon, *horizons)))),
            "_a": _running(F.coalesce("abnormal_amp", F.lit(0.0))),
            "_v": _running(F.coalesce("abnormal_vol", F.lit(0.0))),
        }
    )
    frame = by_security().rowsBetween(0, horizon)
    held = by_security().rowsBetween(entry_lag, horizon + entry_lag)
    s0, x0 = _ahead("_s", entry_lag), _ahead("_x", entry_lag)
    df = df.withColumns(
        {
            **{f"fwd_ret_{h}": _grown(_ahead("_s", h + entry_lag) - s0) for h in horizons},
            **{f"fwd_exc_{h}": _excess(_ahead("_x", h + entry_lag) - x0) for h in horizons},
            "persist_amp": _ahead("_a", horizon) - F.col("_a"),
            "persist_vol": _ahead("_v", horizon) - F.col("_v"),
            "_ps": F.collect_list("_s").over(frame),
            "_px": F.collect_list("_x").over(frame),
            "_pa": F.collect_list("_a").over(frame),
        }
    )
    df = df.withColumn("_held", F.collect_list("_s").over(held) if entry_lag else F.col("_ps"))

    def curve(path: str, value: Callable[[Column], Column]) -> Column:
        missing = F.array_repeat(F.lit(None).cast("double"), F.lit(horizon + 1) - F.size(path))
        return F.concat(F.transform(path, value), missing)

    df = df.withColumns(
        {
            "cum_amp": curve("_pa", lambda a: a - F.col("_a")),
            "cum_ret": curve("_ps", lambda s: _grown(s - F.col("_s"))),
            "cum_exc": curve("_px", lambda x: _excess(x - F.col("_x"))),
            "mdd": F.when(F.size("_held") == horizon + 1, _drawdown(F.col("_held"), F.col("_held")[0])),
        }
    )
    return df.drop("_ps", "_px", "_pa", "_held", "_s", "_x", "_a", "_v", "roll_mean", "mkt_pct")


def mark_high(events: DataFrame, *, score: str = "persist_amp", pct: float = 0.8, to: str = "high_persist") -> DataFrame:
    """Flag events whose score reaches the ``pct`` quantile over all events; a missing score is not high.

    The quantile uses the whole sample, so it looks ahead of the event; the estimates below keep that.
    """
    cut = quantiles(events, [], score, [pct], ["_cut"]).select("_cut").scalar()
    return events.withColumn(to, F.coalesce((F.col(score) >= cut).cast("int"), F.lit(0)))


def persistence_probability(events: DataFrame, *, pct: float = 0.8, min_prior: int = 5, min_events: int = 10) -> DataFrame:
    """Per security: share of high-persistence events among its events before the last one.

    Securities with fewer than ``min_prior`` earlier events get no row, and a sample of fewer than
    ``min_events`` events gives an empty table.
    """
    marked = mark_high(events, pct=pct)
    # The last event is left out, so sums per security suffice: no ordered pass over the events.
    per = marked.groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("high_persist").alias("_hi"),
        F.max_by("high_persist", "date").alias("_last"),
    )
    sample = events.agg(F.count(F.lit(1))).scalar()
    per = per.where((sample >= min_events) & (F.col("_n") - 1 >= min_prior))
    prior, high = F.col("_n") - 1, F.col("_hi") - F.col("_last")
    return per.select(
        "stock_code",
        F.round(high / prior, 4).alias("stock_persist_prob"),
        high.alias("stock_persist_hi_n"),
        prior.alias("stock_persist_amp_n"),
    )


def running_probability(events: DataFrame, *, pct: float = 0.8, min_prior: int = 5) -> DataFrame:
    """Every event with the share of high-persistence events among the security's earlier events."""
    marked = mark_high(events, pct=pct)
    earlier = by_security().rowsBetween(Window.unboundedPreceding, -1)
    prob = F.when(F.count(F.lit(1)).over(earlier) >= min_prior, F.avg("high_persist").over(earlier))
    return marked.withColumn("persist_prob", prob)


def merge_back(panel: DataFrame, prob: DataFrame, *, key: str = "stock_code") -> DataFrame:
    """Panel with the columns of ``prob`` replaced or added by key.

    The side has a row per security and grows with the panel, so the join is left to the optimizer.
    """
    new = [c for c in prob.columns if c != key]
    return panel.drop(*new).join(prob, key, "left")
