"""Factor returns from daily portfolio sorts, and security characteristics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.functions.cleaning import day_to_int
from finpanel.functions.measures import book_to_market, earnings_yield, first_present, rounded, trimmed
from finpanel.operators.keys import as_of
from finpanel.operators.quantiles import quantiles
from finpanel.operators.stats import unpivot
from finpanel.plans.events import by_security
from finpanel.plans.universe import is_stock
from finpanel.session import materialize

FACTORS = ("Rm_Rf", "SMB", "HML", "WML_ep", "WML_dy", "UMD", "STR")


def compounded_return(df: DataFrame, frames: dict[str, tuple[int, int]], *, col: str = "return_pct", digits: int = 9) -> DataFrame:
    """Add compounded returns in percent over row frames, e.g. ``{"mom": (-231, -22)}`` (both negative).

    Missing returns are skipped and frames may be cut by the start of the series; null when no return is
    left. Frames are differences of running totals (log growth, total losses, sign changes, count), so a
    long frame costs no more than a short one.
    """
    g = 1.0 + F.col(col) / 100.0
    w = by_security()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(
        "_t",
        F.struct(
            F.sum(F.when(g != 0, F.log(F.abs(g)))).over(running).alias("log"),
            F.sum((g == 0).cast("int")).over(running).alias("zero"),
            F.sum((g < 0).cast("int")).over(running).alias("neg"),
            F.count(g).over(running).alias("cnt"),
        ),
    )
    edges = {f"_{name}_end": F.lag("_t", -last).over(w) for name, (_, last) in frames.items()}
    edges |= {f"_{name}_start": F.lag("_t", 1 - first).over(w) for name, (first, _) in frames.items()}
    df = df.withColumns(edges)

    def grown(name: str) -> Column:
        def diff(part: str) -> Column:
            end, start = F.col(f"_{name}_end")[part], F.col(f"_{name}_start")[part]
            return F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0))

        sign = F.when(diff("neg") % 2 == 0, 1.0).otherwise(-1.0)
        growth = F.when(diff("zero") > 0, 0.0).otherwise(sign * F.exp(diff("log")))
        return F.when(diff("cnt") > 0, trimmed((growth - 1.0) * 100.0, digits))

    return df.withColumns({name: grown(name) for name in frames}).drop("_t", *edges)


def with_momentum(df: DataFrame, *, lookback: int = 231, skip: int = 21) -> DataFrame:
    """Add ``mom`` (rows -lookback .. -skip-1) and ``rev`` (rows -skip .. -1), in percent."""
    return compounded_return(df, {"mom": (-lookback, -skip - 1), "rev": (-skip, -1)})


def characteristics(df: DataFrame) -> DataFrame:
    """Size, book-to-market, earnings yield, dividend yield, momentum and reversal per security-day."""
    stocks = with_momentum(df.where(is_stock(F.col("stock_code"))))
    return stocks.withColumns(
        {
            "size": F.col("market_cap"),
            "bm": book_to_market(F.col("pb"), positive_only=True),
            "ep": earnings_yield(F.col("pe"), positive_only=True),
            "dy": first_present(F.col("div_yield"), F.col("cash_div")),
        }
    ).select("stock_code", "date", "return_pct", "size", "bm", "ep", "dy", "mom", "rev")


def risk_free(rates: DataFrame) -> DataFrame:
    """Daily mean of the banks' one-year deposit rate, over positive rates: (date, rf_pct)."""
    return rates.where(F.col("rate_1y") > 0).groupBy("date").agg(F.avg("rate_1y").alias("rf_pct"))


def weighted_return(keep: Column) -> Column:
    """Market-cap-weighted mean return of the rows where ``keep`` is true; null when there are none."""
    weight = F.when(keep, F.col("market_cap"))
    return F.sum(weight * F.col("return_pct")) / F.nullif(F.sum(weight), F.lit(0.0))


def breakpoints(rows: DataFrame, *, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    """Per day and sort feature: number of usable values and their ``lo`` / 0.5 / ``hi`` quantiles.

    Earnings and dividend yields enter only when positive. A day may hold any number of securities.
    """
    features = {
        "size": F.col("market_cap"),
        "bm": F.col("bm"),
        "ep": F.when(F.col("ep") > 0, F.col("ep")),
        "dy": F.when(F.col("dy") > 0, F.col("dy")),
        "mom": F.col("mom"),
        "rev": F.col("rev"),
    }
    long = unpivot(rows, ["date"], features, label="feature")
    return quantiles(long, ["date", "feature"], "value", [lo, 0.5, hi], ["lo", "mid", "hi"], few_groups=True)


def sort_input(df: DataFrame, *, min_mcap: float = 100.0) -> DataFrame:
    """Stocks with sort features; ``usable`` marks rows that have a return and a large enough size."""
    stocks = with_momentum(df.where(is_stock(F.col("stock_code"))))
    usable = F.col("return_pct").isNotNull() & (F.coalesce(F.col("market_cap"), F.lit(0.0)) >= min_mcap)
    return stocks.select(
        "date", "return_pct", "market_cap", "mom", "rev",
        book_to_market(F.col("pb"), positive_only=False).alias("bm"),
        earnings_yield(F.col("pe"), positive_only=False).alias("ep"),
        first_present(F.col("div_yield"), F.col("cash_div"), F.lit(0.0)).alias("dy"),
        usable.alias("usable"),
    )


def portfolio_legs(rows: DataFrame, cuts: DataFrame, *, min_names: int = 30, min_clean: int = 20, min_sort: int = 10) -> DataFrame:
    """Value-weighted return of every portfolio per day, all from one group-by.

    A missing book-to-market falls into the middle group, and low groups take values <= 0 although the
    breakpoints use only positive ones.
    """
    names = ("size", "bm", "ep", "dy", "mom", "rev")
    wide = cuts.groupBy("date").agg(*[
        F.max(F.when((F.col("feature") == f) & (F.col("n") >= (1 if f == "size" else min_sort)), F.col(q))).alias(f"{f}_{q}")
        for f in names for q in (("mid",) if f == "size" else ("lo", "hi"))
    ])
    placed = rows.join(F.broadcast(wide), "date", "left")  # one row per day
    usable = F.col("usable")

    def low(f: str) -> Column:
        return F.coalesce(F.col(f) <= F.col(f"{f}_lo"), F.lit(False)) & usable

    def high(f: str) -> Column:
        return F.coalesce(F.col(f) >= F.col(f"{f}_hi"), F.lit(False)) & usable

    small = usable & (F.col("market_cap") < F.col("size_mid"))
    big = usable & ~(F.col("market_cap") < F.col("size_mid"))
    legs = {
        "s_h": small & high("bm"), "s_m": small & ~high("bm") & ~low("bm"), "s_l": small & low("bm"),
        "b_h": big & high("bm"), "b_m": big & ~high("bm") & ~low("bm"), "b_l": big & low("bm"),
    }
    for f in ("ep", "dy", "mom", "rev"):
        legs |= {f"{f}_h": high(f), f"{f}_l": low(f)}
    return (
        placed.groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("n_names"),
            F.sum(usable.cast("int")).alias("n_clean"),
            *[weighted_return(keep).alias(name) for name, keep in legs.items()],
        )
        .where((F.col("n_names") >= min_names) & (F.col("n_clean") >= min_clean))
    )


def _mean_of(*names: str) -> Column:
    """Mean of the non-null columns, null when all are null."""
    have = F.filter(F.array(*names), lambda x: x.isNotNull())
    return F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(have), F.lit(0))


def factor_returns(
    df: DataFrame,
    market: DataFrame,
    rates: DataFrame | None,
    *,
    lo: float = 0.3,
    hi: float = 0.7,
    min_names: int = 30,
    min_clean: int = 20,
    min_sort: int = 10,
    min_mcap: float = 100.0,
    periods_per_year: int | None = None,
) -> DataFrame:
    """Seven factor returns per day in percent (4 decimals): columns ``date``, ``ymd`` and ``FACTORS``.

    The deposit rate is an annual figure and is subtracted as it stands; ``periods_per_year`` divides it.
    """
    rows = materialize(sort_input(df, min_mcap=min_mcap), "factor-rows")
    cuts = breakpoints(rows.where(F.col("usable")), lo=lo, hi=hi)
    legs = portfolio_legs(rows, cuts, min_names=min_names, min_clean=min_clean, min_sort=min_sort)
    # One row per day from here on; stored, since every as-of lookup reads the days once more.
    legs = as_of(materialize(legs, "legs"), market, "mkt_pct")
    if rates is None:
        legs = legs.withColumn("rf_pct", F.lit(0.0))
    else:
        legs = as_of(legs, risk_free(rates), "rf_pct").withColumn("rf_pct", F.coalesce("rf_pct", F.lit(0.0)))
    rate = F.col("rf_pct") / (periods_per_year or 1)
    c = F.col
    values = {
        "Rm_Rf": (c("mkt_pct") / 100.0 - rate / 100.0) * 100.0,
        "SMB": _mean_of("s_h", "s_m", "s_l") - _mean_of("b_h", "b_m", "b_l"),
        "HML": _mean_of("s_h", "b_h") - _mean_of("s_l", "b_l"),
        "WML_ep": c("ep_h") - c("ep_l"),
        "WML_dy": c("dy_h") - c("dy_l"),
        "UMD": c("mom_h") - c("mom_l"),
        "STR": c("rev_l") - c("rev_h"),
    }
    return legs.select("date", day_to_int(c("date")).alias("ymd"), *[rounded(v, 4).alias(n) for n, v in values.items()])


def factor_columns(factors: DataFrame, names: Sequence[str] = FACTORS) -> list[str]:
    """Factors that have any value at all; the others cannot be regressed on. One row is read."""
    row = factors.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if row[n] > 0]
