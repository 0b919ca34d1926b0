"""Scalar measures of the research jobs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def trimmed(c: Column, digits: int) -> Column:
    """Value cut to ``digits`` decimals in plain double arithmetic, to drop the noise of the last bits.

    ``round`` goes through decimal text for every value, which costs more than the windows above it.
    """
    scale = 10.0**digits
    return F.rint(c * scale) / scale


def missing_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def book_to_market(pb: Column, *, positive_only: bool) -> Column:
    """1 / PB. The panel form needs PB > 0; the cross-section form only turns 0 into null."""
    return F.when(pb > 0, 1.0 / pb) if positive_only else 1.0 / missing_if_zero(pb)


def earnings_yield(pe: Column, *, positive_only: bool) -> Column:
    """1 / PE, at most 1. Same two forms as :func:`book_to_market`."""
    inverse = F.when(pe > 0, 1.0 / pe) if positive_only else 1.0 / missing_if_zero(pe)
    return F.when(inverse.isNotNull(), F.least(inverse, F.lit(1.0)))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*cols)


def excess_of(stock: Column, market: Column) -> Column:
    """Compounded excess return (1 + Rs) / (1 + Rm) - 1, null where the market lost everything."""
    return F.when(market != -1.0, (1.0 + stock) / (1.0 + market) - 1.0)


def event_strength(amp: Column, band: Column, *, side: str) -> Column:
    """Distance of the amplitude from its band, relative to the band; null when the band is not > 0."""
    gap = amp - band if side == "big" else band - amp
    return F.when(band > 0, gap / band)


def capped_size_log(mcap: Column) -> Column:
    """log(1 + max(market cap, 0)), missing counted as 0."""
    return F.log1p(F.greatest(F.coalesce(mcap, F.lit(0.0)), F.lit(0.0)))


def stars(p: Column) -> Column:
    """Significance marks at 0.1 %, 1 % and 5 %."""
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "")
    )


def json_number(c: Column, key: str) -> Column:
    """Number stored under ``key`` of a JSON object in text form; null when absent or not a number."""
    return F.get_json_object(c, f"$['{key}']").try_cast("double")
