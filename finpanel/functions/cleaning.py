"""Column expressions that turn vendor text into typed values. Bad input gives null, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key cells that mean "missing", and the shape of a plain decimal number.
MISSING_KEYS = ("", "nan", "NaN", "NAN", "None")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _finite(text: Column) -> Column:
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _without(text: Column, drop: str) -> Column:
    """Text without what matches ``drop``; plain characters in brackets need no pattern matching."""
    plain = re.fullmatch(r"\[([^\]\[\\^&-]+)\]", drop)
    return F.translate(text, plain[1], "") if plain else F.regexp_replace(text, drop, "")


def clean_number(c: Column, *, drop: str = "[,]") -> Column:
    """Double from text, without the characters in the pattern ``drop`` (thousands commas).

    Anything that is not a finite plain number is null: blanks, ``NA``, ``N/A``, ``--``, ``-``, the
    full-width dash, ``nan``, ``inf`` and free text alike.
    """
    return _finite(_without(F.trim(c), drop))


def clean_percent(c: Column) -> Column:
    """Double from a percentage such as ``+0.03%`` (kept in percent)."""
    return _finite(_without(F.trim(c), "[%+]"))


def parse_day(c: Column) -> Column:
    """Date from exactly eight digits ``YYYYMMDD``; an impossible day is null."""
    text = F.trim(c)
    dashed = F.overlay(F.overlay(text, F.lit("-"), 7, 0), F.lit("-"), 5, 0)  # a cast is cheaper than a parser, most of all for impossible days
    return F.when(text.rlike("^[0-9]{8}$"), dashed.try_cast("date"))


def parse_month_end(c: Column) -> Column:
    """Last day of the month from exactly six digits ``YYYYMM``."""
    text = F.trim(c)
    first = F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(F.concat(text, F.lit("01")), "yyyyMMdd"))
    return F.last_day(first)


def parse_slash_day(c: Column) -> Column:
    """Date from ``YYYY/MM/DD`` or ``YYYY-MM-DD``."""
    text = F.translate(F.trim(c), "/", "-")
    return F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def parse_iso_day(c: Column) -> Column:
    """Date from ``YYYY-MM-DD``."""
    text = F.trim(c)
    return F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def parse_month_start(c: Column) -> Column:
    """First day of the month from ``YYYY/MM`` or ``YYYY-MM``."""
    text = F.translate(F.trim(c), "/", "-")
    return F.when(
        text.rlike("^[0-9]{4}-[0-9]{1,2}$"),
        F.try_to_date(F.concat(text, F.lit("-1")), "yyyy-M-d"),
    )


def day_to_int(c: Column) -> Column:
    """Integer ``YYYYMMDD`` of a date."""
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def text_key(c: Column) -> Column:
    """Trimmed key text; blanks and the texts pandas writes for a missing value become null."""
    text = F.trim(c)
    return F.when(~text.isin(*MISSING_KEYS), text)


def text_or_null(c: Column) -> Column:
    """Trimmed text, null when empty."""
    return F.nullif(F.trim(c), F.lit(""))


def code_of(c: Column) -> Column:
    """First blank-separated token of ``"code name"``."""
    return F.split(F.trim(c), r"\s+").getItem(0)


def name_of(c: Column) -> Column:
    """What follows the first blank of ``"code name"``; empty when there is no name."""
    return F.coalesce(F.trim(F.get(F.split(F.trim(c), " ", 2), F.lit(1))), F.lit(""))


def market_of(code: Column) -> Column:
    """Market class of a code: four digits TSE, five digits OTC, anything else INDEX."""
    return (
        F.when(code.rlike("^[0-9]{4}$"), "TSE").when(code.rlike("^[0-9]{5}$"), "OTC").otherwise("INDEX")
    )


def currency_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def flag(c: Column, token: str) -> Column:
    """1 where the trimmed text equals ``token``, else 0 (null counts as 0)."""
    return F.coalesce((F.trim(c) == token).cast("int"), F.lit(0))
