"""From vendor text to typed, deduplicated rows of each table, with rejects kept apart."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel import schemas
from finpanel.functions import cleaning as c
from finpanel.operators.keys import dedupe_latest, split_rejects
from finpanel.session import materialize
from finpanel.sources.tables import insert_new, load_report, load_table, read_table, snapshot, upsert
from finpanel.sources.vendor import overflow_map, rename_map

Parts = tuple[DataFrame, DataFrame]


def typed(df: DataFrame, *, key: str, day: str, parse: Callable[[Column], Column], text: Sequence[str] = ()) -> Parts:
    """(clean, rejects) of renamed text rows: key trimmed, day parsed, all else numbers except ``text``."""
    plain = {key: c.text_key(F.col(key)), day: parse(F.col(day))}
    plain |= {t: c.text_or_null(F.col(t)) for t in text if t in df.columns}
    numbers = {n: c.clean_number(F.col(n)) for n in df.columns if n not in plain and not n.startswith("_") and n != "extras"}
    rows = df.withColumn("_day_text", F.col(day)).withColumns(plain | numbers)
    good, bad = split_rejects(rows, {"key": F.col(key).isNull(), "date": F.col(day).isNull()})
    return good.drop("_day_text"), bad


def _with_source(raw: DataFrame, renamed: Mapping[str, str]) -> DataFrame:
    """Mapped columns plus the file name, which decides between copies of a key."""
    return rename_map(raw, {**renamed, "_src": "_src"})


def _latest(parts: Parts, keys: Sequence[str]) -> Parts:
    good, bad = parts
    if "_src" in good.columns:
        good = dedupe_latest(good, keys, ["_src"]).drop("_src")
    return good, bad


def daily_table(raw: DataFrame, columns: Mapping[str, str], *, text: Sequence[str] = ()) -> Parts:
    """Prices, market statistics, international indices: key (security_code, date)."""
    parts = typed(_with_source(raw, columns), key="security_code", day="date", parse=c.parse_day, text=text)
    return _latest(parts, ["security_code", "date"])


def chip_table(raw: DataFrame) -> Parts:
    """Chip data: typed columns, everything else that is a number in the map ``extras``."""
    extras = overflow_map(raw, list(schemas.CHIP_COLUMNS), schemas.CHIP_IGNORED, number=c.clean_number)
    named = _with_source(raw.withColumn("extras", extras), {**schemas.CHIP_COLUMNS, "extras": "extras"})
    return _latest(typed(named, key="security_code", day="date", parse=c.parse_day), ["security_code", "date"])


def director_table(raw: DataFrame) -> Parts:
    parts = typed(_with_source(raw, schemas.DIRECTOR_COLUMNS), key="security_code", day="month", parse=c.parse_month_end)
    return _latest(parts, ["security_code", "month"])


def quarterly_table(raw: DataFrame) -> Parts:
    """Quarterly accounts: every item that is a number goes into the map ``data``."""
    items = overflow_map(raw, ["證券代碼", "年月"], number=c.clean_number)
    extra = ["_src"] if "_src" in raw.columns else []
    rows = raw.select(
        c.text_key(F.col("證券代碼")).alias("security_code"),
        c.parse_month_end(F.col("年月")).alias("season"),
        F.coalesce(items, F.create_map().cast("map<string,double>")).alias("data"),
        *extra,
    )
    rules = {"key": F.col("security_code").isNull(), "date": F.col("season").isNull()}
    return _latest(split_rejects(rows, rules), ["security_code", "season"])


def deposit_rates(raw: DataFrame) -> DataFrame:
    """(bank, date, rate_1y) of the deposit files."""
    good, _ = typed(_with_source(raw, schemas.DEPOSIT_COLUMNS), key="bank", day="date", parse=c.parse_day)
    return good.drop("_src")


def fx_table(raw: DataFrame) -> Parts:
    """Currency quotes: key (currency, date); of equal keys the later file counts, blank keys are rejected."""
    named = _with_source(raw, schemas.FX_COLUMNS)
    rows = named.withColumns(
        {
            "currency": c.currency_code(F.col("currency")),
            "date": c.parse_iso_day(F.col("date")),
            "change_pct": c.clean_percent(F.col("change_pct")),
            **{n: c.clean_number(F.col(n)) for n in ("close", "open", "high", "low")},
        }
    )
    return _latest(split_rejects(rows, {"key": F.coalesce(F.col("currency") == "", F.lit(True)), "date": F.col("date").isNull()}), ["currency", "date"])


def index_history_table(raw: DataFrame) -> Parts:
    named = _with_source(raw, schemas.INDEX_HISTORY_COLUMNS)
    number = partial(c.clean_number, drop="[,+]")
    rows = named.withColumns(
        {
            "index_code": c.text_or_null(F.col("index_code")),
            "index_name": c.text_or_null(F.col("index_name")),
            "trade_date": c.parse_slash_day(F.col("trade_date")),
            **{n: number(F.col(n)).try_cast(t) for n, t in schemas.INDEX_HISTORY_TYPES.items()},
        }
    )
    return _latest(split_rejects(rows, {"key": F.col("index_code").isNull(), "date": F.col("trade_date").isNull()}), ["index_code", "trade_date"])


def revenue_table(raw: DataFrame) -> Parts:
    named = _with_source(raw, schemas.REVENUE_COLUMNS)
    rows = named.withColumns(
        {
            "security_code": c.text_or_null(F.col("security_code")),
            "security_name": c.text_or_null(F.col("security_name")),
            "month": c.parse_month_start(F.col("month")),
            "revenue_ntd_thousand": c.clean_number(F.col("revenue_ntd_thousand")).try_cast("bigint"),
        }
    )
    rules = {
        "key": F.col("security_code").isNull(),
        "date": F.col("month").isNull(),
        "revenue": F.col("revenue_ntd_thousand").isNull(),
    }
    return _latest(split_rejects(rows, rules), ["security_code", "month"])


def security_master(rows: DataFrame) -> DataFrame:
    """(security_code, ticker, name, market) of the distinct ``"code name"`` texts."""
    codes = rows.select("security_code").where(F.col("security_code").isNotNull()).distinct()
    ticker = c.code_of(F.col("security_code"))
    return codes.select(
        "security_code", ticker.alias("ticker"), c.name_of(F.col("security_code")).alias("name"), c.market_of(ticker).alias("market")
    )


def research_panel(prices: DataFrame) -> DataFrame:
    """Price table -> panel of the research jobs: code split off, measures under short names."""
    names = [F.col(k).alias(v) for k, v in schemas.PANEL_NAMES.items() if k in prices.columns]
    key = F.col("security_code")
    return prices.select(c.code_of(key).alias("stock_code"), c.name_of(key).alias("name"), "date", *names)


def load_into(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str] | None = None, *, day: str | None = None, table: str | None = None, backup: str | None = None,
    master: str | None = None, stamp: str | None = None, schema: str | None = None,
) -> DataFrame:
    """Whole load of one table: snapshot, upsert, new securities, report (total, added, first and last day).

    ``table`` names one of ``schemas.TABLES``, which then gives schema, keys and day. The rows are stored once, so that the sources are parsed once. Of
    equal keys the one from the later file (``_src``) counts.
    """
    if table is not None:
        schema, keys, day = schemas.TABLES[table]
        stamp = stamp or ("updated_at" if "updated_at timestamp" in schema else None)
    rows = materialize(rows, "load")
    stored = read_table(spark, path)
    before = 0 if stored is None else stored.count()
    if backup:
        snapshot(spark, path, backup)
    upsert(spark, path, rows, keys, day=day, stamp=stamp, schema=schema, recency=["_src"] if "_src" in rows.columns else ())
    if master:
        insert_new(spark, master, security_master(rows), ["security_code"], schema=schemas.MASTER_TABLE)
    return load_report(load_table(spark, path), day, before=before)


def cached_panel(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force_source: bool = False) -> DataFrame:
    """The consolidated panel table if it exists, else the panel built from the sources."""
    stored = None if force_source else read_table(spark, path)
    return build() if stored is None else stored
