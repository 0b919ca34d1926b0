"""The research inputs, derived from the test tables (which hold no prices)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finpanel.functions import trimmed
from finpanel.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Security-by-day panel: line items per supplier and ship day. Rows are reduced before any join."""
    li = table(spark, sf, "lineitem")
    c = F.col

    def any_row(cond) -> F.Column:
        return F.max(cond.cast("int")) == 1

    daily = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        (F.max("l_extendedprice") / 10000).alias("amp_pct"),
        trimmed(F.max("l_discount") * 100 - 5, 4).alias("return_pct"),
        F.sum("l_quantity").alias("volume"),
        F.max("l_quantity").alias("_q"),
        (F.min("l_extendedprice") / 2000).alias("pe"),
        (F.min("l_extendedprice") / 20000).alias("pb"),
        F.when(F.max("l_tax") >= 0.01, trimmed(F.max("l_tax") * 100, 2)).alias("div_yield"),
        trimmed(F.max("l_tax") * 50 + 0.5, 2).alias("cash_div"),
        any_row((c("l_returnflag") == "A") & (c("l_linestatus") == "F")).alias("_a"),
        any_row((c("l_returnflag") == "R") & (c("l_linestatus") == "F") & (c("l_quantity") > 45)).alias("_d"),
        any_row(
            (c("l_returnflag") == "N") & (c("l_linestatus") == "F") & (c("l_quantity") == 50) & (c("l_discount") >= 0.1)
        ).alias("_y"),
    )
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return daily.join(sup, "l_suppkey").select(
        (c("l_suppkey") + 1000).cast("string").alias("stock_code"), "date", "amp_pct", "return_pct", "volume",
        trimmed(c("s_acctbal") + 1100 + c("_q"), 2).alias("market_cap"), "pe", "pb", "div_yield", "cash_div",
        (c("_q") / 50).alias("beta"),
        F.when(c("_a"), "A").alias("alert_a"), F.when(c("_d"), "D").alias("disposition_d"),
        F.when(c("_y"), "Y").alias("full_delivery_y"),
    )


PANEL = """panel AS (
  SELECT CAST(1000 + l_suppkey AS VARCHAR) AS stock_code, CAST(l_shipdate AS DATE) AS date,
    max(l_extendedprice) / 10000 AS amp_pct, round(max(l_discount) * 100 - 5, 4) AS return_pct,
    sum(l_quantity) AS volume, round(any_value(s_acctbal) + 1100 + max(l_quantity), 2) AS market_cap,
    min(l_extendedprice) / 2000 AS pe, min(l_extendedprice) / 20000 AS pb,
    CASE WHEN max(l_tax) >= 0.01 THEN round(max(l_tax) * 100, 2) END AS div_yield,
    round(max(l_tax) * 50 + 0.5, 2) AS cash_div, max(l_quantity) / 50 AS beta,
    CASE WHEN bool_or(l_returnflag = 'A' AND l_linestatus = 'F') THEN 'A' END AS alert_a,
    CASE WHEN bool_or(l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45) THEN 'D' END AS disposition_d,
    CASE WHEN bool_or(l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity = 50 AND l_discount >= 0.1) THEN 'Y' END AS full_delivery_y
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""


def stored_panel(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The panel as a table of its own, as the studies expect it: several jobs read it. With the columns ``cols`` where these are all that is read."""
    p = panel(spark, sf)
    return materialize(p.select(*cols) if cols else p, "panel")


def market(p: DataFrame) -> DataFrame:
    """Market return per day, the mean over all securities (one row per day)."""
    return p.groupBy("date").agg(F.round(F.avg("return_pct"), 6).alias("mkt_pct"))


MARKET = "market AS (SELECT date, round(avg(return_pct), 6) AS mkt_pct FROM panel GROUP BY date)"


def index_rows(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    """Index rows: the market, and the securities of three regions."""
    region = (
        table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .select((F.col("s_suppkey") + 1000).cast("string").alias("stock_code"), "n_regionkey")
    )
    codes = F.when(F.col("n_regionkey") == 0, "SC300").when(F.col("n_regionkey") == 1, "TM100").when(F.col("n_regionkey") == 2, "TWN50")
    tagged = p.select("stock_code", "date", "return_pct").join(region, "stock_code").withColumn("idx", codes)
    both = tagged.select("date", "return_pct", F.explode(F.array(F.lit("Y9999"), F.col("idx"))).alias("stock_code"))
    return both.where(F.col("stock_code").isNotNull()).groupBy("stock_code", "date").agg(F.round(F.avg("return_pct"), 6).alias("return_pct"))


INDEX_ROWS = """index_rows AS (
  SELECT 'Y9999' AS stock_code, date, round(avg(return_pct), 6) AS return_pct FROM panel GROUP BY date
  UNION ALL
  SELECT ['SC300', 'TM100', 'TWN50'][n_regionkey + 1] AS stock_code, date, round(avg(return_pct), 6) AS return_pct
  FROM panel JOIN supplier ON CAST(1000 + s_suppkey AS VARCHAR) = stock_code JOIN nation ON s_nationkey = n_nationkey
  WHERE n_regionkey < 3 GROUP BY n_regionkey, date)"""


def with_index(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    """Price panel as delivered: securities and index rows together."""
    return p.unionByName(index_rows(spark, sf, p), allowMissingColumns=True)


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Deposit rates per bank and day (order priorities stand in for banks)."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("bank"), F.to_date("o_orderdate").alias("date")).agg(
        (F.max("o_totalprice") / 250000 - 0.2).alias("rate_1y")
    )


RATES = """rates AS (SELECT o_orderpriority AS bank, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 250000 - 0.2 AS rate_1y
  FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))"""


def fx(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes per nation and order day; every 13th day of a series has no close."""
    nation = F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    quotes = (
        table(spark, sf, "orders").join(customers, "o_custkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("currency"), F.to_date("o_orderdate").alias("date"))
        .agg((F.max("o_totalprice") / 100000).alias("close"))
    )
    return quotes.withColumn("close", F.when(F.dayofyear("date") % 13 != 0, F.col("close")))


FX = """fx AS (SELECT n_name AS currency, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN dayofyear(CAST(o_orderdate AS DATE)) % 13 <> 0 THEN max(o_totalprice) / 100000 END AS close
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, CAST(o_orderdate AS DATE))"""


def securities(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier names as ``"code name"`` texts; every fifth code gets a fifth digit, every seventh a letter."""
    key = F.col("s_suppkey")
    code = F.when(key % 7 == 3, F.concat(F.lit("IX"), key)).when(key % 5 == 2, (key + 50000).cast("string")).otherwise((key + 1000).cast("string"))
    return table(spark, sf, "supplier").select(F.concat(code, F.lit(" "), "s_name").alias("security_code"), "s_suppkey", "s_nationkey", "s_acctbal")


SECURITIES = """securities AS (SELECT (CASE WHEN s_suppkey % 7 = 3 THEN 'IX' || s_suppkey WHEN s_suppkey % 5 = 2 THEN CAST(s_suppkey + 50000 AS VARCHAR)
    ELSE CAST(s_suppkey + 1000 AS VARCHAR) END) || ' ' || s_name AS security_code, s_suppkey, s_nationkey, s_acctbal FROM supplier)"""
