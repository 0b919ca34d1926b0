"""Cleaning, loading, table maintenance, lists and currency series: queries and SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.study import BREADTH, _r6sql, breadth, r6
from finpanel import schemas
from finpanel.functions import cleaning as c
from finpanel.functions.measures import json_number
from finpanel.operators import keys as ks
from finpanel.plans import fx as fxp
from finpanel.plans import market as mk
from finpanel.plans import universe as un
from finpanel.session import materialize, scratch_path
from finpanel.sources import listing, loads, sinks, tables, vendor
from finpanel.streaming import stream_upsert

# ---- dirty text -----------------------------------------------------------------------------------


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as vendor text, spoilt in ways that depend on the order key."""
    k, price, day = F.col("l_orderkey") % 8, F.col("l_extendedprice"), F.col("l_shipdate")
    plain = F.format_string("%.2f", price)
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(k == 0, F.format_number(price, 2)).when(k == 1, "--").when(k == 2, F.concat(F.lit("  "), plain, F.lit(" ")))
        .when(k == 3, F.concat(F.lit("+"), plain)).when(k == 4, "N/A").when(k == 5, F.concat(F.lit("-"), plain)).when(k == 6, "nan").otherwise("inf").alias("num_text"),
        F.when(k == 4, "").otherwise(F.format_string("%+.2f%%", F.col("l_tax") * 100 + 0.0)).alias("pct_text"),
        F.when(k == 3, "20240230").when(k == 5, "2024013").when(k == 6, "abc").otherwise(F.date_format(day, "yyyyMMdd")).alias("day_text"),
        F.when(k == 2, "202613").when(k == 3, "20261").otherwise(F.date_format(day, "yyyyMM")).alias("month_text"),
        F.when(k == 1, "1999-02-31").when(k < 4, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("slash_text"),
        F.when(k == 1, "1999/13").when(k == 2, "1999").when(k < 5, F.date_format(day, "yyyy/MM")).otherwise(F.date_format(day, "yyyy-MM")).alias("ym_text"),
    )


DIRTY = """dirty AS (SELECT l_orderkey, l_linenumber, l_partkey,
    CASE l_orderkey % 8 WHEN 0 THEN format('{:,.2f}', l_extendedprice) WHEN 1 THEN '--' WHEN 2 THEN '  ' || printf('%.2f', l_extendedprice) || ' '
      WHEN 3 THEN '+' || printf('%.2f', l_extendedprice) WHEN 4 THEN 'N/A' WHEN 5 THEN '-' || printf('%.2f', l_extendedprice) WHEN 6 THEN 'nan' ELSE 'inf' END AS num_text,
    CASE WHEN l_orderkey % 8 = 4 THEN '' ELSE (CASE WHEN l_tax < 0 THEN '' ELSE '+' END) || printf('%.2f', l_tax * 100 + 0.0) || '%' END AS pct_text,
    CASE l_orderkey % 8 WHEN 3 THEN '20240230' WHEN 5 THEN '2024013' WHEN 6 THEN 'abc' ELSE strftime(l_shipdate, '%Y%m%d') END AS day_text,
    CASE l_orderkey % 8 WHEN 2 THEN '202613' WHEN 3 THEN '20261' ELSE strftime(l_shipdate, '%Y%m') END AS month_text,
    CASE WHEN l_orderkey % 8 = 1 THEN '1999-02-31' WHEN l_orderkey % 8 < 4 THEN strftime(l_shipdate, '%Y/%m/%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS slash_text,
    CASE WHEN l_orderkey % 8 = 1 THEN '1999/13' WHEN l_orderkey % 8 = 2 THEN '1999' WHEN l_orderkey % 8 < 5 THEN strftime(l_shipdate, '%Y/%m') ELSE strftime(l_shipdate, '%Y-%m') END AS ym_text
  FROM lineitem)"""
NUM_SQL = r"CASE WHEN regexp_matches(replace(trim(num_text), ',', ''), '^[+-]?[0-9]+\.?[0-9]*$') THEN CAST(replace(trim(num_text), ',', '') AS DOUBLE) END"
DAY_SQL = "CASE WHEN regexp_matches(day_text, '^[0-9]{8}$') THEN CAST(try_strptime(day_text, '%Y%m%d') AS DATE) END"


def clean_numbers(spark, sf):
    return dirty(spark, sf).select("l_orderkey", "l_linenumber", c.clean_number(F.col("num_text")).alias("num"), c.clean_percent(F.col("pct_text")).alias("pct"))


def parsed_dates(spark, sf):
    return dirty(spark, sf).select(
        "l_orderkey", "l_linenumber", c.parse_day(F.col("day_text")).alias("day"), c.parse_month_end(F.col("month_text")).alias("month_end"),
        c.parse_slash_day(F.col("slash_text")).alias("slash_day"), c.parse_month_start(F.col("ym_text")).alias("month_start"),
    )


def security_codes(spark, sf):
    return loads.security_master(v.securities(spark, sf))


def reject_counts(spark, sf):
    rows = dirty(spark, sf).withColumns({"date": c.parse_day(F.col("day_text")), "num": c.clean_number(F.col("num_text"))})
    return ks.reject_totals(rows, {"date": F.col("date").isNull(), "number": F.col("num").isNull()})


def _chip_text(spark, sf):
    o, price, key = v.table(spark, sf, "orders"), F.col("o_totalprice"), F.col("o_orderkey")
    return o.select(
        F.concat(key.cast("string"), F.lit(" name")).alias("證券代碼"), F.date_format("o_orderdate", "yyyyMMdd").alias("年月日"),
        F.format_number(price, 2).alias("外資買賣超(張)"), F.when(key % 3 == 0, "-").otherwise(F.format_string("%.2f", price)).alias("甲"),
        F.when(key % 2 == 0, "text").otherwise(F.format_string("%d", key)).alias("乙"), F.lit("1").alias("當日收盤"),
    )


def chip_overflow(spark, sf):
    good, _ = loads.chip_table(_chip_text(spark, sf))
    first, second = (F.try_element_at("extras", F.lit(x)) for x in ("甲", "乙"))
    return good.select("security_code", "date", "fi_net_buy_lot", first.alias("a"), second.alias("b"), F.coalesce(F.size("extras"), F.lit(0)).alias("items"))


def quarterly_kpi(spark, sf):
    """Accounts per customer and quarter as text items, loaded into item maps, then read out as key figures."""
    quarter_month = F.add_months(F.trunc("o_orderdate", "quarter"), 2)
    per = v.table(spark, sf, "orders").groupBy("o_custkey", F.date_format(quarter_month, "yyyyMM").alias("年月")).agg(
        F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.count(F.lit(1)).alias("n")
    )
    raw = per.select(
        F.col("o_custkey").cast("string").alias("證券代碼"), "年月", F.format_number("hi", 2).alias("每股盈餘"),
        F.format_string("%.2f", "lo").alias("ROE(A)－稅後"), F.when(F.col("n") > 1, F.format_string("%d", "n")).otherwise("--").alias("營業毛利率"),
    )
    good, _ = loads.quarterly_table(raw)
    return vendor.kpi_view(good, schemas.QUARTERLY_KPI)


def json_items(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", json_number(F.col("props"), "k").alias("k"), json_number(F.col("props"), "absent").alias("absent"))


def monthly_revenue(spark, sf):
    """Revenue text per supplier and month, with bad months and names, loaded and deduplicated."""
    li = v.table(spark, sf, "lineitem")
    per = li.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("m")).agg(F.max("l_extendedprice").alias("x"))
    key = F.col("l_suppkey")
    raw = per.select(
        key.cast("string").alias("代號"), F.when(key % 3 == 0, " ").otherwise(F.concat(F.lit("N"), key)).alias("名稱"),
        F.when(key % 11 == 5, "2024/00").when(key % 2 == 0, F.date_format("m", "yyyy/MM")).otherwise(F.date_format("m", "yyyy-MM")).alias("年度月份"),
        F.when(key % 13 == 7, "--").otherwise(F.format_number(F.floor("x"), 0)).alias("當月營收_仟元"),
    )
    return loads.revenue_table(raw)[0]


def index_history(spark, sf):
    """Index text with signs, commas and both date forms, loaded with its decimal types."""
    p, key = v.panel(spark, sf), F.col("stock_code").cast("int")
    raw = p.select(
        F.when(key % 9 == 4, "").otherwise(F.col("stock_code")).alias("指數代碼"), F.lit("  ").alias("指數名稱"),
        F.when(key % 2 == 0, F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyy-MM-dd")).alias("日期"),
        F.format_number(F.col("amp_pct") * 10000, 2).alias("價格指數值"), F.lit("--").alias("報酬指數值"),
        F.format_string("%+.2f", F.col("return_pct") + 0.0).alias("漲跌點數"), F.format_string("%.2f", F.col("return_pct") + 0.0).alias("漲跌百分比"),
    )
    good, _ = loads.index_history_table(raw)
    return good.select("index_code", "index_name", "trade_date", *[F.col(n).cast("double").alias(n) for n in schemas.INDEX_HISTORY_TYPES])


# ---- keys -----------------------------------------------------------------------------------------


def dedupe_latest(spark, sf):
    rows = v.table(spark, sf, "lineitem").withColumns({n: F.col(n) + 0.0 for n in ("l_discount", "l_tax")})
    return ks.dedupe_latest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


def dedupe_first(spark, sf):
    """Two code lists, suppliers before customers; of equal codes the first list wins."""
    sup = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.lit("A").alias("category"))
    cus = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return listing.select_category([sup, cus], None)


# ---- tables ---------------------------------------------------------------------------------------


def _panel_part(spark, sf):
    return v.panel(spark, sf).select("stock_code", "date", "amp_pct", "volume")


KEYS = ["stock_code", "date"]


def upserted(spark, sf):
    """Old rows, then an overlapping batch without one of the columns: keys in both take the new values."""
    p, path = materialize(_panel_part(spark, sf), "panel"), scratch_path(spark, "table-upsert")
    tables.upsert(spark, path, p.where("date < '1998-01-01'"), KEYS, day="date")
    batch = p.where("date >= '1997-07-01'").select("stock_code", "date", (F.col("volume") + 1).alias("volume"))
    tables.upsert(spark, path, batch, KEYS, day="date")
    return tables.load_table(spark, path)


PANEL_TABLE = "stock_code string, date date, amp_pct double, volume double, note string"


def upserted_columns(spark, sf):
    """Batches with more and with fewer columns over the same months, under a declared schema: no column is lost."""
    p, path = materialize(_panel_part(spark, sf), "panel"), scratch_path(spark, "table-columns")
    tables.upsert(spark, path, p.where("date < '1998-01-01'"), KEYS, day="date", schema=PANEL_TABLE)
    middle = p.where("date >= '1997-07-01' AND date < '1999-01-01'").select("stock_code", "date", F.lit("new").alias("note"))
    tables.upsert(spark, path, middle, KEYS, day="date", schema=PANEL_TABLE)
    last = p.where("date >= '1998-07-01'").select("stock_code", "date", (F.col("volume") + 1).alias("volume"))
    tables.upsert(spark, path, last, KEYS, day="date", schema=PANEL_TABLE)
    return tables.load_table(spark, path, PANEL_TABLE)


def inserted_new(spark, sf):
    """Insert-if-absent: keys in both keep the stored values."""
    p, path = materialize(_panel_part(spark, sf), "panel"), scratch_path(spark, "table-insert")
    tables.insert_new(spark, path, p.where("date < '1998-01-01'"), KEYS, day="date")
    tables.insert_new(spark, path, p.where("date >= '1997-07-01'").withColumn("volume", F.col("volume") + 1), KEYS, day="date")
    return tables.load_table(spark, path)


def snapshot_restored(spark, sf):
    p, path = materialize(_panel_part(spark, sf), "panel"), scratch_path(spark, "table-snap")
    tables.upsert(spark, path, p.where("date < '1998-01-01'"), KEYS, day="date")
    copy = tables.snapshot(spark, path, scratch_path(spark, "backup"), at=datetime(2024, 1, 2, 3, 4, 5))
    tables.upsert(spark, path, p.withColumn("volume", F.lit(0.0)), KEYS, day="date")
    tables.restore(spark, copy, path)
    return tables.load_table(spark, path)


def load_report(spark, sf):
    """Report of a whole load: rows now, added, date range; the batch is loaded over a stored part."""
    p, path = materialize(_panel_part(spark, sf).withColumnRenamed("stock_code", "security_code"), "panel"), scratch_path(spark, "table-load")
    tables.upsert(spark, path, p.where("date < '1998-01-01'"), ["security_code", "date"], day="date")
    return loads.load_into(
        spark, path, p.where("date >= '1997-07-01'"), ["security_code", "date"], day="date",
        backup=scratch_path(spark, "backup"), master=scratch_path(spark, "master"),
    )


def incremental_twice(spark, sf):
    """Last days reloaded twice over a table of all days; the second run changes nothing."""
    p, path = materialize(_panel_part(spark, sf), "panel"), scratch_path(spark, "table-incr")
    tables.upsert(spark, path, p, KEYS, day="date")
    batch = p.withColumn("volume", F.col("volume") + 1)
    for _ in range(2):
        tables.incremental_load(spark, path, batch, KEYS, lookback_days=7)
    return tables.load_table(spark, path)


def streamed(spark, sf):
    """The panel arrives as files; the stream merges all that is new, then stops. Run twice."""
    src, path, progress = (scratch_path(spark, n) for n in ("stream-in", "table-stream", "stream-progress"))
    p = materialize(_panel_part(spark, sf), "panel")
    for part in (p.where("date < '1998-01-01'"), p.where("date >= '1997-07-01'").withColumn("volume", F.col("volume") + 1)):
        part.write.mode("append").parquet(src)
        source = spark.readStream.schema(p.schema).parquet(src)
        stream_upsert(spark, source, path, KEYS, day="date", progress=progress).awaitTermination()
    return tables.load_table(spark, path)


def streamed_late(spark, sf):
    """Files of one key in one micro-batch, and an older file that arrives last: the greatest file number counts throughout."""
    src, path, progress = (scratch_path(spark, n) for n in ("stream-in", "table-stream", "stream-progress"))
    p = materialize(_panel_part(spark, sf), "panel")

    def file(number, rows):
        return rows.select("stock_code", "date", (F.col("volume") + number).alias("volume"), F.lit(number).alias("_file"))

    arrivals = [[file(3, p.where("date < '1996-01-01'")), file(2, p.where("date < '1997-01-01'"))], [file(4, p.where("date >= '1998-01-01'"))], [file(1, p)]]
    schema = arrivals[0][0].schema
    for files in arrivals:
        for rows in files:
            rows.write.mode("append").parquet(src)
        source = spark.readStream.schema(schema).parquet(src)
        stream_upsert(spark, source, path, KEYS, day="date", progress=progress, recency=["_file"]).awaitTermination()
    return tables.load_table(spark, path)


def loaded_table(spark, sf):
    """Monthly revenue through the whole load, by declared table: types, and the time of the load on every row."""
    path = scratch_path(spark, "table-revenue")
    rows = materialize(monthly_revenue(spark, sf), "revenue")
    for part in (rows.where("month < '1996-01-01'"), rows.where("month >= '1995-06-01'").withColumn("revenue_ntd_thousand", F.col("revenue_ntd_thousand") + 1)):
        loads.load_into(spark, path, part, table="monthly_revenue")
    return tables.load_table(spark, path).select("security_code", "security_name", "month", "revenue_ntd_thousand", F.col("updated_at").isNotNull().alias("stamped"))


def row_counts(spark, sf):
    return tables.row_counts({t: v.table(spark, sf, t) for t in ("orders", "lineitem", "events", "supplier")})


def legacy_names(spark, sf):
    p = v.panel(spark, sf).select("stock_code", F.col("date").alias("trade_date"), "volume")
    return vendor.rename_legacy(p, schemas.LEGACY_NAMES)


# ---- text files -----------------------------------------------------------------------------------


def vendor_files(spark, sf):
    """The panel written as UTF-16 text in two layouts (other column order, other columns), read back by name."""
    p = materialize(v.panel(spark, sf).select("stock_code", "date", "amp_pct", "return_pct", "volume"), "panel")
    folder = scratch_path(spark, "vendor")
    key, day = F.concat("stock_code", F.lit(" 名稱")).alias("證券代碼"), F.date_format("date", "yyyyMMdd").alias("年月日")
    amp, ret, vol = (F.col(n).cast("string").alias(h) for n, h in (("amp_pct", "高低價差%"), ("return_pct", "報酬率％"), ("volume", "成交量(千股)")))
    for part, cols in ((p.where("date < '1998-01-01'"), [key, day, amp, ret]), (p.where("date >= '1998-01-01'"), [day, key, vol, amp])):
        part.select(*cols).write.mode("append").options(sep="\t", header=True, encoding="UTF-16").csv(folder)
    raw, _ = vendor.read_vendor(spark, f"{folder}/*.csv", key="證券代碼", columns=list(schemas.PRICE_COLUMNS))
    good, _ = loads.daily_table(raw, schemas.PRICE_COLUMNS, text=schemas.PRICE_TEXT)
    return loads.research_panel(good).select("stock_code", "name", "date", "amp_pct", "return_pct", "volume")


def vendor_skipped(spark, sf):
    """Panel rows by year in files of several kinds: rows per security and year that were read, and the files that were not, with the reason.

    Plain and compressed files are good; one kind has no header, one is no compressed file though its name says so, one is in an encoding that can't be read to its end.
    All tasks write the files of a kind, but the two that are not read are counted as one file each. The kinds are written side by side.
    """
    folder = scratch_path(spark, "kinds")
    text = v.panel(spark, sf).select(F.concat("stock_code", F.lit(" 名稱")).alias("證券代碼"), F.date_format("date", "yyyyMMdd").alias("年月日"), F.col("amp_pct").alias("高低價差%"))
    p = materialize(text.withColumn("year", F.substring("年月日", 1, 4)), "panel-text", "year")
    kinds = {
        "plain": dict(header=True, encoding="UTF-16"), "bare": dict(header=True, encoding="UTF-16LE"), "packed": dict(header=True, encoding="UTF-16", compression="gzip"),
        "headless": dict(header=False, encoding="UTF-16"), "torn": dict(header=True, encoding="UTF-16"), "mixed": dict(header=True, encoding="UTF-16LE"),
    }

    def write(year: int, kind: str) -> None:
        part = p.where(F.col("year") == str(year)).drop("year")
        if kind == "mixed":  # half of a pair of code units, as cut by a careless tool
            part = part.withColumn("高低價差%", F.concat(F.col("高低價差%").cast("string"), F.lit("\ufffd")))
        if kind in ("headless", "torn"):
            part = part.coalesce(1)
        part.write.options(sep="\t", **kinds[kind]).csv(f"{folder}/{kind}")

    with ThreadPoolExecutor(len(kinds)) as pool:
        list(pool.map(write, range(1993, 1993 + len(kinds)), kinds))
    _rename_parts(spark, f"{folder}/torn", ".gz")
    raw, skipped = vendor.read_vendor(spark, f"{folder}/*/*", key="證券代碼")
    rows = raw.groupBy(F.substring_index("證券代碼", " ", 1).alias("name"), F.substring("年月日", 1, 4).alias("detail")).agg(F.count(F.lit(1)).alias("cnt"))
    left = skipped.groupBy(F.element_at(F.split("path", "/"), -2).alias("name"), F.col("reason").alias("detail")).agg(F.count(F.lit(1)).alias("cnt"))
    return rows.unionByName(left)


def _rename_parts(spark, folder, end):
    """Files of ``folder`` get a longer name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(where):
        if status.getPath().getName().startswith("part-"):
            files.rename(status.getPath(), status.getPath().suffix(end))


def fx_files(spark, sf):
    """Currency quotes written as comma text, read back and loaded."""
    folder = scratch_path(spark, "fx")
    q = v.fx(spark, sf).select(
        F.concat(F.lit(" "), F.lower("currency")).alias("currency"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("close").cast("string").alias("close"),
        F.lit("1,000.5").alias("open"), F.lit("--").alias("high"), F.lit("").alias("low"), F.lit("+0.03%").alias("change%"),
    )
    q.write.options(header=True).csv(folder)
    good, _ = loads.fx_table(vendor.read_bom_csv(spark, folder, required=list(schemas.FX_COLUMNS)))
    return good


def fx_mixed_headers(spark, sf):
    """Quotes in two files with their own column orders; keys in both take the later file's close, blank keys go to the rejects."""
    folder, q = scratch_path(spark, "fx-mixed"), v.fx(spark, sf)
    day, close = F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("close").cast("string").alias("close")
    rest = [F.lit("1").alias(n) for n in ("open", "high", "low")] + [F.lit("0%").alias("change%")]
    blank = F.when(F.dayofyear("date") % 17 == 0, " ").otherwise(F.col("currency")).alias("currency")
    q.select(F.col("currency"), day, close, *rest).coalesce(1).write.options(header=True).csv(f"{folder}/a")
    q.select(day, *rest, (F.col("close") + 1).cast("string").alias("close"), blank).coalesce(1).write.options(header=True).csv(f"{folder}/b")
    raw = vendor.read_bom_csv(spark, [f"{folder}/a", f"{folder}/b"], required=list(schemas.FX_COLUMNS))
    own = F.when(F.col("_src").isin([r[0] for r in vendor.read_bom_csv(spark, f"{folder}/b", required=list(schemas.FX_COLUMNS)).select("_src").distinct().collect()]), "b").otherwise("a")
    good, bad = loads.fx_table(raw.withColumn("_src", own))
    rows = good.select("currency", "date", "close", F.lit(None).cast("string").alias("reason"))
    return rows.unionByName(bad.select(F.lit(None).cast("string").alias("currency"), "date", "close", F.col("reject_reason").alias("reason")))


def csv_export(spark, sf):
    """Momentum-free panel part exported as CSV in (date, code) order and read back."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(_panel_part(spark, sf), path, order=["date", "stock_code"])
    return spark.read.schema("stock_code string, date date, amp_pct double, volume double").csv(path, header=True)


def ordered_export(spark, sf):
    """The panel as ordered text files: read back, every row has the number that its place in the files gives it."""
    path = scratch_path(spark, "ordered")
    sinks.write_ordered(_panel_part(spark, sf), path, ["date", "stock_code"])
    return sinks.read_ordered(spark, path, "stock_code string, date date, amp_pct double, volume double")


def written_lists(spark, sf):
    """All lists written from listings of suppliers, read back in the order of the files: list, row, code, name, isin."""
    rows = listing.extract_table_rows(listing_pages(spark, sf)).withColumn("category", F.when(F.col("code").cast("int") % 5 == 0, "ETF").otherwise("股票"))
    later = rows.withColumn("name", F.concat("name", F.lit("-later")))
    listings = {"listed": rows.where(F.col("code").cast("int") % 2 == 0), "otc": later, "emerging": rows, "funds": later, "indices": rows.where(F.col("code").cast("int") % 3 == 0)}
    paths = listing.write_lists({k: materialize(r, "listing") for k, r in listings.items()}, scratch_path(spark, "lists"))
    out = None
    for name, path in paths.items():
        columns = listing.LIST_COLUMNS[listing.LISTS[name][2]]
        back = sinks.read_ordered(spark, path, ", ".join(f"{c} string" for c in columns))
        part = back.select(F.lit(name).alias("list"), "row", "code", "name", (F.col("isin") if "isin" in columns else F.lit(None).cast("string")).alias("isin"))
        out = part if out is None else out.unionByName(part)
    return out


def json_export(spark, sf):
    """The published market amplitude series, written as JSON records and read back."""
    path = scratch_path(spark, "json")
    sinks.write_json(mk.amplitude_export(breadth(spark, sf)), path)
    out = spark.read.schema("date string, amp_big_pct double, mkt_hi90 double, mkt_lo10 double").json(path)
    return r6(out, "amp_big_pct", "mkt_hi90", "mkt_lo10")


def cached_panel(spark, sf):
    """The consolidated panel: built from the source once, then read from its table."""
    path = scratch_path(spark, "consolidated")
    sinks.write_panel(loads.cached_panel(spark, path, lambda: v.panel(spark, sf)), path)
    return loads.cached_panel(spark, path, lambda: v.panel(spark, sf).limit(0))


# ---- lists ----------------------------------------------------------------------------------------


def listing_pages(spark, sf) -> DataFrame:
    """Listing pages of 50 suppliers each; a single-cell row opens each nation."""
    sup = v.table(spark, sf, "supplier").join(F.broadcast(v.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    page = F.floor(F.col("s_suppkey") / 50).alias("page_id")
    rows = sup.groupBy(page).agg(F.sort_array(F.collect_list(F.struct("s_nationkey", "s_suppkey", "s_name", "n_name"))).alias("rs"))

    def html(x, i):
        opens = (i == 0) | (F.get("rs", i - 1)["s_nationkey"] != x["s_nationkey"])
        title = F.when(opens, F.concat(F.lit('<tr><td bgcolor=#FAFAD2 colspan=7 ><B> '), x["n_name"], F.lit(" <B> </td></tr>"))).otherwise("")
        code = x["s_suppkey"].cast("string")
        return F.concat(title, F.lit("<tr><td>"), code, F.lit("　"), x["s_name"], F.lit("</td><td>TW"), code, F.lit("</td>\n<td>1999/01/02</td><td>M</td></tr>"))

    body = F.array_join(F.transform("rs", html), "")
    head = "<table class='h4'><tr><td>header</td><td>ISIN</td></tr>"
    return rows.select("page_id", F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


def listing_rows(spark, sf):
    return listing.extract_table_rows(listing_pages(spark, sf)).drop("pos")


def listed_selection(spark, sf):
    """One category out of two listings (the second with renamed entries), written columns only."""
    rows = listing.extract_table_rows(listing_pages(spark, sf))
    other = rows.withColumn("name", F.concat("name", F.lit("-later")))
    first = rows.where(F.col("code").cast("int") % 2 == 0)
    picked = listing.select_category([first, other], "NATION_3")
    return listing.list_columns(picked, "etf").select(F.col("代號").alias("code"), F.col("名稱").alias("name"), F.col("ISIN").alias("isin"), F.col("市場別").alias("market"))


def sector_lists(spark, sf):
    """Link lists per group, built from suppliers in pages of 50."""
    key = F.col("s_suppkey")
    item = F.concat(F.lit('<li><a href="/index/^'), F.lpad(key.cast("string"), 6, "0"), F.lit('/stocks" target="_blank">'), F.col("s_name"), F.lit("</a></li>"))
    lists = v.table(spark, sf, "supplier").groupBy(F.floor(key / 50).alias("page_id"), (key % 6 + 1).alias("g")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    ul = F.concat(F.lit('<ul class="sectors-list" id="group'), F.col("g").cast("string"), F.lit('">'), F.col("items"), F.lit("</ul>"))
    pages = lists.groupBy("page_id").agg(F.concat_ws("\n", F.collect_list(ul)).alias("html"))
    return listing.extract_sectors(pages)


def page_links(spark, sf):
    return listing.extract_list_items(v.table(spark, sf, "pages"))


# ---- currency and plain series --------------------------------------------------------------------


def cross_rates(spark, sf):
    return r6(fxp.cross_rate(v.fx(spark, sf), "NATION_3"), "bridge_close", "close")


def fx_filled(spark, sf):
    return ks.forward_fill(v.fx(spark, sf), "close", ["currency"])


def fx_summary(spark, sf):
    return fxp.series_summary(v.fx(spark, sf), ["currency"], value="close")


def fx_table_summary(spark, sf):
    return fxp.keyed_summary(v.fx(spark, sf), "currency", value="close")


def fx_expected(spark, sf):
    return ks.expected_diff(v.fx(spark, sf), "currency", ["NATION_0", "NATION_7", "NATION_99", "XXX"])


def fx_latest_rows(spark, sf):
    return ks.latest(v.fx(spark, sf), ["currency"], 3)


def series_tail(spark, sf):
    one = v.panel(spark, sf).where(F.col("stock_code") == "1001").select("stock_code", "date", "volume")
    return ks.latest(one, [], 10)


def last_day_rows(spark, sf):
    return ks.on_latest_day(v.panel(spark, sf).select("stock_code", "date", "volume"))


def master_join(spark, sf):
    """Daily totals joined to the security master on the full code, for codes with one prefix."""
    names = v.securities(spark, sf).select("s_suppkey", "security_code")
    daily = v.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("volume"))
    rows = daily.join(names, F.col("l_suppkey") == F.col("s_suppkey")).select("security_code", "volume")
    master = loads.security_master(v.securities(spark, sf))
    return rows.join(master, "security_code").where(F.col("ticker").startswith("10")).select("security_code", "ticker", "market", "volume")


def stock_and_market_rows(spark, sf):
    """Rows per class: stocks by code pattern, market rows, other index rows."""
    rows = v.with_index(spark, sf, v.stored_panel(spark, sf))
    kind = F.when(un.is_stock(F.col("stock_code")), "stock").when(un.is_market(F.col("stock_code")), "market").otherwise("index")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cnt"), F.count("volume").alias("with_volume"))


REVENUE = """SELECT CAST(l_suppkey AS VARCHAR) AS security_code, CASE WHEN l_suppkey % 3 <> 0 THEN 'N' || l_suppkey END AS security_name,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(floor(max(l_extendedprice)) AS BIGINT) AS revenue_ntd_thousand FROM lineitem
    WHERE l_suppkey % 11 <> 5 AND l_suppkey % 13 <> 7 GROUP BY l_suppkey, date_trunc('month', l_shipdate)"""

QUERIES = {
    "clean_numbers": clean_numbers,
    "parsed_dates": parsed_dates,
    "security_codes": security_codes,
    "reject_counts": reject_counts,
    "chip_overflow": chip_overflow,
    "quarterly_kpi": quarterly_kpi,
    "json_items": json_items,
    "monthly_revenue": monthly_revenue,
    "index_history": index_history,
    "dedupe_latest": dedupe_latest,
    "dedupe_first": dedupe_first,
    "upserted": upserted,
    "inserted_new": inserted_new,
    "snapshot_restored": snapshot_restored,
    "load_report": load_report,
    "upserted_columns": upserted_columns,
    "incremental_twice": incremental_twice,
    "streamed": streamed,
    "row_counts": row_counts,
    "legacy_names": legacy_names,
    "vendor_files": vendor_files,
    "vendor_skipped": vendor_skipped,
    "fx_files": fx_files,
    "fx_mixed_headers": fx_mixed_headers,
    "csv_export": csv_export,
    "ordered_export": ordered_export,
    "written_lists": written_lists,
    "streamed_late": streamed_late,
    "loaded_table": loaded_table,
    "json_export": json_export,
    "cached_panel": cached_panel,
    "listing_rows": listing_rows,
    "listed_selection": listed_selection,
    "sector_lists": sector_lists,
    "page_links": page_links,
    "cross_rates": cross_rates,
    "fx_filled": fx_filled,
    "fx_summary": fx_summary,
    "fx_table_summary": fx_table_summary,
    "fx_expected": fx_expected,
    "fx_latest_rows": fx_latest_rows,
    "series_tail": series_tail,
    "last_day_rows": last_day_rows,
    "master_join": master_join,
    "stock_and_market_rows": stock_and_market_rows,
}

_PART = "p AS (SELECT stock_code, date, amp_pct, volume FROM panel)"
_MERGED = f"""WITH {v.PANEL}, {_PART}"""
_ORDER = ", ".join(f"{x} DESC NULLS LAST" for x in ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))
_MASTER = "master AS (SELECT security_code, split_part(security_code, ' ', 1) AS ticker, substr(security_code, strpos(security_code, ' ') + 1) AS name FROM securities)"
_MARKET_OF = "CASE WHEN regexp_matches(ticker, '^[0-9]{4}$') THEN 'TSE' WHEN regexp_matches(ticker, '^[0-9]{5}$') THEN 'OTC' ELSE 'INDEX' END AS market"
_LISTED = "listed AS (SELECT s_suppkey // 50 AS page_id, n_name AS category, CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, 'TW' || s_suppkey AS isin, '1999/01/02' AS date, 'M' AS market, '' AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey)"

SQL = {
    "clean_numbers": f"WITH {DIRTY} SELECT l_orderkey, l_linenumber, {NUM_SQL} AS num, CASE WHEN pct_text <> '' THEN CAST(replace(replace(pct_text, '%', ''), '+', '') AS DOUBLE) END AS pct FROM dirty",
    "parsed_dates": f"""WITH {DIRTY} SELECT l_orderkey, l_linenumber, {DAY_SQL} AS day,
        CASE WHEN regexp_matches(month_text, '^[0-9]{{6}}$') THEN last_day(CAST(try_strptime(month_text || '01', '%Y%m%d') AS DATE)) END AS month_end,
        CAST(try_strptime(replace(slash_text, '/', '-'), '%Y-%m-%d') AS DATE) AS slash_day,
        CASE WHEN regexp_matches(ym_text, '^[0-9]{{4}}.[0-9]{{1,2}}$') THEN CAST(try_strptime(replace(ym_text, '/', '-') || '-01', '%Y-%m-%d') AS DATE) END AS month_start FROM dirty""",
    "security_codes": f"WITH {v.SECURITIES}, {_MASTER} SELECT *, {_MARKET_OF} FROM master",
    "reject_counts": f"""WITH {DIRTY}, r AS (SELECT CASE WHEN {DAY_SQL} IS NULL AND {NUM_SQL} IS NULL THEN 'date,number' WHEN {DAY_SQL} IS NULL THEN 'date'
        WHEN {NUM_SQL} IS NULL THEN 'number' ELSE 'clean' END AS reason FROM dirty) SELECT reason, count(*) AS cnt FROM r GROUP BY reason""",
    "chip_overflow": """SELECT o_orderkey || ' name' AS security_code, CAST(o_orderdate AS DATE) AS date, o_totalprice AS fi_net_buy_lot,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS b,
        CAST(o_orderkey % 3 <> 0 AS INTEGER) + CAST(o_orderkey % 2 <> 0 AS INTEGER) AS items FROM orders""",
    "quarterly_kpi": """SELECT CAST(o_custkey AS VARCHAR) AS security_code, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS season,
        max(o_totalprice) AS eps, min(o_totalprice) AS roe, CAST(NULL AS DOUBLE) AS roa, CASE WHEN count(*) > 1 THEN CAST(count(*) AS DOUBLE) END AS gross_margin,
        CAST(NULL AS DOUBLE) AS net_margin, CAST(NULL AS DOUBLE) AS debt_ratio FROM orders GROUP BY o_custkey, date_trunc('quarter', o_orderdate)""",
    "json_items": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS absent FROM events",
    "monthly_revenue": REVENUE,
    "index_history": f"""WITH {v.PANEL} SELECT stock_code AS index_code, CAST(NULL AS VARCHAR) AS index_name, date AS trade_date, CAST(CAST(amp_pct * 10000 AS DECIMAL(18, 2)) AS DOUBLE) AS price_index,
        CAST(NULL AS DOUBLE) AS return_index, return_pct + 0.0 AS change_pts, return_pct + 0.0 AS change_pct FROM panel WHERE CAST(stock_code AS INTEGER) % 9 <> 4""",
    "dedupe_latest": f"""SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE (l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax),
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS rn FROM lineitem) WHERE rn = 1""",
    "dedupe_first": """SELECT s_suppkey AS code, s_name AS name, 'A' AS category FROM supplier UNION ALL
        SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
    "upserted": f"""{_MERGED} SELECT stock_code, date, CASE WHEN date < DATE '1998-01-01' THEN amp_pct END AS amp_pct,
        CASE WHEN date >= DATE '1997-07-01' THEN volume + 1 ELSE volume END AS volume FROM p""",
    "inserted_new": f"{_MERGED} SELECT stock_code, date, amp_pct, CASE WHEN date >= DATE '1998-01-01' THEN volume + 1 ELSE volume END AS volume FROM p",
    "snapshot_restored": f"{_MERGED} SELECT * FROM p WHERE date < DATE '1998-01-01'",
    "load_report": f"{_MERGED} SELECT count(*) AS total, count(*) FILTER (date >= DATE '1998-01-01') AS added, min(date) AS min_date, max(date) AS max_date FROM p",
    "incremental_twice": f"""{_MERGED}, e AS (SELECT max(date) AS last FROM p) SELECT stock_code, date, amp_pct,
        CASE WHEN date >= last - 7 THEN volume + 1 ELSE volume END AS volume FROM p, e""",
    "streamed": f"{_MERGED} SELECT stock_code, date, amp_pct, CASE WHEN date >= DATE '1997-07-01' THEN volume + 1 ELSE volume END AS volume FROM p",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("orders", "lineitem", "events", "supplier")),
    "legacy_names": f"{_MERGED} SELECT stock_code, date, volume FROM p",
    "vendor_skipped": f"""WITH {v.PANEL} SELECT stock_code AS name, CAST(year(date) AS VARCHAR) AS detail, count(*) AS cnt FROM panel WHERE year(date) IN (1993, 1994, 1995, 1998) GROUP BY ALL
        UNION ALL VALUES ('headless', 'no header', 1), ('torn', 'damaged compression', 1)""",
    "vendor_files": f"""WITH {v.PANEL} SELECT stock_code, '名稱' AS name, date, amp_pct, CASE WHEN date < DATE '1998-01-01' THEN return_pct + 0.0 END AS return_pct,
        CASE WHEN date >= DATE '1998-01-01' THEN volume END AS volume FROM panel""",
    "fx_files": f"WITH {v.FX} SELECT currency, date, close, 1000.5::DOUBLE AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, 0.03::DOUBLE AS change_pct FROM fx",
    "upserted_columns": f"""{_MERGED} SELECT stock_code, date, CASE WHEN date < DATE '1998-01-01' THEN amp_pct END AS amp_pct,
        CASE WHEN date >= DATE '1998-07-01' THEN volume + 1 WHEN date < DATE '1998-01-01' THEN volume END AS volume,
        CASE WHEN date >= DATE '1997-07-01' AND date < DATE '1999-01-01' THEN 'new' END AS note FROM p""",
    "fx_mixed_headers": f"""WITH {v.FX} SELECT currency, date, CASE WHEN dayofyear(date) % 17 = 0 THEN close ELSE close + 1 END AS close, CAST(NULL AS VARCHAR) AS reason FROM fx
        UNION ALL SELECT NULL, date, close + 1, 'key' FROM fx WHERE dayofyear(date) % 17 = 0""",
    "ordered_export": f"{_MERGED} SELECT *, row_number() OVER (ORDER BY date, stock_code) AS row FROM p",
    "written_lists": f"""WITH {_LISTED}, base AS (SELECT code, name, isin, CAST(code AS INTEGER) AS c FROM listed),
        merged AS (SELECT *, CASE WHEN c % 2 = 0 THEN name ELSE name || '-later' END AS first_name FROM base),
        lists AS (SELECT 'stocks' AS list, code, first_name AS name, NULL AS isin FROM merged WHERE c % 5 <> 0 UNION ALL SELECT 'etf', code, first_name, isin FROM merged WHERE c % 5 = 0
          UNION ALL SELECT 'emerging', code, name, NULL FROM base UNION ALL SELECT 'funds', code, name || '-later', isin FROM base UNION ALL SELECT 'indices', code, name, isin FROM base WHERE c % 3 = 0)
        SELECT list, row_number() OVER (PARTITION BY list ORDER BY code) AS row, code, name, isin FROM lists""",
    "streamed_late": f"""{_MERGED} SELECT stock_code, date, volume + CASE WHEN date >= DATE '1998-01-01' THEN 4 WHEN date < DATE '1996-01-01' THEN 3 WHEN date < DATE '1997-01-01' THEN 2 ELSE 1 END AS volume FROM p""",
    "loaded_table": f"""SELECT security_code, security_name, month, CASE WHEN month >= DATE '1995-06-01' THEN revenue_ntd_thousand + 1 ELSE revenue_ntd_thousand END AS revenue_ntd_thousand,
        true AS stamped FROM ({REVENUE})""",
    "csv_export": f"{_MERGED} SELECT * FROM p",
    "json_export": f"{BREADTH} SELECT strftime(date, '%Y-%m-%d') AS date, {_r6sql('amp_big_pct', 'mkt_hi90', 'mkt_lo10')} FROM breadth",
    "cached_panel": f"WITH {v.PANEL} SELECT * FROM panel",
    "listing_rows": f"WITH {_LISTED} SELECT * FROM listed",
    "listed_selection": f"WITH {_LISTED} SELECT code, CASE WHEN CAST(code AS INTEGER) % 2 = 0 THEN name ELSE name || '-later' END AS name, isin, market FROM listed WHERE category = 'NATION_3'",
    "sector_lists": "SELECT s_suppkey // 50 AS page_id, CAST(s_suppkey % 6 + 1 AS INTEGER) AS group_id, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS index_id, s_name AS name FROM supplier",
    "page_links": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)<li><a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hrefs,
        regexp_extract_all(html, '(?i)<li><a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS names FROM pages)
        SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href, trim(names[i]) AS name FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM h)""",
    "cross_rates": f"""WITH {v.FX}, b AS (SELECT date, close AS bridge_close FROM fx WHERE currency = 'NATION_3')
        SELECT currency, date, {_r6sql('bridge_close', 'close')}, round(bridge_close / nullif(close, 0), 4) AS foreign_per_bridge,
        round(close / nullif(bridge_close, 0), 4) AS bridge_per_foreign FROM fx JOIN b USING (date) WHERE currency <> 'NATION_3'""",
    "fx_filled": f"WITH {v.FX} SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY currency ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close_filled FROM fx",
    "fx_summary": f"WITH {v.FX} SELECT currency, count(*) AS total, min(date) AS min_date, max(date) AS max_date, count(*) - count(close) AS missing FROM fx GROUP BY currency",
    "fx_table_summary": f"WITH {v.FX} SELECT count(DISTINCT currency) AS keys, count(*) AS total, min(date) AS min_date, max(date) AS max_date, count(*) - count(close) AS missing FROM fx",
    "fx_expected": f"""WITH {v.FX}, e(value) AS (VALUES ('NATION_0'), ('NATION_7'), ('NATION_99'), ('XXX'))
        SELECT DISTINCT currency AS value, 'unexpected' AS problem FROM fx WHERE currency NOT IN (SELECT value FROM e)
        UNION ALL SELECT value, 'missing' FROM e WHERE value NOT IN (SELECT currency FROM fx)""",
    "fx_latest_rows": f"WITH {v.FX} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY date DESC) AS rn FROM fx) WHERE rn <= 3",
    "series_tail": f"WITH {v.PANEL} SELECT stock_code, date, volume FROM panel WHERE stock_code = '1001' ORDER BY date DESC LIMIT 10",
    "last_day_rows": f"WITH {v.PANEL} SELECT stock_code, date, volume FROM panel WHERE date = (SELECT max(date) FROM panel)",
    "master_join": f"""WITH {v.SECURITIES}, {_MASTER} SELECT security_code, ticker, {_MARKET_OF}, sum(l_quantity) AS volume FROM lineitem JOIN securities ON l_suppkey = s_suppkey
        JOIN master USING (security_code) WHERE ticker LIKE '10%' GROUP BY ALL""",
    "stock_and_market_rows": f"""WITH {v.PANEL}, {v.INDEX_ROWS}, d AS (SELECT stock_code, volume FROM panel UNION ALL SELECT stock_code, NULL FROM index_rows)
        SELECT CASE WHEN regexp_matches(stock_code, '^[0-9]{{4}}') THEN 'stock' WHEN stock_code = 'Y9999' THEN 'market' ELSE 'index' END AS kind, count(*) AS cnt, count(volume) AS with_volume FROM d GROUP BY 1""",
}
