import bz2
import datetime as dt
import gzip
from datetime import date

import pytest
from pyspark.sql import functions as F

from finpanel import schemas
from finpanel.session import materialize, scratch_path, scratch_scope, shared_folder
from finpanel.sources import listing, loads, sinks, tables, vendor
from finpanel.streaming import stream_upsert

KEY = "證券代碼"


def put(folder, name, text, encoding):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder / name)


def test_vendor_files(spark, tmp_path):
    folder = tmp_path / "日資料" / "price data"  # blanks and non-ASCII names are normal here
    head = f"{KEY}\t年月日\t 高低價差% \t注意股票(A)\t多的\r\n"
    put(folder, "a1.csv", head + "2330 台積電\t20240102\t1,234.5\tA\tx\r\n 1101 台泥 \t20240102\t--\t\ty\r\n", "utf-16")
    put(folder, "a2.csv", f"年月日\t{KEY}\t報酬率％\t高低價差%\n20240102\t2330 台積電\t1.5\t9\n20240103\t2330 台積電\t\"2\"\t8\n", "utf-16")
    put(folder, "b.csv", head + "Y9999 加權指數\t20240102\t3\t\t\nnan\t20240102\t1\t\t\n1102 x\t2024\t1\t\t\n", "utf-16-le")
    bad = put(folder, "broken.csv", "no such header\tx\n1\t2\n", "utf-8")
    raw, skipped = vendor.read_vendor(spark, f"{folder}/*.csv", key=KEY, columns=list(schemas.PRICE_COLUMNS))
    assert [r["path"].endswith("broken.csv") for r in skipped.collect()] == [True] and bad
    assert "多的" not in raw.columns and raw.count() == 7
    good, rejects = loads.daily_table(raw, schemas.PRICE_COLUMNS, text=schemas.PRICE_TEXT)
    rows = {(r["security_code"], r["date"]): r for r in good.collect()}
    assert set(rows) == {("2330 台積電", date(2024, 1, 2)), ("2330 台積電", date(2024, 1, 3)), ("1101 台泥", date(2024, 1, 2)), ("Y9999 加權指數", date(2024, 1, 2))}
    later = rows[("2330 台積電", date(2024, 1, 2))]  # the later file wins as a whole row
    assert (later["hl_spread_pct"], later["return_pct"], later["alert_a"]) == (9.0, 1.5, None)
    assert rows[("1101 台泥", date(2024, 1, 2))]["hl_spread_pct"] is None
    assert rows[("2330 台積電", date(2024, 1, 3))]["return_pct"] == 2.0
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["date", "key"]
    panel = loads.research_panel(good).where(F.col("stock_code") == "Y9999").first()
    assert (panel["name"], panel["amp_pct"]) == ("加權指數", 3.0)


def test_vendor_file_is_loaded_whole_or_not_at_all(spark, tmp_path):
    text = f"{KEY}\t年月日\t高低價差%\n" + "".join(f"{i} x{i * 7919 % 1000}\t20240102\t{i}\n" for i in range(20_000))
    (tmp_path / "good.csv.gz").write_bytes(gzip.compress(text.encode("utf-16")))
    whole = gzip.compress(text.replace(" x", " y").encode("utf-16"))
    (tmp_path / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    raw, skipped = vendor.read_vendor(spark, str(tmp_path), key=KEY)
    assert raw.count() == 20_000 and raw.where(F.col(KEY).contains(" y")).isEmpty()
    assert [r["path"].rsplit("/", 1)[-1] for r in skipped.collect()] == ["cut.csv.gz"]


def test_vendor_files_split_at_line_ends(spark, tmp_path):
    """One plain file is read by many tasks, in both byte orders, with line feeds alone or after carriage returns."""
    lines = [f"{i} 名{i}\t20240102\t\"{i}\"" for i in range(5000)]
    for name, mark, encoding, end in (("le", "\ufeff", "utf-16-le", "\r\n"), ("be", "\ufeff", "utf-16-be", "\n"), ("bare", "", "utf-16-le", "\n")):
        (tmp_path / f"{name}.csv").write_bytes((mark + end.join([f"{KEY}\t年月日\t高低價差%", *lines])).encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        raw, skipped = vendor.read_vendor(spark, str(tmp_path / "*.csv"), key=KEY)
        heads = [vendor._head(spark, str(tmp_path / "le.csv"), [KEY], "\t", ["UTF-16", "UTF-16LE"])]
        scan = vendor._scan(spark, heads[0].names, [heads[0].path], "\t", heads[0].encoding, KEY, None)
        assert scan.rdd.getNumPartitions() > 20
        assert skipped.isEmpty() and raw.groupBy("_src").count().select("count").distinct().collect() == [(5000,)]
        assert raw.agg(F.sum(F.col("高低價差%").cast("long"))).first()[0] == 3 * sum(range(5000))
        assert raw.where(F.col(KEY) != F.concat(F.col("高低價差%"), F.lit(" 名"), F.col("高低價差%"))).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bytes_that_only_look_like_line_ends(spark, tmp_path):
    """U+0A31 before U+4E00 holds the bytes of a line feed across two characters: the file is read again, whole."""
    odd = f"{KEY}\t年月日\n1 x\u0a31\u4e00y\t20240102\n2 z\t20240103\n"
    (tmp_path / "odd.csv").write_bytes(b"\xff\xfe" + odd.encode("utf-16-le"))
    (tmp_path / "fine.csv").write_bytes(b"\xff\xfe" + f"{KEY}\t年月日\n3 z\t20240103\n".encode("utf-16-le"))
    raw, skipped = vendor.read_vendor(spark, str(tmp_path), key=KEY)
    assert sorted(r[KEY] for r in raw.collect()) == ["1 x\u0a31\u4e00y", "2 z", "3 z"] and skipped.isEmpty()


def test_broken_files_have_reasons(spark, tmp_path):
    good = f"{KEY}\t年月日\n1 x\t20240102\n".encode("utf-16-le")
    files = {
        "good.csv": b"\xff\xfe" + good, "half.csv": b"\xff\xfe" + good + b"\x00\xd8\x41\x00\x0a\x00", "not.csv.gz": good, "cut.csv.gz": gzip.compress(good * 500)[:-20],
        "noheader.csv": b"abc", "fine.csv.gz": gzip.compress(b"\xff\xfe" + good),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    raw, skipped = vendor.read_vendor(spark, str(tmp_path), key=KEY)
    assert sorted(r["_src"] for r in raw.collect()) == ["fine.csv.gz", "good.csv"]
    reasons = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in skipped.collect()}
    assert set(reasons) == set(files) - {"good.csv", "fine.csv.gz"}
    assert reasons["half.csv"] == "not in its encoding" and reasons["cut.csv.gz"] == "cut off" and reasons["noheader.csv"] == "no header"


def test_odd_and_compressed_files_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    """Text with U+FFFD in it and compressed text: no task reads a whole file, unless a piece of it can't be understood without the others."""
    lines = [f"{i} \ufffd名{i}\t20240102\t\"{i}\"" for i in range(600)]
    for name, mark, encoding, end in (("le", "\ufeff", "utf-16-le", "\r\n"), ("bare", "", "utf-16-le", "\n"), ("be", "\ufeff", "utf-16-be", "\n")):
        content = (mark + end.join([f"{KEY}\t年月日\t高低價差%", *lines])).encode(encoding)
        (tmp_path / f"{name}.csv").write_bytes(content)
        (tmp_path / f"{name}.csv.gz").write_bytes(gzip.compress(content))
        (tmp_path / f"{name}.csv.bz2").write_bytes(bz2.compress(content + "\n".encode(encoding)))
    monkeypatch.setattr(vendor, "_strict", lambda *_: pytest.fail("a file is read as a whole"))
    monkeypatch.setattr(vendor, "PIECE_BYTES", 500, raising=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "12001")
    try:
        raw, skipped = vendor.read_vendor(spark, str(tmp_path), key=KEY)
        rows = raw.collect()
        odd = vendor._read_pieces(spark, [vendor._head(spark, str(tmp_path / "le.csv"), [KEY], "\t", ["UTF-16"])], "\t")
        assert odd.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert skipped.isEmpty() and len({r["_src"] for r in rows}) == 9
    for name in {r["_src"] for r in rows}:
        assert sorted((int(r["高低價差%"]), r[KEY], r["年月日"]) for r in rows if r["_src"] == name) == [(i, f"{i} \ufffd名{i}", "20240102") for i in range(600)]


def test_names_with_percent_signs_and_odd_text(spark, tmp_path):
    names = ["a%41.csv", "aA.csv", "a%2541.csv", "b%41.csv.gz", "bA.csv.gz", "c 名%20.csv"]
    for name in names:
        content = f"{KEY}\t年月日\n{name} \ufffd\t20240102\n".encode("utf-16")
        (tmp_path / name).write_bytes(gzip.compress(content) if name.endswith(".gz") else content)
    raw, skipped = vendor.read_vendor(spark, str(tmp_path), key=KEY)
    assert skipped.isEmpty() and sorted(r[KEY] for r in raw.collect()) == sorted(f"{n} \ufffd" for n in names)


@pytest.mark.parametrize("piece", [1, 40])
def test_pieces_give_what_whole_files_give(spark, tmp_path, monkeypatch, piece):
    top = f"{KEY}\t年月日"
    texts = {
        "plain": f"{top}\r\n1 x\t20240102\r\n\r\n2 y\t20240103", "runs_on": f"{top}\n1 x\t\"a\nb\"\n2 y\t\"c\rd\"\n", "never_closed": f"{top}\n1 x\t\"a\n2 y\tb\n",
        "last_open": f"{top}\n1 x\ta\n2 y\t\"b", "inside": f"{top}\n1 \"x\"\ta\"b\n\"2 \"\"y\"\"\"z\tc\n", "returns": f"{top}\r1 x\ta\n2 y\tb\r3 z\tc\n", "blank": f"{top}\n\n1 x\n\t\t\t\n\n",
        "alike": f"{top}\n1 x\u0a31\u4e00y\t\u6100\n\u0a00\u000a\u0a0a\u000a2 z\u0100\t\u010a\u000a", "long": f"{top}\n1 {'x' * 140_000}\ta\n",
    }
    for name, text in texts.items():
        for kind in ("utf-16-le", "utf-16-be"):
            content = ("\ufeff" + text).encode(kind)
            pair, packed = content + "\ud800".encode(kind, "surrogatepass") + "\n".encode(kind), gzip.compress(content)
            for end, data in (("csv", content), ("csv.gz", packed), ("csv.bz2", bz2.compress(content)), ("cut.csv.gz", packed[:-9]), ("half.csv", content + b"\xd8"), ("pair.csv.gz", gzip.compress(pair))):
                (tmp_path / f"{name}.{kind}.{end}").write_bytes(data)
        (tmp_path / f"{name}.utf-8.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    listed = [r["path"] for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()]
    heads = [vendor._head(spark, p, [KEY], "\t", ["UTF-16", "UTF-8"]) for p in listed]
    assert len(heads) == len(texts) * 13 and not any(h.reason for h in heads)
    monkeypatch.setattr(vendor, "PIECE_BYTES", piece)
    monkeypatch.setattr(vendor, "PARSED_BYTES", 7 * piece + 1000)

    def read():
        frames, broken = vendor._read_strictly(spark, heads, "\t", KEY, None)
        rows = vendor._united(frames).select(KEY, "年月日", "_src").collect()
        return sorted(map(str, rows)), broken

    pieces = read()
    monkeypatch.setattr(vendor, "_strict_pieces", lambda sep, files: lambda batches: (vendor._record((files.get(p) or files[vendor._plain_url(p)])[0], [None], "not by lines") for b in batches for p in set(b.column("path").to_pylist())))
    whole = read()
    assert pieces == whole and len(whole[1]) > 2 * len(texts) and len(whole[0]) > 10 * len(texts)


def test_comma_files_by_name(spark, tmp_path):
    put(tmp_path, "2024a.csv", "currency,date,close,open,high,low,change%\nusd,2024-01-02,9,1,1,1,1%\n ,2024-01-03,1,1,1,1,1%\n", "utf-8-sig")
    put(tmp_path, "2024b.csv", "date,close,currency,open,high,low,change%\n2024-01-02,1,usd,1,1,1,1%\n", "utf-8")
    good, bad = loads.fx_table(vendor.read_bom_csv(spark, str(tmp_path), required=list(schemas.FX_COLUMNS)))
    assert [(r["currency"], r["date"], r["close"]) for r in good.collect()] == [("USD", date(2024, 1, 2), 1.0)]
    assert [r["reject_reason"] for r in bad.collect()] == ["key"]


def test_tables_keep_all_columns(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["k", "date"]
    tables.upsert(spark, path, frame(spark, [("a", D[1], 1.0)], "k string, date date, x double"), key, day="date")
    tables.upsert(spark, path, frame(spark, [("b", D[1], 2.0, "n")], "k string, date date, x double, y string"), key, day="date")
    tables.upsert(spark, path, frame(spark, [("b", D[1], 3.0)], "k string, date date, x double"), key, day="date")
    assert sorted(tuple(r) for r in tables.load_table(spark, path).select("k", "x", "y").collect()) == [("a", 1.0, None), ("b", 3.0, "n")]
    with pytest.raises(ValueError, match="does not declare"):
        tables.upsert(spark, path, frame(spark, [("b", D[1], 3.0)], "k string, date date, z double"), key, day="date", schema="k string, date date, x double, y string")


def test_vendor_without_any_readable_file(spark, tmp_path):
    put(tmp_path, "x.csv", "a,b\n", "utf-8")
    with pytest.raises(ValueError, match="no readable file"):
        vendor.read_vendor(spark, str(tmp_path), key=KEY)


def test_bom_csv(spark, tmp_path):
    path = put(tmp_path, "fx.csv", "currency,date,close,open,high,low,change%\n usd ,2024-01-02,\"1,000.5\",--,,x,+0.03%\neur,2024-13-01,1,1,1,1,\n", "utf-8-sig")
    good, bad = loads.fx_table(vendor.read_bom_csv(spark, path, required=list(schemas.FX_COLUMNS)))
    assert [tuple(r) for r in good.collect()] == [("USD", date(2024, 1, 2), 1000.5, None, None, None, 0.03)]
    assert bad.count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        vendor.read_bom_csv(spark, path, required=["currency", "指數代碼"])


def test_index_and_revenue_tables(spark):
    raw = spark.createDataFrame([("T1", " ", "2024/1/2", "+1,000.55555", "--", "+1", "0.5"), ("", "x", "2024-01-02", "1", "1", "1", "1")], list(schemas.INDEX_HISTORY_COLUMNS))
    good, bad = loads.index_history_table(raw)
    row = good.first()
    assert (row["index_code"], row["index_name"], float(row["price_index"]), row["return_index"]) == ("T1", None, 1000.5556, None)
    assert dict(good.dtypes)["change_pct"] == "decimal(10,4)" and bad.count() == 1
    raw = spark.createDataFrame([("1", "", "2024/02", "1,234"), ("2", "n", "2024/02", "--"), ("3", "n", "x", "1")], list(schemas.REVENUE_COLUMNS))
    good, bad = loads.revenue_table(raw)
    assert [tuple(r) for r in good.collect()] == [("1", None, date(2024, 2, 1), 1234)]
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["date", "revenue"]


def test_chip_director_quarterly_deposit(spark):
    raw = spark.createDataFrame([("2330 x", "20240102", "1,000", "5", "-", "9"), ("1101", "20240102", None, "-", "", "9")], [KEY, "年月日", "外資買賣超(張)", "甲", "乙", "當日收盤"])
    got = {r["security_code"]: (r["fi_net_buy_lot"], r["extras"]) for r in loads.chip_table(raw)[0].collect()}
    assert got == {"2330 x": (1000.0, {"甲": 5.0}), "1101": (None, None)}
    raw = spark.createDataFrame([("1101 a", "202402", "10", "1.5", "x")], list(schemas.DIRECTOR_COLUMNS))
    assert [tuple(r) for r in loads.director_table(raw)[0].collect()] == [("1101 a", date(2024, 2, 29), 10.0, 1.5, None)]
    raw = spark.createDataFrame([("1101", "202403", "1.5", "NA"), ("1102", "202403", "-", ""), ("None", "202403", "1", "1")], [KEY, "年月", "每股盈餘", "負債比率"])
    good, bad = loads.quarterly_table(raw)
    kpi = {r["security_code"]: (r["eps"], r["debt_ratio"]) for r in vendor.kpi_view(good, schemas.QUARTERLY_KPI).collect()}
    assert kpi == {"1101": (1.5, None), "1102": (None, None)} and bad.count() == 1
    raw = spark.createDataFrame([("b", "20240102", "1.5"), ("b", "x", "1")], list(schemas.DEPOSIT_COLUMNS))
    assert [tuple(r) for r in loads.deposit_rates(raw).collect()] == [("b", date(2024, 1, 2), 1.5)]


def frame(spark, rows, cols="k string, date date, v double, w double"):
    return spark.createDataFrame(rows, cols)


D = [date(2023, 12, 30), date(2024, 1, 1), date(2024, 1, 5), date(2025, 3, 1)]


def dump(spark, path):
    return sorted(tuple(r) for r in tables.load_table(spark, path).select("k", "date", "v", "w").collect())


def test_upsert(spark):
    path = scratch_path(spark, "t")
    old = [("a", D[0], 1.0, 10.0), ("a", D[1], 2.0, 20.0), ("b", D[3], 3.0, 30.0)]
    tables.upsert(spark, path, frame(spark, old), ["k", "date"], day="date")
    assert dump(spark, path) == old
    batch = frame(spark, [("a", D[1], 5.0), ("c", D[2], 6.0), ("c", D[2], 4.0)], "k string, date date, v double")
    for _ in range(2):  # once more changes nothing
        tables.upsert(spark, path, batch, ["k", "date"], day="date", recency=["v"])
        assert dump(spark, path) == [("a", D[0], 1.0, 10.0), ("a", D[1], 5.0, 20.0), ("b", D[3], 3.0, 30.0), ("c", D[2], 6.0, None)]


def test_upsert_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(spark, path, frame(spark, [("a", d, 1.0, 1.0) for d in D]), ["k", "date"], day="date")
    before = tables.version_of(spark, path)
    tables.upsert(spark, path, frame(spark, [("a", D[1], 9.0, 9.0)]), ["k", "date"], day="date")
    after = tables.version_of(spark, path)
    assert after.number == before.number + 1 and {m for m in after.parts if after.parts[m] != before.parts[m]} == {"202401"}
    assert dump(spark, path)[1] == ("a", D[1], 9.0, 9.0) and len(dump(spark, path)) == 4


def test_insert_snapshot_restore_report(spark, tmp_path):
    path = str(tmp_path / "prices")
    assert tables.snapshot(spark, path, str(tmp_path / "backup")) is None
    tables.insert_new(spark, path, frame(spark, [("a", D[1], 1.0, 1.0)]), ["k", "date"], day="date")
    tables.insert_new(spark, path, frame(spark, [("a", D[1], 9.0, 9.0), ("b", D[2], 2.0, 2.0)]), ["k", "date"], day="date")
    kept = [("a", D[1], 1.0, 1.0), ("b", D[2], 2.0, 2.0)]
    assert dump(spark, path) == kept
    copy = tables.snapshot(spark, path, str(tmp_path / "backup"), at=dt.datetime(2024, 5, 6, 7, 8, 9))
    assert copy.endswith("backup/prices_20240506_070809")
    tables.upsert(spark, path, frame(spark, [("z", D[3], 0.0, 0.0)]), ["k", "date"], day="date")
    report = tables.load_report(tables.load_table(spark, path), "date", before=2).first()
    assert tuple(report) == (3, 1, D[1], D[3])
    tables.restore(spark, copy, path)
    assert dump(spark, path) == kept


def test_master_and_whole_load(spark, tmp_path):
    path, master = str(tmp_path / "t"), str(tmp_path / "m")
    rows = frame(spark, [("2330 台積電", D[1], 1.0), ("00631 ETF", D[1], 1.0)], "security_code string, date date, v double")
    report = loads.load_into(spark, path, rows, ["security_code", "date"], day="date", backup=str(tmp_path / "b"), master=master, stamp="updated_at").first()
    assert (report["total"], report["added"]) == (2, 2)
    loads.load_into(spark, path, rows, ["security_code", "date"], day="date", master=master)
    got = sorted(tuple(r) for r in tables.load_table(spark, master).collect())
    assert got == [("00631 ETF", "00631", "ETF", "OTC"), ("2330 台積電", "2330", "台積電", "TSE")]
    assert tables.load_table(spark, path).where(F.col("updated_at").isNull()).isEmpty()


def test_incremental_lookback(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [date(2024, 3, 1) + dt.timedelta(i) for i in range(20)]
    tables.upsert(spark, path, frame(spark, [("a", d, 0.0, 0.0) for d in days[:15]]), ["k", "date"], day="date")
    batch = frame(spark, [("a", d, 1.0, 1.0) for d in days])
    for _ in range(2):
        tables.incremental_load(spark, path, batch, ["k", "date"], lookback_days=7)
        assert [r[2] for r in dump(spark, path)] == [0.0] * 12 + [1.0] * 8
    months = frame(spark, [("a", date(2024, m, 1), 1.0, 1.0) for m in range(1, 13)])
    assert tables.recent(months, "date", months=4).count() == 5


def test_stream_merges_each_file_once(spark, tmp_path):
    src, path, progress = (str(tmp_path / n) for n in ("in", "t", "p"))
    for value in (1.0, 2.0):
        frame(spark, [("a", D[1], value, value), (f"k{value}", D[2], value, value)]).write.mode("append").parquet(src)
        stream = spark.readStream.schema("k string, date date, v double, w double").parquet(src)
        stream_upsert(spark, stream, path, ["k", "date"], day="date", progress=progress).awaitTermination()
    assert dump(spark, path) == [("a", D[1], 2.0, 2.0), ("k1.0", D[2], 1.0, 1.0), ("k2.0", D[2], 2.0, 2.0)]


def test_sinks_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("b", D[1], None), ("a", D[2], 1.0)], "stock_code string, date date, x double")
    sinks.write_csv(df, str(tmp_path / "csv"), order=["date", "stock_code"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*.csv")))
    assert text.startswith("stock_code,date,x\n") and text.index("b,2024-01-01") < text.index("a,2024-01-05")
    sinks.write_json(df, str(tmp_path / "json"))
    assert '"x":null' in "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    cache = str(tmp_path / "panel")
    assert loads.cached_panel(spark, cache, lambda: df.limit(1)).count() == 1
    sinks.write_panel(df, cache)
    assert loads.cached_panel(spark, cache, lambda: df.limit(0)).count() == 2
    assert loads.cached_panel(spark, cache, lambda: df.limit(0), force_source=True).count() == 0


PAGE = """<table class=h4><tr><td>有價證券代號及名稱</td><td>ISIN</td></tr>
<tr><td bgcolor=#FAFAD2 colspan=7 ><B> 股票 <B> </td></tr>
<tr><td bgcolor=#FAFAD2>1101　台泥</td><td>TW0001101004</td><td>1962/02/09</td><td>上市</td><td>水泥工業</td></tr>
<tr><td>no space</td><td>x</td></tr>
<TR><td colspan=7><b>ETF</b></td></TR>
<tr><td>0050　元大　50</td><td>TW0000050004</td></tr></table>"""


def test_listing_rows(spark):
    pages = spark.createDataFrame([(1, bytearray(PAGE.encode("big5"))), (2, bytearray(b"<p>none</p>"))], "page_id int, content binary")
    got = [tuple(r) for r in listing.extract_table_rows(listing.decode_pages(pages)).orderBy("pos").drop("page_id", "pos").collect()]
    assert got == [("股票", "1101", "台泥", "TW0001101004", "1962/02/09", "上市", "水泥工業"), ("ETF", "0050", "元大　50", "TW0000050004", "", "", "")]


def test_lists(spark):
    page = '<ul class="x" id="group1"><li><a href="/index/^028/stocks" target="_blank" t="a,b">電零組</a></li><li><a href="/index/^555/stocks">ETN</a></li></ul>\n<ul id="group2"><li><a href="/index/^014/stocks">紡織</a></li></ul>'
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert sorted(tuple(r) for r in listing.extract_sectors(pages).collect()) == [(1, 1, "028", "電零組"), (1, 1, "555", "ETN"), (1, 2, "014", "紡織")]
    assert [r["name"] for r in listing.extract_list_items(pages).orderBy("pos").collect()] == ["電零組", "ETN", "紡織"]
    a = spark.createDataFrame([("股票", "2", "first"), ("ETF", "3", "etf")], "category string, code string, name string")
    b = spark.createDataFrame([("股票", "2", "later"), ("股票", "1", "only")], "category string, code string, name string")
    got = listing.list_columns(listing.select_category([a, b], "股票"), "stocks")
    assert [tuple(r) for r in got.collect()] == [("1", "only"), ("2", "first")] and got.columns == ["代號", "名稱"]


def test_written_lists(spark, tmp_path):
    cols = "category string, code string, name string, isin string, date string, market string"
    listed = spark.createDataFrame([("股票", "2", "b", "i2", "d", "m"), ("ETF", "9", "e", "i9", "d", "m"), ("股票", "1", "a", "i1", "d", "m")], cols)
    otc = spark.createDataFrame([("股票", "2", "later", "x", "d", "m"), ("股票", "3", "c", "i3", "d", "m")], cols)
    paths = listing.write_lists({"listed": listed, "otc": otc, "emerging": otc}, str(tmp_path / "lists"))
    assert set(paths) == {"stocks", "etf", "emerging"}
    back = sinks.read_ordered(spark, paths["stocks"], "code string, name string")
    assert [tuple(r) for r in back.orderBy("row").collect()] == [("1", "a", 1), ("2", "b", 2), ("3", "c", 3)]
    assert sinks.read_ordered(spark, paths["etf"], "code string, name string, isin string, date string, market string").first()["isin"] == "i9"


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
def test_order_of_many_files_and_splits(spark, tmp_path, format):
    df = spark.range(5000).selectExpr("cast((id * 7919) % 5000 AS string) AS a", "cast(id % 17 AS int) AS b")
    path = str(tmp_path / format)
    sinks.write_ordered(df.repartition(7), path, ["b"], format=format)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [(r["b"], r["a"]) for r in sinks.read_ordered(spark, path, "a string, b int", format=format).orderBy("row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((r["b"], r["a"]) for r in df.collect())


def test_ordered_files_are_read_once_and_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_ordered(spark.range(3000).selectExpr("id AS a").repartition(5), path, ["a"])
    back = sinks.read_ordered(spark, path, "a long")
    assert not [f for f in back.inputFiles() if path in f]  # the text itself is not parsed again
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "RegExp" not in plan and "regexp" not in plan
    assert [tuple(r) for r in back.orderBy("row").collect()] == [(i, i + 1) for i in range(3000)]


def test_legacy_names(spark):
    df = spark.createDataFrame([(1, 2)], "trade_date int, v int")
    assert vendor.rename_legacy(df, schemas.LEGACY_NAMES).columns == ["date", "v"]
    both = spark.createDataFrame([(1, 2)], "trade_date int, date int")
    assert vendor.rename_legacy(both, schemas.LEGACY_NAMES).columns == ["trade_date", "date"]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    out = materialize(spark.range(3), "x")
    assert out.count() == 3 and all(shared_folder(spark).split(":")[-1] in f for f in out.inputFiles())


def test_scratch_of_a_job_is_removed(spark):
    import os

    kept = materialize(spark.range(2), "outside")
    with scratch_scope(spark, "report") as folder:
        inner = materialize(spark.range(3), "inside")
        assert all(folder in f for f in inner.inputFiles()) and inner.count() == 3
    assert not os.path.exists(folder) and kept.count() == 2 and "report" not in scratch_path(spark, "x")


def test_bucketed_panel_needs_no_shuffle(spark, tmp_path):
    from finpanel.plans.events import amplitude_events

    rows = [(f"{c}", date(2024, 1, 1) + dt.timedelta(d), float(d % 7)) for c in range(5) for d in range(25)]
    df = spark.createDataFrame(rows, "stock_code string, date date, amp_pct double")
    sinks.save_bucketed(df, "bucketed_panel", buckets=3, path=str(tmp_path / "b"))
    stored = amplitude_events(spark.table("bucketed_panel"))
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in amplitude_events(df)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, amplitude_events(df).collect()))
    spark.sql("DROP TABLE bucketed_panel")


def test_upsert_reads_only_touched_months(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "t"), []
    tables.upsert(spark, path, frame(spark, [("a", d, 1.0, 1.0) for d in D]), ["k", "date"], day="date")
    real = tables._rows
    monkeypatch.setattr(tables, "_rows", lambda s, p, v, months=None: asked.append(months) or real(s, p, v, months))
    tables.upsert(spark, path, frame(spark, [("a", D[1], 9.0, 9.0)]), ["k", "date"], day="date")
    assert asked == [["202401"]]
    files = real(spark, path, tables.version_of(spark, path), ["202401"]).inputFiles()
    assert files and all("part_month=202401" in f for f in files)


def test_a_load_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    """Readers see the old rows until the pointer stands, also ones that began before; a broken pointer is passed over."""
    path = str(tmp_path / "t")
    old = [("a", D[1], 1.0, 1.0), ("b", D[3], 2.0, 2.0)]
    tables.upsert(spark, path, frame(spark, old), ["k", "date"], day="date")
    reader = tables.load_table(spark, path)
    batch = frame(spark, [("a", D[1], 7.0, 7.0), ("b", D[3], 8.0, 8.0), ("c", D[0], 9.0, 9.0)])
    with monkeypatch.context() as broken:
        broken.setattr(tables, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.upsert(spark, path, batch, ["k", "date"], day="date")
    assert dump(spark, path) == old
    (tmp_path / "t" / "_versions" / "000000000002.json").write_text('{"number": 2, "sch')
    assert dump(spark, path) == old
    tables.upsert(spark, path, batch, ["k", "date"], day="date")
    assert len(dump(spark, path)) == 3 and tables.version_of(spark, path).number == 3
    assert sorted(tuple(r) for r in reader.select("k", "date", "v", "w").collect()) == old


def test_of_two_loads_at_a_time_one_fails(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), tables._write
    tables.upsert(spark, path, frame(spark, [("a", D[1], 1.0, 1.0)]), ["k", "date"], day="date")

    def late(*args):
        monkeypatch.setattr(tables, "_write", real)
        tables.upsert(spark, path, frame(spark, [("b", D[1], 2.0, 2.0)]), ["k", "date"], day="date")  # the other load
        return real(*args)

    monkeypatch.setattr(tables, "_write", late)
    with pytest.raises(RuntimeError, match="was faster"):
        tables.upsert(spark, path, frame(spark, [("c", D[1], 3.0, 3.0)]), ["k", "date"], day="date")
    assert [r[0] for r in dump(spark, path)] == ["a", "b"]


def test_plain_parquet_becomes_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, [("a", D[1], 1.0, 1.0), ("b", D[3], 2.0, 2.0)]).write.parquet(path)
    tables.upsert(spark, path, frame(spark, [("a", D[1], 5.0, 5.0)]), ["k", "date"], day="date")
    assert dump(spark, path) == [("a", D[1], 5.0, 5.0), ("b", D[3], 2.0, 2.0)]


def test_stored_recency(spark, tmp_path):
    """Late batches change nothing that is newer; what decides is kept with the rows, out of sight."""
    path, how = str(tmp_path / "t"), dict(day="date", recency=["_src"], keep_recency=True)
    cols = "k string, date date, v double, w double, _src string"
    tables.upsert(spark, path, frame(spark, [("a", D[1], 2.0, 2.0, "f2"), ("a", D[1], 1.0, 1.0, "f1")], cols), ["k", "date"], **how)
    tables.upsert(spark, path, frame(spark, [("a", D[1], 0.0, 0.0, "f0"), ("b", D[1], 0.0, 0.0, "f0")], cols), ["k", "date"], **how)
    assert dump(spark, path) == [("a", D[1], 2.0, 2.0), ("b", D[1], 0.0, 0.0)]
    tables.upsert(spark, path, frame(spark, [("a", D[1], 3.0, 3.0, "f2"), ("b", D[1], 4.0, 4.0, "f4")], cols), ["k", "date"], **how)
    assert dump(spark, path) == [("a", D[1], 3.0, 3.0), ("b", D[1], 4.0, 4.0)]
    assert tables.load_table(spark, path).columns == ["k", "date", "v", "w"]


def test_stream_repeats_no_batch(spark, tmp_path):
    src, path, progress = (str(tmp_path / n) for n in ("in", "t", "p"))
    frame(spark, [("a", D[1], 1.0, 1.0)]).write.parquet(src)
    stream = spark.readStream.schema("k string, date date, v double, w double").parquet(src)
    stream_upsert(spark, stream, path, ["k", "date"], day="date", progress=progress).awaitTermination()
    first = tables.version_of(spark, path)
    assert first.merged == {progress: 0}
    tables.upsert(spark, path, frame(spark, [("a", D[1], 5.0, 5.0)]), ["k", "date"], day="date", merged={progress: 7})
    stream_upsert(spark, stream, path, ["k", "date"], day="date", progress=str(tmp_path / "p2")).awaitTermination()  # another stream
    assert tables.version_of(spark, path).merged == {progress: 7, str(tmp_path / "p2"): 0}
    frame(spark, [("a", D[1], 9.0, 9.0)]).write.mode("append").parquet(src)
    stream_upsert(spark, stream, path, ["k", "date"], day="date", progress=progress).awaitTermination()  # its batch 1 is held already
    assert dump(spark, path) == [("a", D[1], 1.0, 1.0)]


def test_declared_tables(spark, tmp_path):
    """Loads by table name: declared columns and types, whatever the files hold."""
    from pyspark.sql.types import StructType

    rows = frame(spark, [("2330 x", D[1], "A")], "security_code string, date date, alert_a string").withColumn("trade_count", F.lit(5))
    loads.load_into(spark, str(tmp_path / "p"), rows, table="stock_price", master=str(tmp_path / "m"))
    got = tables.load_table(spark, str(tmp_path / "p"))
    assert got.schema == StructType.fromDDL(schemas.TABLES["stock_price"][0]) and got.first()["trade_count"] == 5.0
    revenue = frame(spark, [("1", "n", D[1], 3)], "security_code string, security_name string, month date, revenue_ntd_thousand int")
    loads.load_into(spark, str(tmp_path / "r"), revenue, table="monthly_revenue")
    assert tables.load_table(spark, str(tmp_path / "r")).where("updated_at IS NULL").isEmpty()
    with pytest.raises(ValueError, match="does not declare"):
        loads.load_into(spark, str(tmp_path / "p"), rows.withColumn("other", F.lit(1)), table="stock_price")
    for ddl, keys, day in schemas.TABLES.values():
        assert {*keys, day} <= set(StructType.fromDDL(ddl).names)


class _Session:
    """Just enough of a session without ``spark.checkpoint.dir``."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_shared_folder_when_unset():
    local = _Session("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.folder
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Session("spark://host:7077"))
