"""Queries against SQL on the smallest tables. ``CHECK_ALL=1`` runs every query, else one of each kind."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from checks.compare import connect, differences

SF = "/root/testdata/sf0.001"
SOME = ("event_table", "study_drawdown", "return_stats", "market_breadth", "momentum", "dedupe_latest", "upserted", "vendor_files", "listing_rows", "fx_filled")
NAMES = list(driver.oracle_sql()) if os.environ.get("CHECK_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    assert differences(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) == []


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == ["stock_code", "ymd", "attention_a", "disposition_d", "full_delivery_y", "amp_big", "amp_sml"]


def test_all_rows_and_both_kinds(spark, con):
    from checks import study

    every, big = study.study_curves_all(spark, SF), study.study_curves(spark, SF)
    assert differences(every, con, study.SQL["study_curves_all"]) == []
    assert every.count() > big.count() and big.exceptAll(every).isEmpty()
    rows = study.materialize(study.events(spark, SF, "market_cap", "beta"), "events")
    logit = study.rp.persistence_logit(rows)
    for kind in ("big", "sml"):
        assert sorted(logit.filter(f"kind = '{kind}'").drop("kind").collect()) == sorted(study.rp.persistence_logit(rows, kind).collect())
    assert {r.kind for r in logit.collect()} == {"big", "sml"}


def test_vendor_skipped_keeps_codes_of_any_length(spark, tmp_path):
    from datetime import datetime

    day = {i: datetime(1993 + i % 6, 3, 1) for i in range(12)}
    lines = [(i, i, 500 + (i % 2) * 9000 + i // 6 * 10, 1, 5.0, 1000.0 + i, 0.05, 0.02, "A", "F", day[i]) for i in day]
    spark.createDataFrame(lines, spark.read.parquet(f"{SF}/lineitem.parquet").schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(k, f"s{k}", 1, 10.0) for k in sorted({r[2] for r in lines})]
    spark.createDataFrame(suppliers, spark.read.parquet(f"{SF}/supplier.parquet").schema).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    small = duckdb.connect()
    for t in ("lineitem", "supplier"):
        small.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = driver.queries()["vendor_skipped"](spark, str(tmp_path))
    assert differences(got, small, driver.oracle_sql()["vendor_skipped"]) == []
    assert {"10500", "10510"} & {r.name for r in got.select("name").collect()}


@pytest.mark.parametrize("name", ["streamed_late", "vendor_files"])
def test_files_are_written_by_all_tasks(spark, monkeypatch, name):
    from pyspark.sql import DataFrame

    asked = []
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: asked.append(n) or self)
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda self, n: asked.append(n) or self)
    driver.queries()[name](spark, SF)
    assert asked == []


def test_vendor_skipped_writes_only_skipped_kinds_in_one_task(spark, con, monkeypatch):
    asked, kind = [], type(spark.range(1))
    keep = kind.coalesce
    monkeypatch.setattr(kind, "coalesce", lambda self, n: asked.append(n) or keep(self, n))
    got = driver.queries()["vendor_skipped"](spark, SF)
    assert asked == [1, 1]
    assert differences(got, con, driver.oracle_sql()["vendor_skipped"]) == []


def test_vendor_skipped_with_rows_of_one_kind_only(spark, tmp_path):
    from datetime import datetime

    lines = [(i, i, 5, 1, 5.0, 1000.0 + i, 0.05, 0.02, "A", "F", datetime(1998, 3, 1 + i)) for i in range(9)]
    spark.createDataFrame(lines, spark.read.parquet(f"{SF}/lineitem.parquet").schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "s", 1, 10.0)], spark.read.parquet(f"{SF}/supplier.parquet").schema).write.parquet(f"{tmp_path}/supplier.parquet")
    got = driver.queries()["vendor_skipped"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("1005", "1998", 9), ("torn", "damaged compression", 1)]  # an empty file is passed over
