from datetime import date

import pytest
from pyspark.sql import functions as F

from finpanel import functions as fn


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_numbers(spark):
    texts = ["1,234.5", " 12 ", "-3", "+4", ".5", "1e3", "--", "－", "-", "N/A", "NA", "NaN", "inf", "-inf", "", "abc", None, "1d", "1e999"]
    assert one(spark, texts, fn.clean_number) == [1234.5, 12.0, -3.0, 4.0, 0.5, 1000.0] + [None] * 13


def test_percent(spark):
    assert one(spark, ["+0.03%", "-0.03%", "1.5", "", "--", None], fn.clean_percent) == [0.03, -0.03, 1.5, None, None, None]


def test_number_with_plus_dropped(spark):
    assert one(spark, ["+1,000.5", "None"], lambda c: fn.clean_number(c, drop="[,+]")) == [1000.5, None]


@pytest.mark.parametrize(
    ("parse", "texts", "want"),
    [
        (fn.parse_day, [" 20240229", "20240230", "2024022", "abcdefgh", None], [date(2024, 2, 29)] + [None] * 4),
        (fn.parse_month_end, ["202602", "202402", "202613", "20261"], [date(2026, 2, 28), date(2024, 2, 29), None, None]),
        (fn.parse_slash_day, ["2024/01/02", "2024-1-2", "2024/13/01", "20240102"], [date(2024, 1, 2)] * 2 + [None] * 2),
        (fn.parse_month_start, ["2024-01", "2024/1", "2024/00", "2024", "nan", "2024/01/01"], [date(2024, 1, 1)] * 2 + [None] * 4),
        (fn.parse_iso_day, ["2024-05-06", "2024/05/06"], [date(2024, 5, 6), None]),
    ],
)
def test_dates(spark, parse, texts, want):
    assert one(spark, texts, parse) == want


def test_day_to_int(spark):
    assert one(spark, ["2024-05-06"], lambda c: fn.day_to_int(c.cast("date"))) == [20240506]


def test_codes(spark):
    texts = ["2330 台積電", " 2330  x ", "5 digits", "00631 ETF", "Y9999", None]
    assert one(spark, texts, fn.code_of) == ["2330", "2330", "5", "00631", "Y9999", None]
    assert one(spark, texts[:1] + ["2330"], fn.name_of) == ["台積電", ""]
    assert one(spark, ["2330", "00631", "Y9999", "12"], fn.market_of) == ["TSE", "OTC", "INDEX", "INDEX"]


def test_keys_and_flags(spark):
    assert one(spark, [" a ", "nan", "None", "", None], fn.text_key) == ["a", None, None, None, None]
    assert one(spark, [" x", " ", None], fn.text_or_null) == ["x", None, None]
    assert one(spark, [" A ", "D", "", None], lambda c: fn.flag(c, "A")) == [1, 0, 0, 0]
    assert one(spark, [" usd "], fn.currency_code) == ["USD"]


def test_ratios(spark):
    df = spark.createDataFrame([(2.0,), (0.5,), (0.0,), (-4.0,), (None,)], "x double")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(fn.book_to_market(F.col("x"), positive_only=True)) == [0.5, 2.0, None, None, None]
    assert get(fn.book_to_market(F.col("x"), positive_only=False)) == [0.5, 2.0, None, -0.25, None]
    assert get(fn.earnings_yield(F.col("x"), positive_only=True)) == [0.5, 1.0, None, None, None]
    assert get(fn.earnings_yield(F.col("x"), positive_only=False)) == [0.5, 1.0, None, -0.25, None]
    assert get(fn.missing_if_zero(F.col("x"))) == [2.0, 0.5, None, -4.0, None]
    assert get(fn.event_strength(F.lit(3.0), F.col("x"), side="big"))[:3] == [0.5, 5.0, None]
    assert get(fn.event_strength(F.lit(1.0), F.col("x"), side="small"))[:2] == [0.5, -1.0]
    assert get(fn.capped_size_log(F.col("x")))[2:] == [0.0, 0.0, 0.0]


def test_excess_and_stars(spark):
    df = spark.createDataFrame([(0.1, 0.05, 0.0005), (0.1, -1.0, 0.04), (-1.0, 0.0, None)], "s double, m double, p double")
    got = df.select(fn.excess_of(F.col("s"), F.col("m")), fn.stars(F.col("p"))).collect()
    assert got[0][0] == pytest.approx(1.1 / 1.05 - 1)
    assert [r[0] for r in got[1:]] == [None, -1.0]
    assert [r[1] for r in got] == ["***", "*", None]


def test_json_number(spark):
    texts = ['{"k": 5, "ROE(A)－稅後": "7.5"}', '{"k": "x"}', "broken", None]
    assert one(spark, texts, lambda c: fn.json_number(c, "k")) == [5.0, None, None, None]
    assert one(spark, texts[:1], lambda c: fn.json_number(c, "ROE(A)－稅後")) == [7.5]


def test_plain_characters_are_taken_out_without_a_pattern(spark):
    texts = ["1,234.5", "[1]", "+1,0", "a,b", None, ","]
    assert one(spark, texts, fn.clean_number) == [1234.5, None, 10.0, None, None, None]
    assert one(spark, ["[1]", "1%", "1a2"], lambda c: fn.clean_number(c, drop="[a-b]")) == [None, None, 12.0]
    df = spark.range(1).select(fn.clean_number(F.col("id").cast("string")))
    assert "regexp_replace" not in df._jdf.queryExecution().analyzed().toString()
