import math
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finpanel.operators import keys as ks
from finpanel.operators import stats as ss
from finpanel.operators.quantiles import quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]


def check_quantiles(spark, groups, **how):
    rows = [(g, None if x is None else float(x)) for g, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double")
    names = [f"q{i}" for i in range(len(PROBS))]
    got = {r["g"]: r for r in quantiles(df, ["g"], "x", PROBS, names, **how).collect()}
    for g, xs in groups.items():
        have = [x for x in xs if x is not None]
        if not have:
            assert g not in got
            continue
        assert got[g]["n"] == len(have)
        assert [got[g][n] for n in names] == pytest.approx(list(np.quantile(have, PROBS)), rel=1e-12, abs=1e-9)


def test_quantiles_small_groups(spark):
    check_quantiles(spark, {"a": [3, 1, 2, None], "b": [5], "c": [1, 1, 1, 9], "d": [None], None: [1, 2]})


@pytest.mark.parametrize("shape", ["normal", "ties", "heavy", "sorted", "scales"])
def test_quantiles_through_rounds(spark, shape):
    """Many rounds: groups far larger than the number of sub-ranges, with one hot value."""
    rng = np.random.default_rng(7)
    xs = {
        "normal": rng.normal(size=20_000),
        "ties": rng.integers(0, 9, size=20_000).astype(float),
        "heavy": np.where(rng.random(20_000) < 0.34, 1.0, rng.pareto(0.7, 20_000)),
        "sorted": np.arange(20_000.0),
        "scales": np.concatenate([10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-3, 30, 1000))]),
    }[shape]
    check_quantiles(spark, {"big": xs.tolist(), "small": [1, 2, 3]}, ranges=32, most_held=50)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_quantiles_any_values(spark, xs):
    check_quantiles(spark, {"g": xs})


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    row = quantiles(df, [], "x", [0.8], ["cut"]).first()
    assert (row["n"], row["cut"]) == (101, 80.0)
    big = quantiles(df, [], "x", [0.8], ["cut"], ranges=3, most_held=4).first()
    assert big["cut"] == 80.0


def test_dedupe_latest_and_first(spark):
    df = spark.createDataFrame(
        [("a", "f1", 1, {"k": 1.0}), ("a", "f2", 2, None), ("a", "f2", 3, {"k": 2.0}), ("b", "f1", None, None)],
        "key string, src string, v int, extras map<string,double>",
    )
    last = {r["key"]: (r["src"], r["v"]) for r in ks.dedupe_latest(df, ["key"], ["src"]).collect()}
    first = {r["key"]: r["v"] for r in ks.dedupe_first(df, ["key"], ["src"]).collect()}
    assert last["b"] == ("f1", None) and last["a"][0] == "f2"
    assert first == {"a": 1, "b": None}
    assert ks.dedupe_latest(df, ["key"], ["src"]).columns == df.columns


def test_dedupe_is_the_same_in_any_order(spark):
    rows = [("a", "f", i % 7, i) for i in range(200)]
    for seed in (1, 2):
        df = spark.createDataFrame(rows, "k string, src string, x int, y int").orderBy(F.rand(seed)).repartition(5)
        assert [tuple(r) for r in ks.dedupe_latest(df, ["k"], ["src"]).collect()] == [("a", "f", 6, 195)]


def test_split_rejects(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None), (None, None)], "k string, v int")
    good, bad = ks.split_rejects(df, {"key": F.col("k").isNull(), "value": F.col("v").isNull()})
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["key", "key,value", "value"]


def test_as_of(spark):
    left = spark.createDataFrame([(date(2020, 1, d), d) for d in (1, 3, 3, 9)], "date date, i int")
    s = spark.createDataFrame([(date(2020, 1, 2), 5.0), (date(2020, 1, 3), None), (date(2020, 1, 8), 7.0)], "date date, v double")
    got = sorted((r["i"], r["v"]) for r in ks.as_of(left, s, "v").collect())
    assert got == [(1, None), (3, 5.0), (3, 5.0), (9, 7.0)]


def test_as_of_by_key(spark):
    left = spark.createDataFrame([("a", date(2020, 1, 5)), ("b", date(2020, 1, 5))], "k string, date date")
    s = spark.createDataFrame([("a", date(2020, 1, 1), 1.0)], "k string, date date, v double")
    assert {r["k"]: r["v"] for r in ks.as_of(left, s, "v", by=["k"]).collect()} == {"a": 1.0, "b": None}


def test_forward_fill_latest_and_expected(spark, series):
    df = series(col="close", A=[None, 1, None, 2], B=[None, None, 5, None])
    filled = ks.forward_fill(df, "close", ["stock_code"]).orderBy("stock_code", "date")
    assert [r["close_filled"] for r in filled.collect()] == [None, 1.0, 1.0, 2.0, None, None, 5.0, 5.0]
    assert ks.latest(df, ["stock_code"], 1).count() == 2
    assert [r["date"].day for r in ks.latest(df, [], 3).collect()] == [4, 4, 3]
    assert ks.on_latest_day(df).count() == 2
    diff = {tuple(r) for r in ks.expected_diff(df, "stock_code", ["A", "C"]).collect()}
    assert diff == {("B", "unexpected"), ("C", "missing")}


def test_set_overlap(spark):
    df = spark.createDataFrame([("x", 1, 0), ("x", 0, 1), ("y", 1, 0), ("z", 0, 1), ("w", 0, 0)], "k string, a int, b int")
    row = ks.set_overlap(df, "k", F.col("a") == 1, F.col("b") == 1).first()
    assert (row["n_a"], row["n_b"], row["n_both"], row["n_any"]) == (2, 2, 1, 3)
    assert row["jaccard"] == pytest.approx(1 / 3) and row["pct_of_a"] == 50.0
    none = ks.set_overlap(df, "k", F.lit(False), F.lit(False)).first()
    assert (none["n_any"], none["jaccard"]) == (0, 0.0)


def moments(xs):
    n, m = len(xs), np.mean(xs)
    s2, s3, s4 = (np.sum((np.array(xs) - m) ** k) / n for k in (2, 3, 4))
    skew = math.sqrt(n * (n - 1)) / (n - 2) * s3 / s2**1.5 if n > 2 else None
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (s4 / s2**2 - 3) + 6) if n > 3 else None
    return skew, kurt


def test_describe(spark):
    xs = [0.01, -0.02, 0.05, 0.0, 0.03, -0.01, 0.2]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 0.1), ("b", None), ("c", 0.1), ("c", 0.2), ("c", 0.4)], "g string, x double")
    got = {r["g"]: r for r in ss.describe(df, "x", ["g"]).collect()}
    skew, kurt = moments(xs)
    assert got["a"]["skew"] == pytest.approx(skew) and got["a"]["kurt"] == pytest.approx(kurt)
    assert got["a"]["std"] == pytest.approx(np.std(xs, ddof=1) * 100)
    assert got["a"]["win_pct"] == pytest.approx(4 / 7 * 100) and got["a"]["p90"] == pytest.approx(np.quantile(xs, 0.9) * 100)
    assert (got["b"]["cnt"], got["b"]["std"], got["b"]["skew"], got["b"]["kurt"]) == (1, None, None, None)
    assert got["c"]["skew"] is not None and got["c"]["kurt"] is None
    assert {r["g"] for r in ss.describe(df, "x", ["g"], min_n=3).collect()} == {"a", "c"}


def test_tercile_stats(spark):
    rows = [(float(i), i / 100) for i in range(40)] + [(None, 9.0), (5.0, None)]
    df = spark.createDataFrame(rows, "f double, r double")
    got = {r["bucket"]: r["cnt"] for r in ss.tercile_stats(df, {"f": F.col("f"), "rare": F.when(F.col("f") < 5, 1.0)}, "r").collect()}
    assert got == {"low": 10, "middle": 20, "high": 10}


def test_curve_bands(spark):
    df = spark.createDataFrame([("g", [0.0, float(i), None]) for i in range(6)] + [("few", [0.0, 1.0, 2.0])], "g string, c array<double>")
    got = {(r["g"], r["k"]): (r["cnt"], r["median"]) for r in ss.curve_bands(df, {"c": 100.0}, ["g"]).collect()}
    assert got == {("g", 0): (6, 0.0), ("g", 1): (6, 250.0)}


def test_histogram_and_box(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [0, 1, 2, 3, 4, 5, 6, 100]] + [("b", 5.0), ("b", 5.0)], "g string, x double")
    hist = {(r["g"], r["bin"]): r["cnt"] for r in ss.histogram(df, "x", ["g"], bins=10).collect()}
    assert hist == {("a", 1): 7, ("a", 10): 1, ("b", 1): 2}
    box = {r["g"]: r for r in ss.box_summary(df, "x", ["g"]).collect()}["a"]
    assert (box["median"], box["whisker_hi"], box["hi"], box["whisker_lo"]) == (3.5, 6.0, 100.0, 0.0)


def brute_u(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n = len(a) + len(b)
    ties = sum(c**3 - c for c in np.unique(np.concatenate([a, b]), return_counts=True)[1])
    sd = math.sqrt(len(a) * len(b) / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = max(abs(u - len(a) * len(b) / 2) - 0.5, 0) / sd
    return u, math.erfc(z / math.sqrt(2))


def test_quantiles_take_no_nan_and_spread_ends(spark):
    df = spark.createDataFrame([("a", x) for x in (1.7e308, -1.7e308, float("nan"), None, 5.0, -0.0, 0.0)], "g string, x double")
    row = quantiles(df, ["g"], "x", [0.25, 0.5, 0.75], ["a", "b", "c"]).first()
    assert (row["n"], row["a"], row["b"], row["c"]) == (5, 0.0, 0.0, 5.0)


def test_exact_rank_sum():
    from itertools import combinations

    for m, n in ((1, 1), (2, 3), (3, 3), (4, 5), (1, 7), (5, 2)):
        want = [0] * (m * n + 1)
        for taken in combinations(range(m + n), m):
            want[sum(taken) - m * (m - 1) // 2] += 1
        assert ss.rank_sum_counts(m, n) == want
        for u in range(m * n + 1):
            upper = sum(want[max(u, m * n - u) :])
            assert ss.exact_p(m, n, u) == pytest.approx(min(1.0, 2 * upper / sum(want)))


def test_exact_p_of_small_groups(spark):
    rows = [("small", int(i in (6, 8, 9)), float(i * i)) for i in range(11)] + [("tied", i % 2, float(i // 2)) for i in range(9)]
    got = {r["f"]: r for r in ss.mann_whitney(spark.createDataFrame(rows, "f string, g int, x double"), "x", "g", ["f"]).collect()}
    assert got["small"]["u"] == 20.0 and got["small"]["p_value"] == pytest.approx(ss.exact_p(3, 8, 20))
    assert got["tied"]["p_value"] == pytest.approx(math.erfc(got["tied"]["z"] / math.sqrt(2)))


@pytest.mark.parametrize("per_range", [100_000, 8])
def test_mann_whitney(spark, per_range):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(0.3, 1, 300), 1), np.round(rng.normal(0, 1, 500), 1)
    rows = [("f", 1, float(x)) for x in a] + [("f", 0, float(x)) for x in b] + [("c", g, 1.0) for g in (0, 1, 1)]
    df = spark.createDataFrame(rows, "f string, g int, x double")
    got = {r["f"]: r for r in ss.mann_whitney(df, "x", "g", ["f"], per_range=per_range).collect()}
    u, p = brute_u(a, b)
    assert got["f"]["u"] == pytest.approx(u) and got["f"]["p_value"] == pytest.approx(p)
    assert got["c"]["z"] is None and got["c"]["p_value"] is None


def test_compare_groups(spark):
    rows = [(1, float(i)) for i in range(10)] + [(0, float(i) + 20) for i in range(8)] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "high int, x double")
    feats = {"x": F.col("x"), "rare": F.when((F.col("x") < 3), F.col("x"))}
    got = ss.compare_groups(df, feats, "high").collect()
    assert [r["feature"] for r in got] == ["x"]
    assert (got[0]["n_hi"], got[0]["n_lo"], got[0]["u"], got[0]["stars"]) == (10, 8, 0.0, "***")


def test_round_histogram(spark):
    xs = [-0.31, -0.3, 0.0, 0.29, 5.0, 5.6]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 7.0), ("b", None)], "g string, x double")
    got = {(r["g"], round(r["lo"], 6)): (r["cnt"], r["width"]) for r in ss.round_histogram(df, "x", ["g"], most_bins=60).collect()}
    assert got == {("a", -0.4): (1, 0.1), ("a", -0.3): (1, 0.1), ("a", 0.0): (1, 0.1), ("a", 0.2): (1, 0.1), ("a", 5.0): (1, 0.1), ("a", 5.5): (1, 0.1), ("b", 7.0): (1, 1e-9)}
    wide = ss.round_histogram(df, "x", ["g"], most_bins=3).where("g = 'a'").collect()
    assert {r["width"] for r in wide} == {5.0} and sum(r["cnt"] for r in wide) == 6


@pytest.mark.parametrize("most_held", [100_000, 50])
def test_quantiles_hand_over_one_row_per_wanted_rank(spark, monkeypatch, most_held):
    from pyspark.sql import types as T

    handed, mark = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda side: handed.append(side) or mark(side))
    df = spark.range(40 * 500).select((F.col("id") % 40).cast("int").alias("g"), (F.col("id") * 7919 % 20011).cast("double").alias("x"))
    got = {r.g: (r.lo, r.hi) for r in quantiles(df, ["g"], "x", [0.3, 0.7], ["lo", "hi"], ranges=64, most_held=most_held, few_groups=True).collect()}
    assert max(side.count() for side in handed) <= 40 * 4
    assert not any(isinstance(f.dataType, T.ArrayType) for side in handed for f in side.schema)
    xs = np.array([i * 7919 % 20011 for i in range(40 * 500)], float).reshape(500, 40)
    assert all(np.allclose(got[g], np.quantile(xs[:, g], [0.3, 0.7])) for g in range(40))


def test_reject_totals_read_the_rows_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), (None, 1), ("b", None), (None, None), ("c", 2)], "k string, v int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    totals = ks.reject_totals(df, {"key": F.col("k").isNull(), "number": F.col("v").isNull()})
    assert {(r.reason, r.cnt) for r in totals.collect()} == {("clean", 2), ("key", 1), ("number", 1), ("key,number", 1)}
    assert totals._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_reject_counts_query_has_one_reading(spark):
    from checks import data

    plan = data.reject_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


@pytest.mark.parametrize("pick, want", [(ks.dedupe_latest, (3, "z", 9.0)), (ks.dedupe_first, (1, "a", 4.0))])
def test_picked_rows_travel_once(spark, pick, want):
    rows = [("k", 3, "y", 5.0), ("k", 3, "z", 9.0), ("k", 1, "b", 7.0), ("k", 1, "a", 4.0), ("m", None, None, None)]
    df = spark.createDataFrame(rows, "key string, at int, name string, x double")
    out = pick(df, ["key"], ["at"])
    assert {tuple(r) for r in out.collect()} == {("k", *want), ("m", None, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "min_by" not in plan


def test_curves_are_scaled_in_compiled_code(spark, monkeypatch):
    df = spark.createDataFrame([(1, [0.0, float(i), None]) for i in range(8)], "g int, c array<double>")
    plans = []
    monkeypatch.setattr(ss, "quantiles", lambda long, *a, **k: plans.append(long._jdf.queryExecution().optimizedPlan().toString()) or quantiles(long, *a, **k))
    got = {r.k: (r.cnt, r.median) for r in ss.curve_bands(df, {"c": 100.0}, ["g"]).collect()}
    assert got == {0: (8, 0.0), 1: (8, 350.0)} and "transform(" not in plans[0]


def test_curves_of_groups_by_number(spark, monkeypatch):
    """Null groups, small ones, curves of several lengths, no grouping: as numpy has them, and matched by whole numbers that are never null."""
    rows = [(None if i % 3 == 0 else f"g{i % 3}", i % 2, [float(i), float(i * i % 7)], [None, -float(i), 0.5]) for i in range(40)] + [("few", 0, [1.0], [1.0])] * 4
    df = spark.createDataFrame(rows, "g string, h int, a array<double>, b array<double>")
    keys, real = [], ss.quantiles
    monkeypatch.setattr(ss, "quantiles", lambda d, by, *a, **kw: keys.append([(d.schema[b].dataType.typeName(), d.schema[b].nullable) for b in by]) or real(d, by, *a, **kw))
    for by, few in ((["g", "h"], True), (["g", "h"], False), ([], True)):
        got = {tuple(r)[: len(by) + 2]: (r["cnt"], r["p25"], r["median"], r["p75"]) for r in ss.curve_bands(df, {"a": 1.0, "b": 100.0}, by, few_groups=few).collect()}
        want = {}
        for g, h, a, b in rows:
            for name, ys, scale in (("a", a, 1.0), ("b", b, 100.0)):
                for k, y in enumerate(ys):
                    if y is not None and not (by and g == "few"):
                        want.setdefault((*((g, h) if by else ()), name, k), []).append(y * scale)
        assert got.keys() == want.keys()
        for at, values in want.items():
            assert got[at] == pytest.approx((len(values), *np.quantile(values, [0.25, 0.5, 0.75])))
    assert all(kind in ("integer", "long") and not nullable for by in keys for kind, nullable in by)
