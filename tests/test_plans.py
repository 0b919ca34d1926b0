import datetime as dt
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from finpanel.plans import events as ev
from finpanel.plans import factors as fa
from finpanel.plans import fx
from finpanel.plans import loadings as lo
from finpanel.plans import market as mk
from finpanel.plans import report as rp
from finpanel.plans import study as st
from finpanel.plans import universe as un
from finpanel.session import materialize

DAY = dt.date(2020, 1, 1)


def column(df, name, code="A"):
    return [r[name] for r in df.where(F.col("stock_code") == code).orderBy("date").collect()]


# ---- events ----------------------------------------------------------------------------------------


def test_band_needs_twenty_full_rows(series):
    df = ev.amplitude_events(series(A=range(19), B=range(21), C=[*range(5), None, *range(30)]))
    assert column(df, "roll_hi", "A") == [None] * 19
    assert column(df, "roll_hi", "B")[20] == pytest.approx(np.quantile(range(20), 0.9))
    assert column(df, "amp_big", "B") == [0] * 20 + [1]
    got = column(df, "roll_lo", "C")
    assert got[:26] == [None] * 26 and got[26] == pytest.approx(np.quantile(range(20), 0.1))


def test_band_equal_is_no_event_and_today_is_left_out(series):
    df = ev.amplitude_events(series(A=[1] * 21 + [2], B=[0.1] * 20 + [0.05]))
    assert column(df, "amp_big") == [0] * 21 + [1] and column(df, "amp_sml") == [0] * 22
    assert column(df, "amp_sml", "B")[20] == 1


def test_flags_exclude_each_other(spark, series):
    rng = np.random.default_rng(1)
    df = ev.amplitude_events(series(A=rng.integers(0, 4, 300)))
    assert df.where((F.col("amp_big") == 1) & (F.col("amp_sml") == 1)).isEmpty()


def test_abnormal_and_hump(series):
    df = ev.abnormal(series("volume", A=[2] * 20 + [3], B=[0] * 21, C=[2] * 10 + [None] + [2] * 10), "volume", missing=0.0)
    assert column(df, "abnormal_volume")[20] == pytest.approx(0.5)
    assert column(df, "abnormal_volume", "B")[20] is None
    assert column(df, "abnormal_volume", "C")[20] == pytest.approx(2 / 1.9 - 1)
    path = [1, 1] + [0.5] * 18 + [0.9, 5]
    assert column(ev.hump(series(A=path)), "hump_event") == [1] + [0] * 21


def test_event_table(spark):
    rows = [("1101", DAY, 1.0, " A ", None, None), ("1101", DAY + dt.timedelta(1), 1.0, None, None, None), ("Y9999", DAY, 1.0, "A", "D", "Y"),
            ("12AB", DAY, 1.0, "A", None, None), ("2330", DAY, None, None, "D", "Y")]
    df = spark.createDataFrame(rows, "stock_code string, date date, amp_pct double, alert_a string, disposition_d string, full_delivery_y string")
    got = sorted(tuple(r) for r in ev.event_table(df).collect())
    assert got == [("1101", 20200101, 1, 0, 0, 0, 0), ("2330", 20200101, 0, 1, 1, 0, 0)]
    total = ev.flag_totals(ev.event_table(df)).first()
    assert (total["rows"], total["attention_a"], total["amp_big"]) == (2, 1, 0)


# ---- universe --------------------------------------------------------------------------------------


def test_universe_order_of_rules(spark):
    rows = []
    for code, n in (("1101", 251), ("1102", 252), ("1103", 253), ("1104", 300), ("Y9999", 300)):
        for i in range(n):
            d = "D" if code == "1103" and i < 2 else None
            y = "Y" if code == "1104" and i == 7 else None
            vol = 0.0 if i == 5 else None if i == 6 else 1.0
            rows.append((code, DAY + dt.timedelta(i), vol, "A" if i == 0 else None, d, y))
    df = spark.createDataFrame(rows, "stock_code string, date date, volume double, alert_a string, disposition_d string, full_delivery_y string")
    got = {r["stock_code"]: (r["n"], r["a"]) for r in un.apply_universe(df).groupBy("stock_code").agg(F.count("*").alias("n"), F.sum("is_attention").alias("a")).collect()}
    assert got == {"1102": (250, 1)}


def test_market_series_takes_one_row_per_day(spark):
    df = spark.createDataFrame([("Y9999", "x", DAY, 1.0), ("Z1", "加權指數", DAY, 2.0), ("1101", "y", DAY, 3.0)], "stock_code string, name string, date date, return_pct double")
    assert [tuple(r) for r in un.market_series(df).collect()] == [(DAY, 1.0)]


# ---- study -----------------------------------------------------------------------------------------


def brute_study(amp, ret, mkt, vol, lag):
    n, out = len(amp), []
    ret, mkt, vol = (np.array([0 if x is None else x for x in xs], float) for xs in (ret, mkt, vol))
    amp = np.array([np.nan if x is None else x for x in amp], float)

    def ab(xs, t):
        w = xs[t - 20 : t]
        return np.nan if t < 20 or np.isnan(w).any() or w.mean() <= 0 else xs[t] / w.mean() - 1

    aa, av = (np.nan_to_num([ab(xs, t) for t in range(n)]) for xs in (amp, vol))
    grow = lambda xs, i, j: np.prod(1 + xs[i + 1 : j + 1] / 100)
    for t in range(n):
        row = {}
        for h in (1, 5, 20):
            ok = t + h + lag < n
            row[f"fwd_ret_{h}"] = grow(ret, t + lag, t + h + lag) - 1 if ok else None
            m = grow(mkt, t + lag, t + h + lag) if ok else 0
            row[f"fwd_exc_{h}"] = grow(ret, t + lag, t + h + lag) / m - 1 if ok and m > 0 else None
        row["persist_amp"] = aa[t + 1 : t + 21].sum() if t + 20 < n else None
        row["persist_vol"] = av[t + 1 : t + 21].sum() if t + 20 < n else None
        if t + 20 + lag < n:
            path = np.array([grow(ret, t + lag, t + lag + k) - 1 for k in range(21)])
            row["mdd"] = (path - np.maximum.accumulate(path)).min()
        else:
            row["mdd"] = None
        row["cum_ret"] = [grow(ret, t, t + k) - 1 if t + k < n else None for k in range(21)]
        row["cum_exc"] = [grow(ret, t, t + k) / grow(mkt, t, t + k) - 1 if t + k < n and grow(mkt, t, t + k) > 0 else None for k in range(21)]
        row["cum_amp"] = [aa[t + 1 : t + k + 1].sum() if t + k < n else None for k in range(21)]
        out.append(row)
    return out


@pytest.mark.parametrize("lag", [0, 1])
def test_study_panel_against_loops(spark, lag):
    rng = np.random.default_rng(5)
    n = 70
    amp = [None if i == 33 else float(x) for i, x in enumerate(rng.uniform(0, 5, n))]
    ret = [None if i == 12 else -100.0 if i == 40 else float(x) for i, x in enumerate(rng.normal(0, 2, n))]
    mkt = [-100.0 if i == 55 else float(x) for i, x in enumerate(rng.normal(0, 1, n))]
    vol = [None if i == 3 else float(x) for i, x in enumerate(rng.integers(0, 9, n))]
    days = [DAY + dt.timedelta(i) for i in range(n)]
    df = spark.createDataFrame([("A", *r) for r in zip(days, amp, ret, vol)], "stock_code string, date date, amp_pct double, return_pct double, volume double")
    market = spark.createDataFrame([r for i, r in enumerate(zip(days, mkt)) if i != 20], "date date, mkt_pct double")
    mkt[20] = None
    got = st.study_panel(df, market, entry_lag=lag).orderBy("date").collect()
    for t, (g, want) in enumerate(zip(got, brute_study(amp, ret, mkt, vol, lag), strict=True)):
        for name, value in want.items():
            close = pytest.approx(value, abs=1e-8) if not isinstance(value, list) else [x if x is None else pytest.approx(x, abs=1e-8) for x in value]
            assert g[name] == close, (t, name)


def test_forward_returns_match_study(spark, series):
    df = st.forward_returns(series("return_pct", A=[1, 2, None, -100, 5]), horizons=(1, 2))
    assert [round(x, 9) if x is not None else None for x in column(df, "fwd_ret_1")] == [0.02, 0.0, -1.0, 0.05, None]
    assert [round(x, 9) if x is not None else None for x in column(df, "fwd_ret_2")] == [0.02, -1.0, -1.0, None, None]


def test_persistence_probability(spark):
    rows = [("A", DAY + dt.timedelta(i), float(i)) for i in range(7)] + [("B", DAY + dt.timedelta(i), 100.0) for i in range(5)] + [("C", DAY, None)]
    df = spark.createDataFrame(rows, "stock_code string, date date, persist_amp double")
    assert [tuple(r) for r in st.persistence_probability(df).collect()] == [("A", 0.0, 0, 6)]
    assert [tuple(r) for r in st.persistence_probability(df, pct=0.2).collect()] == [("A", pytest.approx(3 / 6), 3, 6)]
    assert st.persistence_probability(df.limit(9)).isEmpty()
    run = {(r["stock_code"], r["date"]): r["persist_prob"] for r in st.running_probability(df, pct=0.2).collect()}
    assert run[("A", DAY + dt.timedelta(6))] == pytest.approx(0.5) and run[("A", DAY + dt.timedelta(4))] is None


def test_merge_back_replaces(spark):
    panel = spark.createDataFrame([("A", 1, 9.0), ("B", 2, 9.0)], "stock_code string, x int, stock_persist_prob double")
    prob = spark.createDataFrame([("A", 0.5)], "stock_code string, stock_persist_prob double")
    assert sorted(tuple(r) for r in st.merge_back(panel, prob).collect()) == [("A", 1, 0.5), ("B", 2, None)]


# ---- market and fx ---------------------------------------------------------------------------------


def test_market_breadth(spark):
    rows = [(f"{s}", DAY + dt.timedelta(i), int(s < (i % 5)), int(s == 9)) for i in range(25) for s in range(10)]
    got = mk.market_breadth(spark.createDataFrame(rows, "stock_code string, date date, amp_big int, amp_sml int")).orderBy("date").collect()
    share = [(i % 5) / 10 for i in range(25)]
    assert [r["mkt_hi90"] for r in got[:19]] == [None] * 19
    for i in range(19, 25):
        assert got[i]["mkt_hi90"] == pytest.approx(np.quantile(share[i - 19 : i + 1], 0.9))
        assert got[i]["mkt_lo10"] == pytest.approx(np.quantile(share[i - 19 : i + 1], 0.1))
        assert got[i]["mkt_amp_hi"] == int(share[i] > np.quantile(share[i - 19 : i + 1], 0.9) + 1e-9)


def test_index_after_events(spark, series):
    idx = series("return_pct", Y9999=[1] * 30, SC300=[1] * 30)
    flags = spark.createDataFrame([(DAY + dt.timedelta(i), int(i in (1, 3, 5, 7, 9, 28))) for i in range(30)], "date date, mkt_amp_hi int")
    got = {(r["stock_code"], r["horizon"]): (r["cnt"], round(r["mean"], 6)) for r in mk.index_after_events(flags, idx, "mkt_amp_hi").collect()}
    assert got[("Y9999", "fwd_ret_1")] == (6, 1.0) and got[("SC300", "fwd_ret_20")] == (5, round((1.01**20 - 1) * 100, 6))


def test_cross_rate(spark):
    df = spark.createDataFrame([("TWD", DAY, 0.0307), ("JPY", DAY, 0.0068), ("AUD", DAY, 0.0), ("KRW", DAY, None)], "currency string, date date, close double")
    got = {r["currency"]: (r["foreign_per_bridge"], r["bridge_per_foreign"]) for r in fx.cross_rate(df, "TWD").collect()}
    assert got == {"JPY": (4.5147, 0.2215), "AUD": (None, 0.0), "KRW": (None, None)}
    row = fx.keyed_summary(df, "currency", value="close").first()
    assert (row["keys"], row["total"], row["missing"]) == (4, 4, 1)


# ---- factors ---------------------------------------------------------------------------------------


def test_compounded_frames(spark, series):
    rng = np.random.default_rng(2)
    xs = [None if i in (4, 30) else -100.0 if i == 60 else float(x) for i, x in enumerate(rng.normal(0, 3, 300))]
    df = fa.with_momentum(series("return_pct", A=xs))
    for name, first, last in (("mom", 231, 22), ("rev", 21, 1)):
        got = column(df, name)
        for i in range(300):
            part = [1 + x / 100 for x in xs[max(0, i - first) : max(0, i - last + 1)] if x is not None]
            want = (np.prod(part) - 1) * 100 if part else None
            assert got[i] == (want if want is None else pytest.approx(want, abs=1e-7)), (name, i)


def cross_section(spark, n=40, mcap=None):
    rng = np.random.default_rng(11)
    rows = []
    for d in range(3):
        for s in range(n):
            cap = 99.99 if s == 0 else 100.0 if s == 1 else float(rng.uniform(200, 900))
            pb = None if s == 2 else 0.0 if s == 3 else -2.0 if s == 4 else float(rng.uniform(0.5, 4))
            pe = 0.5 if s == 5 else None if s == 6 else float(rng.uniform(5, 40))
            dy = None if s % 4 == 0 else float(rng.uniform(0, 6))
            rows.append((f"{1000 + s}", DAY + dt.timedelta(d), None if s == 7 else float(rng.normal(0, 2)), cap, pe, pb, dy, 1.5 if s % 8 == 0 else None))
    return rows, spark.createDataFrame(rows, "stock_code string, date date, return_pct double, market_cap double, pe double, pb double, div_yield double, cash_div double")


def brute_factors(rows, day, mom, rev, min_sort=10):
    rs = [r for r in rows if r[1] == day]
    ok = [r for r in rs if r[2] is not None and r[3] >= 100]
    nan = float("nan")
    size = np.array([r[3] for r in ok])
    ret = np.array([r[2] for r in ok])
    bm = np.array([nan if not r[5] else 1 / r[5] for r in ok])
    ep = np.array([nan if not r[4] else min(1 / r[4], 1) for r in ok])
    dy = np.array([r[6] if r[6] is not None else r[7] if r[7] is not None else 0 for r in ok])
    small = size < np.median(size)

    def sides(x, valid):
        if valid.sum() < min_sort:
            return np.zeros(len(x), bool), np.zeros(len(x), bool)
        with np.errstate(invalid="ignore"):
            return x >= np.quantile(x[valid], 0.7), x <= np.quantile(x[valid], 0.3)

    vw = lambda k: np.average(ret[k], weights=size[k]) if k.any() else nan
    h, low = sides(bm, ~np.isnan(bm))
    legs = [vw(s & g) for s in (small, ~small) for g in (h, ~h & ~low, low)]
    out = {"SMB": np.nanmean(legs[:3]) - np.nanmean(legs[3:]), "HML": np.nanmean([legs[0], legs[3]]) - np.nanmean([legs[2], legs[5]])}
    for name, x, valid in (("WML_ep", ep, ep > 0), ("WML_dy", dy, dy > 0)):
        a, b = sides(x, valid)
        out[name] = vw(a) - vw(b)
    for name, vals, sign in (("UMD", mom, 1), ("STR", rev, -1)):
        x = np.array([nan if vals.get((r[0], day)) is None else vals[(r[0], day)] for r in ok])
        a, b = sides(x, ~np.isnan(x))
        out[name] = sign * (vw(a) - vw(b))
    return out


def test_factor_returns_against_loops(spark):
    rows, df = cross_section(spark)
    market = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(1), None)], "date date, mkt_pct double")
    rates = spark.createDataFrame([("a", DAY + dt.timedelta(1), 1.0), ("b", DAY + dt.timedelta(1), 2.0), ("c", DAY + dt.timedelta(1), 0.0)], "bank string, date date, rate_1y double")
    got = {r["date"]: r for r in fa.factor_returns(df, market, rates).collect()}
    moved = fa.with_momentum(df).collect()
    mom, rev = ({(r["stock_code"], r["date"]): r[k] for r in moved} for k in ("mom", "rev"))
    for d in range(3):
        day = DAY + dt.timedelta(d)
        for name, want in brute_factors(rows, day, mom, rev).items():
            assert got[day][name] == (None if math.isnan(want) else pytest.approx(want, abs=6e-5)), (d, name)
    assert [got[DAY + dt.timedelta(d)]["Rm_Rf"] for d in range(3)] == [1.0, -0.5, -0.5]
    yearly = fa.factor_returns(df, market, rates, periods_per_year=250).orderBy("date").collect()
    assert yearly[1]["Rm_Rf"] == pytest.approx(1 - 1.5 / 250, abs=1e-4)
    assert fa.factor_returns(df, market, None, min_names=41).isEmpty()


def test_hot_day_and_hot_value_sort(spark):
    """A day with far more names than sub-ranges, a third of them with the same value."""
    rng = np.random.default_rng(4)
    xs = np.where(rng.random(9000) < 0.34, 1.0, rng.gamma(2, 1, 9000))
    from finpanel.operators.quantiles import quantiles

    df = spark.createDataFrame([(DAY, float(x)) for x in xs] + [(DAY + dt.timedelta(1), 2.0)], "date date, bm double")
    got = quantiles(df, ["date"], "bm", [0.3, 0.7], ["lo", "hi"], ranges=16, most_held=20).where(F.col("date") == DAY).first()
    assert (got["lo"], got["hi"]) == pytest.approx(tuple(np.quantile(xs, [0.3, 0.7])))


# ---- loadings --------------------------------------------------------------------------------------


def brute_beta(y, x, window, min_obs):
    out = []
    for i in range(len(y)):
        row = [None] * x.shape[1]
        if i >= window:
            yw, xw = y[i - window : i], x[i - window : i].copy()
            for f in range(xw.shape[1]):
                have = np.flatnonzero(~np.isnan(xw[:, f]))
                if len(have):
                    for t in range(window):
                        prior = have[have <= t]
                        xw[t, f] = xw[prior[-1] if len(prior) else have[0], f]
            ok = ~np.isnan(yw)
            if not np.isnan(xw).any() and ok.sum() >= min_obs:
                design = np.column_stack([np.ones(ok.sum()), xw[ok]])
                row = np.linalg.lstsq(design, yw[ok], rcond=None)[0][1:].tolist()
        out.append(row)
    return out


def test_rolling_betas_against_loops(spark):
    rng = np.random.default_rng(9)
    n, window, min_obs = 330, 60, 40
    days = [DAY + dt.timedelta(i) for i in range(n)]
    factor = rng.normal(0, 1, (n, 3))
    factor[:70, 1] = np.nan  # starts late: no value at all in the first windows
    factor[150:155] = np.nan  # a gap
    factor[200:300, 2] = 2 * factor[200:300, 0]  # collinear windows
    codes = {"A": rng.normal(0, 2, n), "B": rng.normal(0, 2, n)}
    codes["B"][100:140] = np.nan  # too few returns in some windows
    rows = [(c, d, None if np.isnan(y) else float(y), 7) for c, ys in codes.items() for d, y in zip(days, ys)]
    df = spark.createDataFrame(rows, "stock_code string, date date, return_pct double, tag int")
    frows = [(d, *[None if np.isnan(v) else float(v) for v in row], None) for d, row in zip(days, factor) if d.day != 13]
    missing = np.array([d.day == 13 for d in days])
    factors = spark.createDataFrame(frows, "date date, f1 double, f2 double, f3 double, empty double")
    got = lo.rolling_betas(df, factors, names=["f1", "f2", "f3", "empty"], keep=["tag"], window=window, min_obs=min_obs)
    seen = np.where(missing[:, None], np.nan, factor)
    for code, ys in codes.items():
        have = got.where(F.col("stock_code") == code).orderBy("date").collect()
        want = brute_beta(ys / 100, seen, window, min_obs)
        assert sum(w[0] is not None for w in want) > 50
        for i, (g, w) in enumerate(zip(have, want, strict=True)):
            assert g["tag"] == 7 and g["beta_empty"] is None
            for j in range(3):
                assert g[f"beta_f{j + 1}"] == (None if w[j] is None else pytest.approx(w[j], abs=1e-9)), (code, i, j)


# ---- report models ---------------------------------------------------------------------------------


def test_logit_against_newton(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x)], "y double, a double, b double")
    got = {r["variable"]: r for r in rp.logit_table(df, "y", ["a", "b"]).collect()}
    design, beta = np.column_stack([x, np.ones(400)]), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ beta))
        info = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, design.T @ (y - p))
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    ll = np.sum(np.log(np.where(y == 1, p, 1 - p)))
    ll0 = 400 * (y.mean() * np.log(y.mean()) + (1 - y.mean()) * np.log(1 - y.mean()))
    for i, name in enumerate(["a", "b", "const"]):
        assert got[name]["coef"] == pytest.approx(beta[i], abs=1e-6)
        assert got[name]["std_err"] == pytest.approx(se[i], rel=1e-4)
        assert got[name]["p_value"] == pytest.approx(math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)), abs=1e-5)
        assert got[name]["ci_hi"] == pytest.approx(beta[i] + 1.959964 * se[i], abs=1e-4)
    assert got["a"]["pseudo_r2"] == pytest.approx(1 - ll / ll0, abs=1e-6) and got["a"]["n"] == 400


def test_logit_needs_rows_and_two_classes(spark):
    few = spark.createDataFrame([(float(i % 2), float(i)) for i in range(49)], "y double, a double")
    same = spark.createDataFrame([(1.0, float(i)) for i in range(80)], "y double, a double")
    assert rp.logit_table(few, "y", ["a"]).isEmpty() and rp.logit_table(same, "y", ["a"]).isEmpty()


def test_logit_of_groups(spark):
    """Groups are fitted together, each as if alone; nulls leave rows out."""
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.random() < 0.3 + 0.4 * (x > 0)), float(x)) for g in "ab" for x in rng.normal(size=150)] + [(None, 1.0, 0.0), ("a", None, 1.0), ("c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, x double")
    both = rp.logit_table(df, "y", ["x"], by="g")
    for g in "ab":
        alone = rp.logit_table(df.where(F.col("g") == g), "y", ["x"])
        assert sorted(both.where(F.col("g") == g).drop("g").collect()) == sorted(alone.collect())
    assert {r["g"] for r in both.collect()} == {"a", "b"}


def test_full_report(spark):
    rng = np.random.default_rng(12)
    n = 120
    rows = [
        (f"{1101 + c}", DAY + dt.timedelta(i), float(rng.uniform(0, 5)), float(rng.normal(0, 2)), float(rng.integers(1, 9)), float(rng.uniform(100, 900)),
         float(rng.uniform(5, 30)), float(rng.uniform(0.5, 4)), float(rng.uniform(0, 5)), float(rng.uniform(0, 2)), "A" if rng.random() < 0.2 else None)
        for c in range(8) for i in range(n)
    ]
    cols = "stock_code string, date date, amp_pct double, return_pct double, volume double, market_cap double, pe double, pb double, cash_div double, beta double, alert_a string"
    df = spark.createDataFrame(rows, cols).withColumn("is_attention", F.coalesce((F.col("alert_a") == "A").cast("int"), F.lit(0)))
    market = df.groupBy("date").agg(F.avg("return_pct").alias("mkt_pct"))
    index = market.select(F.lit("Y9999").alias("stock_code"), "date", F.col("mkt_pct").alias("return_pct"))
    tables = rp.full_report(st.study_panel(df, market), index)
    counts = {name: t.count() for name, t in tables.items()}
    assert counts["event_summary"] == 2 and counts["return_stats"] == 12 and counts["overlap"] == 1
    assert counts["persistence_curves"] == 2 * 2 * 3 * 21 and counts["persistence_compare"] == 8
    assert counts["market_amplitude"] == n and counts["persistence_logit"] in (0, 5, 10)
    rows = rp.report_rows(tables)
    assert {r["section"] for r in rows.select("section").distinct().collect()} == {t for t, c in counts.items() if c}
    assert rows.where("section = 'return_stats' AND value_name = 'cnt'").count() == 12
    few = rp.event_rows(st.study_panel(df, market).limit(40))
    assert few.where("high IS NOT NULL").isEmpty() and rp.overlap_of_persistent(few).isEmpty()


def test_running_products_against_whole_windows():
    """Gaps, a factor that is constant for a while, outliers, few returns: as solving every window from its rows."""
    rng = np.random.default_rng(4)
    n, k, window = 700, 4, 60
    names = [f"f{i}" for i in range(k)]
    for gaps, missing, odd in ((0.0, 0.0, None), (0.1, 0.2, None), (0.0, 0.0, "constant"), (0.02, 0.0, "outlier"), (0.0, 0.0, "late"), (0.0, 0.97, None)):
        x, y = rng.normal(size=(n, k)), rng.normal(size=n)
        x[rng.random((n, k)) < gaps], y[rng.random(n) < missing] = np.nan, np.nan
        if odd == "constant":
            x[100:300, 2] = 1.5
        elif odd == "outlier":
            x[50, 1], y[80] = 1e7, 1e7
        elif odd == "late":
            x[:200, 3] = np.nan
        got = lo._security_betas(pd.DataFrame({**dict(zip(names, x.T)), "return_pct": y}), names, window, 20)
        y /= 100.0
        want = np.full((n, k), np.nan)
        want[window:] = lo._solve(lo._windows(x, window)[:-1], np.lib.stride_tricks.sliding_window_view(y, window)[:-1], 20)
        assert np.array_equal(np.isnan(got), np.isnan(want))
        assert np.allclose(got, want, rtol=1e-7, atol=1e-9, equal_nan=True), (gaps, missing, odd)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_report_stores_curves_of_events_only(spark, monkeypatch):
    """The study behind the report stores no curves, and of the panel the columns that are read."""
    from checks import study as queries

    seen = []
    monkeypatch.setattr(queries.rp, "full_report", lambda panel, index: seen.append(panel) or {"none": index, "return_histograms": index})
    monkeypatch.setattr(queries.rp, "report_rows", lambda tables: spark.sql("SELECT 1.0D AS value"))
    queries.full_report(spark, "/root/testdata/sf0.001")
    stored = {f.name for path in {p.rsplit("/", 1)[0] for p in seen[0].inputFiles()} for f in spark.read.parquet(path).schema}
    assert "market_cap" in stored and not stored & {"cum_amp", "cum_ret", "cum_exc"}
    narrow = queries.study(spark, "/root/testdata/sf0.001", "beta")
    stored = {f.name for path in {p.rsplit("/", 1)[0] for p in narrow.inputFiles() if "/panel-" in p} for f in spark.read.parquet(path).schema}
    assert stored == {*queries.READ, "beta"}


def test_universe_and_study_share_a_sort(spark):
    cols = "stock_code string, date date, amp_pct double, return_pct double, volume double, disposition_d string, full_delivery_y string, alert_a string"
    rows = spark.createDataFrame([("1101", DAY, 1.0, 0.0, 1.0, None, None, None)], cols)
    chosen = un.apply_universe(rows, min_days=1)
    plan = ev.amplitude_events(chosen)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [stock_code") == 1 and chosen.count() == 1


def test_attention_sizes_are_counted_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(rp, "materialize", lambda df, name="stage": stored.append(name) or materialize(df, name))
    rows = [("big" if i % 3 else None, i % 2, float(i)) for i in range(60)] + [("sml", 1, 5.0)] * 4
    got = rp.attention_stats(spark.createDataFrame(rows, "kind string, is_attention int, fwd_exc_20 double"))
    assert stored == ["sizes"]
    assert sorted(((r["kind"] or "", r["is_attention"], r["cnt"]) for r in got.collect())) == [("", 0, 10), ("", 1, 10), ("big", 0, 20), ("big", 1, 20)]
