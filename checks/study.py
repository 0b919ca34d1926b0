"""Events, universe, event study, market: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views as v
from checks.solve import normal_p, solved
from finpanel.functions import trimmed
from finpanel.operators.quantiles import quantiles
from finpanel.operators.stats import WIDTHS, mann_whitney
from finpanel.plans import events as ev
from finpanel.plans import market as mk
from finpanel.plans import report as rp
from finpanel.plans import study as st
from finpanel.plans import universe as un
from finpanel.session import materialize


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Six decimals. The small offset keeps exact ties of the seventh decimal from splitting the engines."""
    return df.withColumns({c: trimmed(F.col(c) + 3.7e-9, 6) + 0.0 for c in cols})


# ---- events ---------------------------------------------------------------------------------------

W20 = "PARTITION BY stock_code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"
BANDED = f"""banded AS (SELECT *,
    CASE WHEN count(amp_pct) OVER w = 20 THEN round(quantile_cont(amp_pct, 0.9) OVER w, 9) END AS roll_hi,
    CASE WHEN count(amp_pct) OVER w = 20 THEN round(quantile_cont(amp_pct, 0.1) OVER w, 9) END AS roll_lo,
    CASE WHEN count(amp_pct) OVER w = 20 THEN avg(amp_pct) OVER w END AS roll_mean,
    CASE WHEN count(*) OVER w = 20 THEN avg(coalesce(volume, 0)) OVER w END AS vol_mean
  FROM base WINDOW w AS ({W20}))"""
FLAGGED = """flagged AS (SELECT *, CAST(coalesce(amp_pct > roll_hi, false) AS INTEGER) AS amp_big,
    CAST(coalesce(amp_pct < roll_lo, false) AS INTEGER) AS amp_sml,
    CASE WHEN roll_mean > 0 THEN amp_pct / roll_mean - 1 END AS abnormal_amp,
    CASE WHEN vol_mean > 0 THEN coalesce(volume, 0) / vol_mean - 1 END AS abnormal_vol FROM banded)"""
BASE_STOCKS = "base AS (SELECT * FROM panel WHERE regexp_matches(stock_code, '^[0-9]{4}'))"
EVENTS = f"WITH {v.PANEL}, {BASE_STOCKS}, {BANDED}, {FLAGGED}"
EVENT_TABLE = f"""{EVENTS}, event_table AS (SELECT stock_code, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS ymd,
    CAST(coalesce(alert_a = 'A', false) AS INTEGER) AS attention_a, CAST(coalesce(disposition_d = 'D', false) AS INTEGER) AS disposition_d,
    CAST(coalesce(full_delivery_y = 'Y', false) AS INTEGER) AS full_delivery_y, amp_big, amp_sml
  FROM flagged WHERE alert_a = 'A' OR disposition_d = 'D' OR full_delivery_y = 'Y' OR amp_big = 1 OR amp_sml = 1)"""


def event_table(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_table(v.panel(spark, sf))


def event_flag_totals(spark, sf):
    return ev.flag_totals(ev.event_table(v.panel(spark, sf)))


def amplitude_bands(spark, sf):
    out = ev.amplitude_events(v.panel(spark, sf))
    return r6(out, "roll_hi", "roll_lo", "roll_mean").select("stock_code", "date", "roll_hi", "roll_lo", "roll_mean", "amp_big", "amp_sml")


def abnormal_measures(spark, sf):
    p = v.panel(spark, sf)
    out = ev.abnormal(ev.abnormal(p, "amp_pct", to="abnormal_amp"), "volume", to="abnormal_vol", missing=0.0)
    return r6(out, "abnormal_amp", "abnormal_vol").select("stock_code", "date", "abnormal_amp", "abnormal_vol")


def hump_events(spark, sf):
    return ev.hump(v.panel(spark, sf)).select("stock_code", "date", "hump_event")


# ---- universe and study ---------------------------------------------------------------------------

UNIVERSE = f"""{v.INDEX_ROWS}, delivered AS (SELECT * FROM panel UNION ALL BY NAME SELECT * FROM index_rows),
  never AS (SELECT * FROM delivered WHERE stock_code NOT IN ('SC300', 'TM100', 'TWN50', 'Y9999')
    AND stock_code NOT IN (SELECT stock_code FROM delivered WHERE full_delivery_y = 'Y')),
  allowed AS (SELECT *, CAST(coalesce(alert_a = 'A', false) AS INTEGER) AS is_attention FROM never WHERE coalesce(disposition_d, '') <> 'D'),
  base AS (SELECT * FROM allowed WHERE stock_code IN (SELECT stock_code FROM allowed GROUP BY stock_code HAVING count(*) >= 252)
    AND coalesce(volume, 0) > 0)"""
WS = "PARTITION BY stock_code ORDER BY date"
STUDY = f"""WITH {v.PANEL}, {UNIVERSE}, {v.MARKET}, {BANDED}, {FLAGGED},
  totals AS (SELECT f.*, coalesce(m.mkt_pct, 0) AS mkt_pct,
      sum(ln(1 + coalesce(return_pct, 0) / 100)) OVER w AS s, sum(ln(1 + coalesce(m.mkt_pct, 0) / 100)) OVER w AS ms,
      sum(coalesce(abnormal_amp, 0)) OVER w AS a, sum(coalesce(abnormal_vol, 0)) OVER w AS vv
    FROM flagged f LEFT JOIN market m ON f.date = m.date
    WINDOW w AS (PARTITION BY stock_code ORDER BY f.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  ahead AS (SELECT *, list(s) OVER w AS ps, list(ms) OVER w AS pm, list(a) OVER w AS pa, list(vv) OVER w AS pv,
      lead(amp_pct, 1) OVER ({WS}) AS amp_1, lead(amp_pct, 20) OVER ({WS}) AS amp_20
    FROM totals WINDOW w AS ({WS} ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING))"""


def _r(h: int) -> str:
    return f"CASE WHEN len(ps) > {h} THEN round(exp(ps[{h + 1}] - ps[1]) - 1, 12) END"


def _x(h: int) -> str:
    return f"CASE WHEN len(ps) > {h} THEN round(exp((ps[{h + 1}] - ps[1]) - (pm[{h + 1}] - pm[1])) - 1, 12) END"


STUDIED = f"""{STUDY}, studied AS (SELECT stock_code, date, amp_pct, market_cap, pe, pb, cash_div, beta, is_attention, roll_hi, roll_lo,
    amp_big, amp_sml, abnormal_amp, abnormal_vol,
    {', '.join(f'{_r(h)} AS fwd_ret_{h}, {_x(h)} AS fwd_exc_{h}' for h in (1, 5, 20))},
    CASE WHEN len(pa) = 21 THEN pa[21] - pa[1] END AS persist_amp, CASE WHEN len(pv) = 21 THEN pv[21] - pv[1] END AS persist_vol,
    CASE WHEN len(ps) = 21 THEN list_min(list_transform(range(1, 22), lambda k:
      (exp(ps[k] - ps[1]) - 1) - list_max(list_transform(ps[1:k], lambda x: exp(x - ps[1]) - 1)))) END AS mdd,
    CAST(coalesce(amp_1 >= amp_pct AND amp_20 < amp_1, false) AS INTEGER) AS hump_event, ps, pm, pa
  FROM ahead)"""


def universe(spark, sf, p: DataFrame | None = None) -> DataFrame:
    return un.apply_universe(v.with_index(spark, sf, p or v.stored_panel(spark, sf)))


def universe_rows(spark, sf):
    return universe(spark, sf).select("stock_code", "date", "is_attention", "volume")


def universe_counts(spark, sf):
    return universe(spark, sf).groupBy("stock_code").agg(F.count(F.lit(1)).alias("days"), F.sum("is_attention").alias("attention_days"))


def market_rows(spark, sf):
    return un.market_series(v.with_index(spark, sf, v.stored_panel(spark, sf)))


#: What a study reads of the panel, and what it only passes on.
READ = ("stock_code", "date", "amp_pct", "return_pct", "volume", "alert_a", "disposition_d", "full_delivery_y")
PASSED = ("market_cap", "pe", "pb", "cash_div", "beta")


def study(spark, sf, *cols: str, p: DataFrame | None = None) -> DataFrame:
    """Study panel with the columns ``cols`` of those it passes on; the others are not stored."""
    p = p or v.stored_panel(spark, sf, *READ, *cols)
    return st.study_panel(universe(spark, sf, p), v.market(p))


STUDY_VALUES = ("fwd_ret_1", "fwd_ret_5", "fwd_ret_20", "fwd_exc_1", "fwd_exc_5", "fwd_exc_20")


def forward_returns(spark, sf):
    out = st.forward_returns(v.panel(spark, sf))
    return r6(out, "fwd_ret_1", "fwd_ret_5", "fwd_ret_20").select("stock_code", "date", "fwd_ret_1", "fwd_ret_5", "fwd_ret_20")


def forward_returns_late_entry(spark, sf):
    out = st.forward_returns(v.panel(spark, sf), entry_lag=1)
    return r6(out, "fwd_ret_1", "fwd_ret_5", "fwd_ret_20").select("stock_code", "date", "fwd_ret_1", "fwd_ret_5", "fwd_ret_20")


def _forward_sql(lag: int) -> str:
    def one(h: int) -> str:
        w = f"(PARTITION BY stock_code ORDER BY date ROWS BETWEEN {1 + lag} FOLLOWING AND {h + lag} FOLLOWING)"
        return f"CASE WHEN count(*) OVER {w} = {h} THEN round(exp(sum(ln(1 + coalesce(return_pct, 0) / 100)) OVER {w}) - 1 + 3.7e-9, 6) + 0.0 END AS fwd_ret_{h}"

    return f"WITH {v.PANEL} SELECT stock_code, date, {', '.join(one(h) for h in (1, 5, 20))} FROM panel"


def study_returns(spark, sf):
    return r6(study(spark, sf), *STUDY_VALUES).select("stock_code", "date", *STUDY_VALUES)


def study_scores(spark, sf):
    return r6(study(spark, sf), "persist_amp", "persist_vol").select("stock_code", "date", "persist_amp", "persist_vol", "hump_event")


def study_drawdown(spark, sf):
    return r6(study(spark, sf), "mdd").select("stock_code", "date", "mdd")


def curves(rows: DataFrame) -> DataFrame:
    long = rows.select("stock_code", "date", F.posexplode(F.arrays_zip("cum_amp", "cum_ret", "cum_exc")).alias("k", "p"))
    return r6(long.select("stock_code", "date", "k", "p.*"), "cum_amp", "cum_ret", "cum_exc")


def study_curves(spark, sf):
    return curves(study(spark, sf).where(F.col("amp_big") == 1))


def study_curves_all(spark, sf):
    return curves(study(spark, sf))


# ---- report tables --------------------------------------------------------------------------------

EVENT_ROWS = f"""{STUDIED}, kinds AS (SELECT *, CASE WHEN amp_big = 1 THEN 'big' ELSE 'sml' END AS kind,
    CASE WHEN amp_big = 1 THEN CASE WHEN roll_hi > 0 THEN (amp_pct - roll_hi) / roll_hi END
      ELSE CASE WHEN roll_lo > 0 THEN (roll_lo - amp_pct) / roll_lo END END AS strength
    FROM studied WHERE amp_big = 1 OR amp_sml = 1),
  cuts AS (SELECT kind, quantile_cont(persist_amp, 0.8) AS persist_cut FROM kinds GROUP BY kind),
  event_rows AS (SELECT kinds.*, persist_cut, CAST(persist_amp >= persist_cut AS INTEGER) AS high FROM kinds JOIN cuts USING (kind))"""
HIGH = "SELECT * FROM event_rows WHERE high IS NOT NULL"
DESCRIBE = """count(value) AS cnt, round(avg(value) * 100 + 3.7e-9, 6) + 0.0 AS mean, round(quantile_cont(value, 0.5) * 100 + 3.7e-9, 6) + 0.0 AS median,
    round(stddev_samp(value) * 100 + 3.7e-9, 6) + 0.0 AS std, round(skewness(value) + 3.7e-9, 6) + 0.0 AS skew, round(kurtosis(value) + 3.7e-9, 6) + 0.0 AS kurt,
    round(quantile_cont(value, 0.1) * 100 + 3.7e-9, 6) + 0.0 AS p10, round(quantile_cont(value, 0.25) * 100 + 3.7e-9, 6) + 0.0 AS p25,
    round(quantile_cont(value, 0.75) * 100 + 3.7e-9, 6) + 0.0 AS p75, round(quantile_cont(value, 0.9) * 100 + 3.7e-9, 6) + 0.0 AS p90,
    round(avg(CAST(value > 0 AS DOUBLE)) * 100 + 3.7e-9, 6) + 0.0 AS win_pct"""
DESCRIBED = ("mean", "median", "std", "skew", "kurt", "p10", "p25", "p75", "p90", "win_pct")
MEASURES = " UNION ALL ".join(f"SELECT kind, '{c}' AS measure, {c} AS value FROM event_rows" for c in (*rp.RETURNS, *rp.EXCESS))


def events(spark, sf, *cols: str) -> DataFrame:
    """Event rows with the columns a report table reads, so that the rest is pruned from the study."""
    base = ("stock_code", "date", "amp_pct", "amp_big", "amp_sml", "roll_hi", "roll_lo", "is_attention", "persist_amp")
    return rp.event_rows(study(spark, sf, *[c for c in cols if c in PASSED]).select(*base, *cols))


def event_summary(spark, sf):
    return r6(rp.event_summary(events(spark, sf, "mdd")), "mdd_mean_pct")


def return_stats(spark, sf):
    return r6(rp.return_stats(events(spark, sf, *rp.RETURNS, *rp.EXCESS)), *DESCRIBED)


def return_histograms(spark, sf):
    # A value within rounding of a bin edge may fall on either side, so counts are compared on 5-decimal values.
    ev_rows = events(spark, sf, *rp.RETURNS, *rp.EXCESS)
    ev_rows = ev_rows.withColumns({c: trimmed(F.col(c) + 3.7e-9, 5) for c in (*rp.RETURNS, *rp.EXCESS)})
    return r6(rp.return_histograms(ev_rows, bins=60), "lo", "hi", "mean")


def persistence_stats(spark, sf):
    return r6(rp.persistence_stats(events(spark, sf, "fwd_exc_20")), *DESCRIBED)


def persistence_boxes(spark, sf):
    return r6(rp.persistence_boxes(events(spark, sf, "fwd_exc_20")), "q1", "median", "q3", "lo", "hi", "whisker_lo", "whisker_hi")


def persistence_curves(spark, sf):
    return r6(rp.persistence_curves(events(spark, sf, *rp.CURVES)), "p25", "median", "p75")


def attention_stats(spark, sf):
    return r6(rp.attention_stats(events(spark, sf, "fwd_exc_20")), *DESCRIBED)


def feature_thirds(spark, sf):
    return r6(rp.feature_thirds(events(spark, sf, "fwd_ret_20", "market_cap", "pe", "pb", "cash_div", "beta")), *DESCRIBED)


def persistence_compare(spark, sf):
    out = rp.persistence_compare(events(spark, sf, "market_cap", "beta"))
    return r6(out, "mean_hi", "median_hi", "mean_lo", "median_lo", "u", "z", "p_value")


RANKED = ("u", "z", "p_value")


def rank_sums_by_security(spark, sf):
    """Rank-sum tests of small groups, most of them with exact p: days of strong moves against others, per security and quarter."""
    rows = v.panel(spark, sf).select("stock_code", F.date_trunc("quarter", "date").cast("date").alias("quarter"), "amp_pct", (F.abs("return_pct") >= 4).cast("int").alias("strong"))
    return r6(mann_whitney(rows, "amp_pct", "strong", ["stock_code", "quarter"]).where("n1 > 0 AND n0 > 0"), *RANKED)


LOGIT_VALUES = ("coef", "std_err", "z", "p_value", "ci_lo", "ci_hi", "pseudo_r2")


def persistence_logit(spark, sf):
    return r6(rp.persistence_logit(events(spark, sf, "market_cap", "beta")), *LOGIT_VALUES)


def round_return_histograms(spark, sf):
    rows = events(spark, sf, *rp.RETURNS, *rp.EXCESS)
    rows = rows.withColumns({c: trimmed(F.col(c) + 3.7e-9, 5) for c in (*rp.RETURNS, *rp.EXCESS)})  # as in return_histograms
    return r6(rp.round_return_histograms(rows), "mean", "width", "lo", "hi")


def large_group_quantiles(spark, sf):
    """Quantiles of groups of all sizes, among them all line items in one group."""
    rows = v.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"))
    every = rows.withColumn("l_returnflag", F.lit("all"))
    marks = quantiles(materialize(rows.unionByName(every), "prices"), ["l_returnflag"], "price", [0.001, 0.1, 0.5, 0.9, 0.999], ["p01", "p10", "p50", "p90", "p99"], most_held=1000)
    return r6(marks, "p01", "p10", "p50", "p90", "p99")


def persistent_overlap(spark, sf):
    return r6(rp.overlap_of_persistent(events(spark, sf)), "jaccard", "pct_of_a", "pct_of_b")


REPORT_PARTS = {
    "event_summary": ("kind",), "return_stats": ("kind", "measure"), "persistence_stats": ("kind", "high"), "persistence_boxes": ("kind", "high"),
    "persistence_curves": ("kind", "high", "curve", "k"), "persistence_compare": ("kind", "feature"), "persistence_logit": ("kind", "variable"),
    "attention_stats": ("kind", "is_attention"), "feature_thirds": ("kind", "feature", "bucket"),
}


def full_report(spark, sf):
    """All tables of the report as one long table, but for the histograms, whose edges are compared on their own."""
    p = v.stored_panel(spark, sf)
    rows = materialize(v.index_rows(spark, sf, p), "index")
    tables = rp.full_report(study(spark, sf, p=p), rows)
    tables.pop("return_histograms")
    return r6(rp.report_rows(tables), "value")


def big_events(spark, sf) -> DataFrame:
    rows = study(spark, sf).where(F.col("amp_big") == 1).select("stock_code", "date", "persist_amp")
    return materialize(rows, "big-events")


BIG = f"""{STUDIED}, big AS (SELECT stock_code, date, persist_amp FROM studied WHERE amp_big = 1),
  marked AS (SELECT *, CAST(coalesce(persist_amp >= (SELECT quantile_cont(persist_amp, 0.8) FROM big), false) AS INTEGER) AS high_persist FROM big),
  earlier AS (SELECT *, count(*) OVER w AS n, coalesce(sum(high_persist) OVER w, 0) AS hi, avg(high_persist) OVER w AS share,
      row_number() OVER (PARTITION BY stock_code ORDER BY date DESC) AS rn
    FROM marked WINDOW w AS (PARTITION BY stock_code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  prob AS (SELECT stock_code, round(share, 4) AS stock_persist_prob, CAST(hi AS BIGINT) AS stock_persist_hi_n, n AS stock_persist_amp_n
    FROM earlier WHERE rn = 1 AND n >= 5)"""


def persistence_probability(spark, sf):
    return st.persistence_probability(big_events(spark, sf))


def running_probability(spark, sf):
    out = st.running_probability(big_events(spark, sf))
    return r6(out, "persist_prob").select("stock_code", "date", "high_persist", "persist_prob")


def persistence_merged(spark, sf):
    p = v.panel(spark, sf).select("stock_code", "date", F.lit(0.0).alias("stock_persist_prob"))
    return st.merge_back(p, st.persistence_probability(big_events(spark, sf)))


# ---- market ---------------------------------------------------------------------------------------

BREADTH = f"""{STUDIED}, days AS (SELECT date, CAST(sum(amp_big) AS BIGINT) AS amp_big_cnt, CAST(sum(amp_sml) AS BIGINT) AS amp_sml_cnt,
    count(*) AS total_cnt, sum(amp_big) / count(*) AS amp_big_pct, sum(amp_sml) / count(*) AS amp_sml_pct FROM studied GROUP BY date),
  bands AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN round(quantile_cont(amp_big_pct, 0.9) OVER w, 9) END AS mkt_hi90,
    CASE WHEN count(*) OVER w = 20 THEN round(quantile_cont(amp_big_pct, 0.1) OVER w, 9) END AS mkt_lo10,
    CASE WHEN count(*) OVER w = 20 THEN round(quantile_cont(amp_sml_pct, 0.9) OVER w, 9) END AS mkt_sml_hi90,
    CASE WHEN count(*) OVER w = 20 THEN round(quantile_cont(amp_sml_pct, 0.1) OVER w, 9) END AS mkt_sml_lo10
    FROM days WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  breadth AS (SELECT *, CAST(coalesce(round(amp_big_pct, 9) > mkt_hi90, false) AS INTEGER) AS mkt_amp_hi,
    CAST(coalesce(round(amp_big_pct, 9) < mkt_lo10, false) AS INTEGER) AS mkt_amp_lo FROM bands)"""
BREADTH_VALUES = ("amp_big_pct", "amp_sml_pct", "mkt_hi90", "mkt_lo10", "mkt_sml_hi90", "mkt_sml_lo10")


def breadth(spark, sf) -> DataFrame:
    return mk.market_breadth(study(spark, sf))


def market_breadth(spark, sf):
    return r6(breadth(spark, sf), *BREADTH_VALUES)


def _after(flag: str):
    def run(spark, sf):
        rows = materialize(v.index_rows(spark, sf, v.stored_panel(spark, sf)), "index")
        return r6(mk.index_after_events(materialize(breadth(spark, sf), "breadth"), rows, flag), *DESCRIBED)

    return run


def _after_sql(flag: str) -> str:
    def fwd(h: int) -> str:
        w = f"(PARTITION BY stock_code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
        return f"CASE WHEN count(*) OVER {w} = {h} THEN round(exp(sum(ln(1 + coalesce(return_pct, 0) / 100)) OVER {w}) - 1, 12) END AS fwd_ret_{h}"

    return f"""{BREADTH}, fwd AS (SELECT stock_code, date, {', '.join(fwd(h) for h in (1, 5, 20))} FROM index_rows),
      hit AS (SELECT * FROM fwd WHERE date IN (SELECT date FROM breadth WHERE {flag} = 1)),
      enough AS (SELECT * FROM hit WHERE stock_code IN (SELECT stock_code FROM hit GROUP BY stock_code HAVING count(*) >= 3)),
      long AS ({' UNION ALL '.join(f"SELECT stock_code, 'fwd_ret_{h}' AS horizon, fwd_ret_{h} AS value FROM enough" for h in (1, 5, 20))})
      SELECT stock_code, horizon, {DESCRIBE} FROM long WHERE value IS NOT NULL GROUP BY stock_code, horizon HAVING count(*) >= 5"""


def _r6sql(*cols: str) -> str:
    return ", ".join(f"round({c} + 3.7e-9, 6) + 0.0 AS {c}" for c in cols)


THIRDS = " UNION ALL ".join(
    f"SELECT kind, '{c}' AS feature, {c} AS x, fwd_ret_20 AS value FROM event_rows WHERE {c} IS NOT NULL AND fwd_ret_20 IS NOT NULL"
    for c in ("market_cap", "pe", "pb", "cash_div", "beta")
)
FEATURES = " UNION ALL ".join(
    f"SELECT kind, high, '{n}' AS feature, CAST({x} AS DOUBLE) AS value FROM event_rows WHERE high IS NOT NULL AND {x} IS NOT NULL"
    for n, x in {"market_cap": "market_cap", "beta": "nullif(beta, 0)", "is_attention": "is_attention", "strength": "strength"}.items()
)
HIST = " UNION ALL ".join(
    f"SELECT kind, '{c}' AS measure, round({c} + 3.7e-9, 5) * 100 AS value FROM event_rows WHERE {c} IS NOT NULL" for c in (*rp.RETURNS, *rp.EXCESS)
)
CURVE_ROWS = " UNION ALL ".join(
    f"SELECT kind, high, '{n}' AS curve, k - 1 AS k, {x} AS value FROM ev, (SELECT unnest(range(1, 22)) AS k) WHERE len(ps) >= k"
    for n, x in {
        "cum_amp": "pa[k] - pa[1]", "cum_ret": "(exp(ps[k] - ps[1]) - 1) * 100", "cum_exc": "(exp((ps[k] - ps[1]) - (pm[k] - pm[1])) - 1) * 100",
    }.items()
)

LOGIT_X = ("log_mcap", "beta", "is_attention", "strength", "const")
LOGIT_STEPS = 9


def _logit_sql() -> str:
    """Newton steps as chained tables: each has the coefficients per kind, from all rows' weighted cross-products under the ones before."""
    k = len(LOGIT_X)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    eta = " + ".join(f"b{i} * x{i}" for i in range(k))
    parts = [f"""logit_rows AS MATERIALIZED (SELECT kind, CAST(coalesce(persist_amp >= persist_cut, false) AS DOUBLE) AS y, ln(1 + greatest(coalesce(market_cap, 0), 0)) AS x0,
    nullif(beta, 0) AS x1, CAST(coalesce(is_attention, 0) AS DOUBLE) AS x2, strength AS x3, 1.0 AS x4 FROM event_rows WHERE nullif(beta, 0) IS NOT NULL AND strength IS NOT NULL)""",
             f"b_0 AS (SELECT kind, {', '.join(f'0.0 AS b{i}' for i in range(k))} FROM logit_rows GROUP BY kind HAVING count(*) >= 50 AND min(y) < max(y))"]
    units = tuple(f"u{i}" for i in range(k))
    for n in range(LOGIT_STEPS + 1):
        last = n == LOGIT_STEPS
        sums = ", ".join([f"sum(p * (1 - p) * x{i} * x{j}) AS a_{i}_{j}" for i, j in pairs] + [f"sum((y - p) * x{i}) AS t_{i}" for i in range(k)])
        unit = "".join(f", {1.0 if i == j else 0.0} AS u{i}_{j}" for i in range(k) for j in range(k)) if last else ""
        parts.append(f"p_{n} AS (SELECT r.*, {eta} AS eta, 1 / (1 + exp(-({eta}))) AS p FROM logit_rows AS r JOIN b_{n} USING (kind))")
        parts.append(f"s_{n} AS MATERIALIZED (SELECT kind, {sums}{unit}, count(*) AS n, avg(y) AS share, sum(y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))) AS fit FROM p_{n} GROUP BY kind)")
        if not last:
            parts.append(solved(f"s_{n}", k, ["kind"], prefix=f"e{n}"))
            parts.append(f"b_{n + 1} AS MATERIALIZED (SELECT kind, {', '.join(f'b{i} + x_t_{i} AS b{i}' for i in range(k))} FROM b_{n} JOIN e{n}_done USING (kind))")
    parts.append(solved(f"s_{LOGIT_STEPS}", k, ["kind"], units, prefix="inv"))
    rows = " UNION ALL ".join(f"SELECT kind, '{name}' AS variable, b{i} AS coef, sqrt(x_u{i}_{i}) AS std_err FROM b_{LOGIT_STEPS} JOIN inv_done USING (kind)" for i, name in enumerate(LOGIT_X))
    parts.append(f"coefs AS (SELECT *, coef / std_err AS z, coef - 1.959963984540054 * std_err AS ci_lo, coef + 1.959963984540054 * std_err AS ci_hi FROM ({rows}))")
    parts.append(f"""named AS (SELECT coefs.*, n, {normal_p('z')} AS p_value, 1 - fit / (n * (share * ln(share) + (1 - share) * ln(1 - share))) AS pseudo_r2
    FROM coefs JOIN s_{LOGIT_STEPS} USING (kind))""")
    return f"""{EVENT_ROWS}, {', '.join(parts)}
        SELECT kind, variable, {_r6sql(*LOGIT_VALUES)}, n, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars FROM named"""


#: Exact p by counting: in how many ways k of the first r ranks have a given sum.
RANK_SUMS = f"""WITH RECURSIVE {v.PANEL}, long AS (SELECT stock_code, date_trunc('quarter', date) AS quarter, amp_pct AS value, CAST(abs(return_pct) >= 4 AS INTEGER) AS g
    FROM panel WHERE amp_pct IS NOT NULL AND return_pct IS NOT NULL),
  ranked AS (SELECT *, rank() OVER (PARTITION BY stock_code, quarter ORDER BY value) + (count(*) OVER (PARTITION BY stock_code, quarter, value) - 1) / 2.0 AS rk FROM long),
  ties AS (SELECT stock_code, quarter, sum(c * c * c - c) AS t FROM (SELECT stock_code, quarter, value, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY ALL) GROUP BY ALL),
  us AS (SELECT stock_code, quarter, CAST(sum(g) AS BIGINT) AS n1, CAST(sum(1 - g) AS BIGINT) AS n0, sum(rk) FILTER (g = 1) - sum(g) * (sum(g) + 1) / 2.0 AS u, any_value(t) AS t
    FROM ranked JOIN ties USING (stock_code, quarter) GROUP BY stock_code, quarter HAVING sum(g) > 0 AND sum(1 - g) > 0),
  zs AS (SELECT *, greatest(abs(u - n1 * n0 / 2.0) - 0.5, 0) / nullif(sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1.0)))), 0) AS z FROM us),
  ways(r, k, s, c) AS (SELECT 0, 0, 0, CAST(1 AS HUGEINT) UNION ALL
    SELECT r + 1, k + d, s + d * (r + 1), CAST(sum(c) AS HUGEINT) FROM ways, (VALUES (0), (1)) AS t(d) WHERE r < 90 AND k + d <= 8 GROUP BY ALL),
  exact AS (SELECT stock_code, quarter, 2.0 * CAST(sum(c) FILTER (s >= k * (k + 1) / 2 + greatest(u, n1 * n0 - u)) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS p
    FROM zs JOIN ways ON r = n1 + n0 AND k = least(n1, n0) WHERE t = 0 AND least(n1, n0) <= 8 GROUP BY stock_code, quarter)"""
RANK_SUMS_BY_SECURITY = f"""{RANK_SUMS}, found AS (SELECT stock_code, CAST(quarter AS DATE) AS quarter, n1, n0, u, z, CASE WHEN t = 0 AND least(n1, n0) <= 8 THEN least(p, 1.0) ELSE {normal_p('z')} END AS p_value
  FROM zs LEFT JOIN exact USING (stock_code, quarter)) SELECT stock_code, quarter, n1, n0, {', '.join(f'round({c} + 3.7e-9, 6) + 0.0 AS {c}' for c in ('u', 'z', 'p_value'))} FROM found"""

QUERIES = {
    "event_table": event_table,
    "event_flag_totals": event_flag_totals,
    "amplitude_bands": amplitude_bands,
    "abnormal_measures": abnormal_measures,
    "hump_events": hump_events,
    "universe_rows": universe_rows,
    "universe_counts": universe_counts,
    "market_rows": market_rows,
    "forward_returns": forward_returns,
    "forward_returns_late_entry": forward_returns_late_entry,
    "study_returns": study_returns,
    "study_scores": study_scores,
    "study_drawdown": study_drawdown,
    "study_curves": study_curves,
    "study_curves_all": study_curves_all,
    "event_summary": event_summary,
    "return_stats": return_stats,
    "return_histograms": return_histograms,
    "persistence_stats": persistence_stats,
    "persistence_boxes": persistence_boxes,
    "persistence_curves": persistence_curves,
    "attention_stats": attention_stats,
    "feature_thirds": feature_thirds,
    "persistence_compare": persistence_compare,
    "persistence_logit": persistence_logit,
    "rank_sums_by_security": rank_sums_by_security,
    "round_return_histograms": round_return_histograms,
    "large_group_quantiles": large_group_quantiles,
    "persistent_overlap": persistent_overlap,
    "full_report": full_report,
    "persistence_probability": persistence_probability,
    "running_probability": running_probability,
    "persistence_merged": persistence_merged,
    "market_breadth": market_breadth,
    "index_after_wide_days": _after("mkt_amp_hi"),
    "index_after_calm_days": _after("mkt_amp_lo"),
}

SQL = {
    "event_table": f"{EVENT_TABLE} SELECT * FROM event_table",
    "event_flag_totals": f"""{EVENT_TABLE} SELECT count(*) AS rows, CAST(sum(attention_a) AS BIGINT) AS attention_a,
        CAST(sum(disposition_d) AS BIGINT) AS disposition_d, CAST(sum(full_delivery_y) AS BIGINT) AS full_delivery_y,
        CAST(sum(amp_big) AS BIGINT) AS amp_big, CAST(sum(amp_sml) AS BIGINT) AS amp_sml FROM event_table""",
    "amplitude_bands": f"WITH {v.PANEL}, base AS (SELECT * FROM panel), {BANDED}, {FLAGGED} SELECT stock_code, date, {_r6sql('roll_hi', 'roll_lo', 'roll_mean')}, amp_big, amp_sml FROM flagged",
    "abnormal_measures": f"WITH {v.PANEL}, base AS (SELECT * FROM panel), {BANDED}, {FLAGGED} SELECT stock_code, date, {_r6sql('abnormal_amp', 'abnormal_vol')} FROM flagged",
    "hump_events": f"""WITH {v.PANEL}, a AS (SELECT *, lead(amp_pct, 1) OVER ({WS}) AS x, lead(amp_pct, 20) OVER ({WS}) AS y FROM panel)
        SELECT stock_code, date, CAST(coalesce(x >= amp_pct AND y < x, false) AS INTEGER) AS hump_event FROM a""",
    "universe_rows": f"WITH {v.PANEL}, {UNIVERSE} SELECT stock_code, date, is_attention, volume FROM base",
    "universe_counts": f"WITH {v.PANEL}, {UNIVERSE} SELECT stock_code, count(*) AS days, CAST(sum(is_attention) AS BIGINT) AS attention_days FROM base GROUP BY stock_code",
    "market_rows": f"WITH {v.PANEL}, {v.MARKET} SELECT date, mkt_pct FROM market",
    "forward_returns": _forward_sql(0),
    "forward_returns_late_entry": _forward_sql(1),
    "study_returns": f"{STUDIED} SELECT stock_code, date, {_r6sql(*STUDY_VALUES)} FROM studied",
    "study_scores": f"{STUDIED} SELECT stock_code, date, {_r6sql('persist_amp', 'persist_vol')}, hump_event FROM studied",
    "study_drawdown": f"{STUDIED} SELECT stock_code, date, {_r6sql('mdd')} FROM studied",
    "study_curves": f"""{STUDIED} SELECT stock_code, date, CAST(k - 1 AS INTEGER) AS k, round(pa[k] - pa[1] + 3.7e-9, 6) + 0.0 AS cum_amp, round(exp(ps[k] - ps[1]) - 1 + 3.7e-9, 6) + 0.0 AS cum_ret,
        round(exp((ps[k] - ps[1]) - (pm[k] - pm[1])) - 1 + 3.7e-9, 6) + 0.0 AS cum_exc FROM studied, (SELECT unnest(range(1, 22)) AS k) WHERE amp_big = 1""",
    "study_curves_all": f"""{STUDIED} SELECT stock_code, date, CAST(k - 1 AS INTEGER) AS k, round(pa[k] - pa[1] + 3.7e-9, 6) + 0.0 AS cum_amp, round(exp(ps[k] - ps[1]) - 1 + 3.7e-9, 6) + 0.0 AS cum_ret,
        round(exp((ps[k] - ps[1]) - (pm[k] - pm[1])) - 1 + 3.7e-9, 6) + 0.0 AS cum_exc FROM studied, (SELECT unnest(range(1, 22)) AS k)""",
    "event_summary": f"""{EVENT_ROWS} SELECT kind, count(*) AS events, count(DISTINCT stock_code) AS securities, min(date) AS min_date, max(date) AS max_date,
        CAST(sum(is_attention) AS BIGINT) AS attention, round(avg(mdd) * 100 + 3.7e-9, 6) + 0.0 AS mdd_mean_pct FROM event_rows GROUP BY kind""",
    "return_stats": f"{EVENT_ROWS}, long AS ({MEASURES}) SELECT kind, measure, {DESCRIBE} FROM long WHERE value IS NOT NULL GROUP BY kind, measure",
    "return_histograms": f"""{EVENT_ROWS}, long AS ({HIST}), span AS (SELECT kind, measure, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM long GROUP BY kind, measure)
        SELECT kind, measure, {_r6sql('lo', 'hi', 'mean')}, coalesce(least(CAST(floor((value - lo) / nullif(hi - lo, 0) * 60) AS INTEGER) + 1, 60), 1) AS bin, count(*) AS cnt
        FROM long JOIN span USING (kind, measure) GROUP BY ALL""",
    "persistence_stats": f"{EVENT_ROWS}, long AS (SELECT kind, high, fwd_exc_20 AS value FROM ({HIGH})) SELECT kind, high, {DESCRIBE} FROM long WHERE value IS NOT NULL GROUP BY kind, high",
    "persistence_boxes": f"""{EVENT_ROWS}, long AS (SELECT kind, high, fwd_exc_20 * 100 AS value FROM ({HIGH}) WHERE fwd_exc_20 IS NOT NULL),
        box AS (SELECT kind, high, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY kind, high)
        SELECT kind, high, count(*) AS cnt, {_r6sql('q1', 'median', 'q3')}, round(min(value) + 3.7e-9, 6) + 0.0 AS lo, round(max(value) + 3.7e-9, 6) + 0.0 AS hi,
        round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) + 3.7e-9, 6) + 0.0 AS whisker_lo, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) + 3.7e-9, 6) + 0.0 AS whisker_hi
        FROM long JOIN box USING (kind, high) GROUP BY kind, high, q1, median, q3""",
    "persistence_curves": f"""{EVENT_ROWS}, ev AS ({HIGH}), long AS ({CURVE_ROWS})
        SELECT kind, high, curve, CAST(k AS INTEGER) AS k, count(*) AS cnt, round(quantile_cont(value, 0.25) + 3.7e-9, 6) + 0.0 AS p25, round(quantile_cont(value, 0.5) + 3.7e-9, 6) + 0.0 AS median,
        round(quantile_cont(value, 0.75) + 3.7e-9, 6) + 0.0 AS p75 FROM long GROUP BY kind, high, curve, k""",
    "attention_stats": f"""{EVENT_ROWS}, long AS (SELECT kind, is_attention, fwd_exc_20 AS value FROM event_rows)
        SELECT kind, is_attention, {DESCRIBE} FROM long WHERE value IS NOT NULL GROUP BY kind, is_attention""",
    "feature_thirds": f"""{EVENT_ROWS}, long AS ({THIRDS}), edges AS (SELECT kind, feature, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM long GROUP BY kind, feature HAVING count(*) >= 30)
        SELECT kind, feature, CASE WHEN x > hi THEN 'high' WHEN x < lo THEN 'low' ELSE 'middle' END AS bucket, {DESCRIBE} FROM long JOIN edges USING (kind, feature) GROUP BY 1, 2, 3""",
    "persistence_compare": f"""{EVENT_ROWS}, long AS ({FEATURES}),
        ranked AS (SELECT *, rank() OVER (PARTITION BY kind, feature ORDER BY value) + (count(*) OVER (PARTITION BY kind, feature, value) - 1) / 2.0 AS rk FROM long),
        ties AS (SELECT kind, feature, sum(c * c * c - c) AS t FROM (SELECT kind, feature, value, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY ALL) GROUP BY ALL),
        tot AS (SELECT kind, feature, count(*) FILTER (high = 1) AS n_hi, count(*) FILTER (high = 0) AS n_lo, avg(value) FILTER (high = 1) AS mean_hi,
          quantile_cont(value, 0.5) FILTER (high = 1) AS median_hi, avg(value) FILTER (high = 0) AS mean_lo, quantile_cont(value, 0.5) FILTER (high = 0) AS median_lo,
          sum(rk) FILTER (high = 1) AS r1 FROM ranked GROUP BY kind, feature),
        us AS (SELECT *, CAST(n_hi AS DOUBLE) AS a, CAST(n_lo AS DOUBLE) AS b, r1 - CAST(n_hi AS DOUBLE) * (n_hi + 1) / 2 AS u FROM tot JOIN ties USING (kind, feature)),
        zs AS (SELECT *, greatest(abs(u - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * ((a + b + 1) - t / ((a + b) * (a + b - 1)))) AS z FROM us WHERE n_hi >= 5 AND n_lo >= 5),
        ps AS (SELECT *, {normal_p('z')} AS p_value FROM zs)
        SELECT kind, feature, n_hi, n_lo, {_r6sql('mean_hi', 'median_hi', 'mean_lo', 'median_lo', 'u', 'z', 'p_value')},
        CASE WHEN z > 3.290526731 THEN '***' WHEN z > 2.575829304 THEN '**' WHEN z > 1.959963985 THEN '*' ELSE '' END AS stars FROM ps""",
    "persistence_logit": _logit_sql(),
    "rank_sums_by_security": RANK_SUMS_BY_SECURITY,
    "round_return_histograms": f"""{EVENT_ROWS}, long AS ({HIST}), span AS (SELECT kind, measure, min(value) AS least, max(value) AS most, avg(value) AS mean FROM long GROUP BY kind, measure),
        sized AS (SELECT *, [w FOR w IN [{', '.join(repr(w) for w in WIDTHS)}] IF floor(most / w) - floor(least / w) < 60][1] AS width FROM span),
        placed AS (SELECT kind, measure, mean, CAST(width AS DOUBLE) AS width, floor(value / CAST(width AS DOUBLE)) AS bin FROM long JOIN sized USING (kind, measure))
        SELECT kind, measure, {_r6sql('mean', 'width')}, round(bin * width + 3.7e-9, 6) + 0.0 AS lo, round((bin + 1) * width + 3.7e-9, 6) + 0.0 AS hi, count(*) AS cnt FROM placed GROUP BY kind, measure, mean, width, bin""",
    "large_group_quantiles": """WITH long AS (SELECT l_returnflag, l_extendedprice AS price FROM lineitem UNION ALL SELECT 'all', l_extendedprice FROM lineitem)
        SELECT l_returnflag, count(price) AS n, """ + ", ".join(f"round(quantile_cont(price, {p}) + 3.7e-9, 6) + 0.0 AS {n}" for p, n in ((0.001, "p01"), (0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.999, "p99"))) + " FROM long GROUP BY l_returnflag",
    "persistent_overlap": f"""{EVENT_ROWS}, m AS (SELECT stock_code, max(CAST(high = 1 AND kind = 'big' AS INTEGER)) AS a, max(CAST(high = 1 AND kind = 'sml' AS INTEGER)) AS b FROM event_rows GROUP BY stock_code),
        s AS (SELECT CAST(sum(coalesce(a, 0)) AS BIGINT) AS n_a, CAST(sum(coalesce(b, 0)) AS BIGINT) AS n_b, CAST(sum(coalesce(a, 0) * coalesce(b, 0)) AS BIGINT) AS n_both, CAST(sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS BIGINT) AS n_any FROM m)
        SELECT *, round(n_both / n_any + 3.7e-9, 6) AS jaccard, round(n_both / n_a * 100 + 3.7e-9, 6) AS pct_of_a, round(n_both / n_b * 100 + 3.7e-9, 6) AS pct_of_b FROM s""",
    "persistence_probability": f"{BIG} SELECT * FROM prob",
    "running_probability": f"{BIG} SELECT stock_code, date, high_persist, CASE WHEN n >= 5 THEN round(share + 3.7e-9, 6) + 0.0 END AS persist_prob FROM earlier",
    "persistence_merged": f"{BIG} SELECT stock_code, panel.date, stock_persist_prob, stock_persist_hi_n, stock_persist_amp_n FROM panel LEFT JOIN prob USING (stock_code)",
    "market_breadth": f"{BREADTH} SELECT date, amp_big_cnt, amp_sml_cnt, total_cnt, {_r6sql(*BREADTH_VALUES)}, mkt_amp_hi, mkt_amp_lo FROM breadth",
    "index_after_wide_days": _after_sql("mkt_amp_hi"),
    "index_after_calm_days": _after_sql("mkt_amp_lo"),
}


def _report_sql() -> str:
    """The SQL of the single tables, put into one long form."""
    parts, unions = [], []
    index = {f"index_after_{flag}": (SQL[name], ("stock_code", "horizon")) for flag, name in (("mkt_amp_hi", "index_after_wide_days"), ("mkt_amp_lo", "index_after_calm_days"))}
    single = {name: (SQL[name], keys) for name, keys in REPORT_PARTS.items()}
    rest = {"overlap": (SQL["persistent_overlap"], ()), "market_amplitude": (f"{BREADTH} SELECT strftime(date, '%Y-%m-%d') AS date, {_r6sql('amp_big_pct', 'mkt_hi90', 'mkt_lo10')} FROM breadth", ("date",))}
    for name, (sql, keys) in (single | rest | index).items():
        parts.append(f"t_{name} AS MATERIALIZED ({sql})")
        item = " || ' ' || ".join(f"coalesce(CAST({k} AS VARCHAR), '-')" for k in sorted(keys, key=rp.REPORT_KEYS.index)) or "''"
        unions += [f"SELECT '{name}' AS section, {item} AS item, '{c}' AS value_name, CAST({c} AS DOUBLE) AS value FROM t_{name}" for c in REPORT_VALUES[name]]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(unions)}"


REPORT_VALUES = {
    "event_summary": ("events", "securities", "attention", "mdd_mean_pct"), "persistence_boxes": ("cnt", "q1", "median", "q3", "lo", "hi", "whisker_lo", "whisker_hi"),
    "persistence_curves": ("cnt", "p25", "median", "p75"), "persistence_compare": ("n_hi", "n_lo", "mean_hi", "median_hi", "mean_lo", "median_lo", *RANKED),
    "persistence_logit": (*LOGIT_VALUES, "n"), "overlap": ("n_a", "n_b", "n_both", "n_any", "jaccard", "pct_of_a", "pct_of_b"), "market_amplitude": ("amp_big_pct", "mkt_hi90", "mkt_lo10"),
}
REPORT_VALUES |= {n: ("cnt", *DESCRIBED) for n in ("return_stats", "persistence_stats", "attention_stats", "feature_thirds", "index_after_mkt_amp_hi", "index_after_mkt_amp_lo")}
SQL["full_report"] = _report_sql()
