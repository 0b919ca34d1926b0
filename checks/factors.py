"""Momentum, characteristics, factor returns and loadings: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.solve import solved
from checks.study import _r6sql, r6
from finpanel.operators.keys import as_of
from finpanel.plans import factors as fa
from finpanel.plans import loadings as lo
from finpanel.session import materialize

# The smaller test tables have few securities per day, so the cross-section minimums are lowered.
MINIMUMS = {"min_names": 10, "min_clean": 8, "min_sort": 5}


def _growth_sql(name: str, first: int, last: int) -> str:
    w = f"(PARTITION BY stock_code ORDER BY date ROWS BETWEEN {-first} PRECEDING AND {-last} PRECEDING)"
    return f"CASE WHEN count(return_pct) OVER {w} > 0 THEN round((product(1 + return_pct / 100) OVER {w} - 1) * 100, 9) END AS {name}"


MOMENTUM = f"WITH {v.PANEL}, moved AS (SELECT *, {_growth_sql('mom', -231, -22)}, {_growth_sql('rev', -21, -1)} FROM panel WHERE regexp_matches(stock_code, '^[0-9]{{4}}'))"


def momentum(spark, sf):
    return r6(fa.with_momentum(v.panel(spark, sf)), "mom", "rev").select("stock_code", "date", "mom", "rev")


def characteristics(spark, sf):
    return r6(fa.characteristics(v.panel(spark, sf)), "bm", "ep", "mom", "rev")


def risk_free(spark, sf):
    return r6(fa.risk_free(v.rates(spark, sf)), "rf_pct")


def risk_free_as_of(spark, sf):
    days = v.market(v.panel(spark, sf))
    return r6(as_of(days, fa.risk_free(v.rates(spark, sf)), "rf_pct"), "rf_pct")


def sort_rows(spark, sf):
    return materialize(fa.sort_input(v.panel(spark, sf)), "sort-rows")


def sort_breakpoints(spark, sf):
    cuts = fa.breakpoints(sort_rows(spark, sf).where("usable"))
    return r6(cuts, "lo", "mid", "hi")


LEGS = ("s_h", "s_m", "s_l", "b_h", "b_m", "b_l", "ep_h", "ep_l", "dy_h", "dy_l", "mom_h", "mom_l", "rev_h", "rev_l")


def portfolio_legs(spark, sf):
    rows = sort_rows(spark, sf)
    return r6(fa.portfolio_legs(rows, fa.breakpoints(rows.where("usable")), **MINIMUMS), *LEGS)


def factor_returns(spark, sf, p=None):
    p = p or v.stored_panel(spark, sf)
    return fa.factor_returns(p, v.market(p), v.rates(spark, sf), **MINIMUMS)


def single_factor_beta(spark, sf):
    """Betas on the market alone, which SQL can check."""
    p = v.stored_panel(spark, sf)
    factors = materialize(v.market(p).select("date", F.col("mkt_pct").alias("mkt")), "factors")
    out = lo.rolling_betas(p, factors, names=["mkt"])
    return r6(out, "beta_mkt")


def rolling_betas(spark, sf):
    p = v.stored_panel(spark, sf)
    out = lo.rolling_betas(p, materialize(factor_returns(spark, sf, p), "factors"))
    return r6(out, *[f"beta_{n}" for n in fa.FACTORS])


def characteristics_with_betas(spark, sf):
    p = v.stored_panel(spark, sf)
    out = lo.characteristics_with_betas(p, materialize(factor_returns(spark, sf, p), "factors"))
    return r6(out, "bm", "ep", "mom", "rev", *[f"beta_{n}" for n in fa.FACTORS])


RF = f"{v.RATES}, rf AS (SELECT date, avg(rate_1y) AS rf_pct FROM rates WHERE rate_1y > 0 GROUP BY date)"
SORTED = f"""{MOMENTUM}, rows_ AS (SELECT date, return_pct, market_cap, mom, rev, 1 / nullif(pb, 0) AS bm,
    CASE WHEN nullif(pe, 0) IS NOT NULL THEN least(1 / pe, 1.0) END AS ep, coalesce(div_yield, cash_div, 0) AS dy,
    return_pct IS NOT NULL AND coalesce(market_cap, 0) >= 100 AS usable FROM moved),
  long AS (SELECT date, 'size' AS feature, market_cap AS value FROM rows_ WHERE usable UNION ALL SELECT date, 'bm', bm FROM rows_ WHERE usable
    UNION ALL SELECT date, 'ep', CASE WHEN ep > 0 THEN ep END FROM rows_ WHERE usable UNION ALL SELECT date, 'dy', CASE WHEN dy > 0 THEN dy END FROM rows_ WHERE usable
    UNION ALL SELECT date, 'mom', mom FROM rows_ WHERE usable UNION ALL SELECT date, 'rev', rev FROM rows_ WHERE usable),
  cuts AS (SELECT date, feature, count(value) AS n, quantile_cont(value, 0.3) AS lo, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.7) AS hi
    FROM long WHERE value IS NOT NULL GROUP BY date, feature)"""


def _cut(f: str, q: str, least: int) -> str:
    return f"max({q}) FILTER (feature = '{f}' AND n >= {least}) AS {f}_{q}"


def _is(f: str, side: str) -> str:
    return f"coalesce({f} {'>=' if side == 'h' else '<='} {f}_{'hi' if side == 'h' else 'lo'}, false)"


def _vw(name: str, cond: str) -> str:
    return f"sum(return_pct * market_cap) FILTER (usable AND {cond}) / nullif(sum(market_cap) FILTER (usable AND {cond}), 0) AS {name}"


_SMALL, _BIG = "market_cap < size_mid", "NOT (market_cap < size_mid)"
_MID = f"NOT {_is('bm', 'h')} AND NOT {_is('bm', 'l')}"
LEG_SQL = f"""{SORTED}, wide AS (SELECT date, {_cut('size', 'mid', 1)}, {', '.join(_cut(f, q, 5) for f in ('bm', 'ep', 'dy', 'mom', 'rev') for q in ('lo', 'hi'))}
    FROM cuts GROUP BY date),
  legs AS (SELECT date, count(*) AS n_names, CAST(sum(CAST(usable AS INTEGER)) AS BIGINT) AS n_clean,
    {_vw('s_h', f"{_SMALL} AND {_is('bm', 'h')}")}, {_vw('s_m', f"{_SMALL} AND {_MID}")}, {_vw('s_l', f"{_SMALL} AND {_is('bm', 'l')}")},
    {_vw('b_h', f"{_BIG} AND {_is('bm', 'h')}")}, {_vw('b_m', f"{_BIG} AND {_MID}")}, {_vw('b_l', f"{_BIG} AND {_is('bm', 'l')}")},
    {', '.join(_vw(f'{f}_{s}', _is(f, s)) for f in ('ep', 'dy', 'mom', 'rev') for s in ('h', 'l'))}
    FROM rows_ LEFT JOIN wide USING (date) GROUP BY date HAVING count(*) >= 10 AND sum(CAST(usable AS INTEGER)) >= 8)"""
FACTOR_CTES = f"""{LEG_SQL}, {v.MARKET}, {RF},
  m AS (SELECT legs.*, mkt_pct FROM legs ASOF LEFT JOIN (SELECT * FROM market WHERE mkt_pct IS NOT NULL) k ON legs.date >= k.date),
  r AS (SELECT m.*, coalesce(rf_pct, 0) AS rf_pct FROM m ASOF LEFT JOIN rf ON m.date >= rf.date)"""
FACTOR_SELECT = """SELECT date, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS ymd, round(mkt_pct - rf_pct, 4) + 0.0 AS "Rm_Rf",
    round(list_avg([s_h, s_m, s_l]) - list_avg([b_h, b_m, b_l]), 4) + 0.0 AS "SMB", round(list_avg([s_h, b_h]) - list_avg([s_l, b_l]), 4) + 0.0 AS "HML",
    round(ep_h - ep_l, 4) + 0.0 AS "WML_ep", round(dy_h - dy_l, 4) + 0.0 AS "WML_dy", round(mom_h - mom_l, 4) + 0.0 AS "UMD", round(rev_l - rev_h, 4) + 0.0 AS "STR" FROM r"""
_W252 = "(PARTITION BY stock_code ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"


def _betas_sql(names: tuple[str, ...]) -> str:
    """CTEs from ``factor_rows`` and ``panel`` to ``betas``: every window's rows are joined, its gaps filled forward, then backward, and its equations solved."""
    k, up, down = len(names), "(PARTITION BY stock_code ORDER BY date ROWS UNBOUNDED PRECEDING)", "(PARTITION BY stock_code ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near = ", ".join(
        f"max(CASE WHEN f{i} IS NOT NULL THEN r END) OVER {up} AS l{i}, last_value(f{i} IGNORE NULLS) OVER {up} AS b{i}, "
        f"min(CASE WHEN f{i} IS NOT NULL THEN r END) OVER {down} AS m{i}, first_value(f{i} IGNORE NULLS) OVER {down} AS c{i}" for i in range(k)
    )
    filled = ", ".join(f"CASE WHEN w.l{i} >= t.r - 252 THEN w.b{i} WHEN w.m{i} < t.r THEN w.c{i} END AS x{i}" for i in range(k))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = ", ".join([f"sum(x{i} * x{j}) AS p_{i}_{j}" for i, j in pairs] + [f"sum(x{i}) AS s_{i}, sum(x{i} * y) AS q_{i}, count(x{i}) AS n_{i}" for i in range(k)])
    normal = ", ".join([f"p_{i}_{j} - s_{i} * s_{j} / n AS a_{i}_{j}" for i, j in pairs] + [f"q_{i} - s_{i} * sy / n AS t_{i}" for i in range(k)])
    whole = " AND ".join(f"n_{i} = n" for i in range(k))
    return f"""rows_of AS (SELECT panel.stock_code, panel.date, return_pct / 100 AS y, row_number() OVER (PARTITION BY stock_code ORDER BY panel.date) AS r,
    {', '.join(f'f."{n}" AS f{i}' for i, n in enumerate(names))} FROM panel LEFT JOIN factor_rows AS f ON panel.date = f.date),
  near AS MATERIALIZED (SELECT stock_code, date, r, y, {near} FROM rows_of),
  in_windows AS (SELECT t.stock_code, t.date, w.y, {filled} FROM near AS t JOIN near AS w ON t.stock_code = w.stock_code AND w.r BETWEEN t.r - 252 AND t.r - 1 WHERE t.r > 252),
  summed AS (SELECT stock_code, date, count(*) AS n, sum(y) AS sy, {sums} FROM in_windows WHERE y IS NOT NULL GROUP BY stock_code, date HAVING count(*) >= 60),
  equations AS (SELECT stock_code, date, {normal} FROM summed WHERE {whole}),
  {solved('equations', k, ['stock_code', 'date'])},
  betas AS (SELECT panel.stock_code, panel.date, {', '.join(f'round(x_t_{i} + 3.7e-9, 6) + 0.0 AS "beta_{n}"' for i, n in enumerate(names))}
    FROM panel LEFT JOIN e_done AS e ON panel.stock_code = e.stock_code AND panel.date = e.date)"""


ALL_BETAS = f"{FACTOR_CTES}, factor_rows AS MATERIALIZED ({FACTOR_SELECT}),\n  {_betas_sql(fa.FACTORS)}"
CHARACTERS = f"""market_cap AS size, round(CASE WHEN pb > 0 THEN 1 / pb END + 3.7e-9, 6) + 0.0 AS bm,
        round(CASE WHEN pe > 0 THEN least(1 / pe, 1.0) END + 3.7e-9, 6) + 0.0 AS ep, coalesce(div_yield, cash_div) AS dy, {_r6sql('mom', 'rev')}"""

QUERIES = {
    "momentum": momentum,
    "characteristics": characteristics,
    "risk_free": risk_free,
    "risk_free_as_of": risk_free_as_of,
    "sort_breakpoints": sort_breakpoints,
    "portfolio_legs": portfolio_legs,
    "factor_returns": factor_returns,
    "single_factor_beta": single_factor_beta,
    "rolling_betas": rolling_betas,
    "characteristics_with_betas": characteristics_with_betas,
}

SQL = {
    "momentum": f"{MOMENTUM} SELECT stock_code, date, {_r6sql('mom', 'rev')} FROM moved",
    "characteristics": f"{MOMENTUM} SELECT stock_code, date, return_pct, {CHARACTERS} FROM moved",
    "risk_free": f"WITH {RF} SELECT date, {_r6sql('rf_pct')} FROM rf",
    "risk_free_as_of": f"WITH {v.PANEL}, {v.MARKET}, {RF} SELECT market.date, mkt_pct, {_r6sql('rf_pct')} FROM market ASOF LEFT JOIN rf ON market.date >= rf.date",
    "sort_breakpoints": f"{SORTED} SELECT date, feature, n, {_r6sql('lo', 'mid', 'hi')} FROM cuts",
    "portfolio_legs": f"{LEG_SQL} SELECT date, n_names, n_clean, {_r6sql(*LEGS)} FROM legs",
    "factor_returns": f"{FACTOR_CTES} {FACTOR_SELECT}",
    "single_factor_beta": f"""WITH {v.PANEL}, {v.MARKET}, j AS (SELECT stock_code, date, return_pct / 100 AS y, mkt_pct AS x FROM panel JOIN market USING (date)),
        b AS (SELECT *, CASE WHEN count(*) OVER {_W252} = 252 AND count(y) OVER {_W252} >= 60 THEN regr_slope(y, x) OVER {_W252} END AS beta_mkt FROM j)
        SELECT stock_code, date, {_r6sql('beta_mkt')} FROM b""",
    "rolling_betas": f"{ALL_BETAS} SELECT * FROM betas",
    "characteristics_with_betas": f"{ALL_BETAS}, chars AS (SELECT stock_code, date, {CHARACTERS} FROM moved) SELECT * FROM chars JOIN betas USING (stock_code, date)",
}
