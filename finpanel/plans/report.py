"""The event-study report as result tables. Pass events that are stored (see ``materialize``): every table
below reads them again, and most of them need two passes for exact quantiles."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finpanel.functions.measures import capped_size_log, event_strength, missing_if_zero, stars
from finpanel.operators.keys import set_overlap
from finpanel.operators.quantiles import join_groups, quantiles
from finpanel.operators.stats import box_summary, compare_groups, curve_bands, describe, histogram, round_histogram, tercile_stats, unpivot
from finpanel.plans.market import amplitude_export, index_after_events, market_breadth
from finpanel.session import materialize

RETURNS = ("fwd_ret_1", "fwd_ret_5", "fwd_ret_20")
EXCESS = ("fwd_exc_1", "fwd_exc_5", "fwd_exc_20")
CURVES = {"cum_amp": 1.0, "cum_ret": 100.0, "cum_exc": 100.0}


def event_rows(panel: DataFrame, *, pct: float = 0.8, min_scores: int = 10) -> DataFrame:
    """Event rows of both kinds (``kind`` big / sml; a row is never both), with strength and persistence.

    ``high`` is 1 from the kind's ``pct`` score quantile on, 0 below, null without a score or if the kind has fewer than ``min_scores`` of them.
    """
    kind = F.when(F.col("amp_big") == 1, "big").when(F.col("amp_sml") == 1, "sml")
    strength = F.coalesce(
        F.when(kind == "big", event_strength(F.col("amp_pct"), F.col("roll_hi"), side="big")),
        F.when(kind == "sml", event_strength(F.col("amp_pct"), F.col("roll_lo"), side="small")),
    )
    rows = panel.withColumns({"kind": kind, "strength": strength}).where(F.col("kind").isNotNull())
    rows = materialize(rows, "events")
    cuts = materialize(quantiles(rows, ["kind"], "persist_amp", [pct], ["persist_cut"], few_groups=True), "cuts")
    cuts = cuts.select("kind", F.when(F.col("n") >= min_scores, F.col("persist_cut")).alias("persist_cut"))
    rows = join_groups(rows, cuts, ["kind"], few_groups=True)
    return rows.withColumn("high", (F.col("persist_amp") >= F.col("persist_cut")).cast("int"))


def event_summary(events: DataFrame) -> DataFrame:
    """Per kind: events, securities, first and last day, attention events, mean drawdown in percent."""
    per = events.groupBy("kind", "stock_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.sum("is_attention").alias("att"), F.sum("mdd").alias("mdd"), F.count("mdd").alias("mdd_n"),
    )
    return per.groupBy("kind").agg(
        F.sum("n").alias("events"), F.count("stock_code").alias("securities"),
        F.min("lo").alias("min_date"), F.max("hi").alias("max_date"), F.sum("att").alias("attention"),
        (F.sum("mdd") / F.nullif(F.sum("mdd_n"), F.lit(0)) * 100.0).alias("mdd_mean_pct"),
    )


def return_stats(events: DataFrame) -> DataFrame:
    """Statistics of forward and excess returns by kind and horizon, in percent."""
    return describe(unpivot(events, ["kind"], [*RETURNS, *EXCESS]), "value", ["kind", "measure"], few_groups=True)


def return_histograms(events: DataFrame, *, bins: int = 60) -> DataFrame:
    long = unpivot(events, ["kind"], {n: F.col(n) * 100.0 for n in [*RETURNS, *EXCESS]})
    return histogram(long, "value", ["kind", "measure"], bins=bins, few_groups=True)


def round_return_histograms(events: DataFrame, *, most_bins: int = 60) -> DataFrame:
    """Histograms as a chart library bins them: round widths, at most ``most_bins`` bins."""
    long = unpivot(events, ["kind"], {n: F.col(n) * 100.0 for n in [*RETURNS, *EXCESS]})
    return round_histogram(long, "value", ["kind", "measure"], most_bins=most_bins, few_groups=True)


def persistence_stats(events: DataFrame) -> DataFrame:
    """Excess return over the longest horizon, high persistence against the rest."""
    return describe(events.where(F.col("high").isNotNull()), "fwd_exc_20", ["kind", "high"], few_groups=True)


def persistence_boxes(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("high").isNotNull()).withColumn("pct", F.col("fwd_exc_20") * 100.0)
    return box_summary(rows, "pct", ["kind", "high"], few_groups=True)


def persistence_curves(events: DataFrame) -> DataFrame:
    return curve_bands(events.where(F.col("high").isNotNull()), CURVES, ["kind", "high"], few_groups=True)


def attention_stats(events: DataFrame, *, min_n: int = 5) -> DataFrame:
    """Excess return over the longest horizon, attention days against others (groups of ``min_n`` events)."""
    sizes = events.groupBy("kind", "is_attention").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_n)
    rows = join_groups(events, materialize(sizes, "sizes"), ["kind", "is_attention"], few_groups=True).where(F.col("_size").isNotNull())
    return describe(rows, "fwd_exc_20", ["kind", "is_attention"], few_groups=True)


def feature_thirds(events: DataFrame) -> DataFrame:
    """Return over the longest horizon by thirds of five features."""
    features = {n: F.col(n) for n in ("market_cap", "pe", "pb", "cash_div", "beta")}
    return tercile_stats(events, features, "fwd_ret_20", by=["kind"], few_groups=True)


def persistence_features() -> Mapping[str, Column]:
    return {
        "market_cap": F.col("market_cap"),
        "beta": missing_if_zero(F.col("beta")),
        "is_attention": F.coalesce(F.col("is_attention"), F.lit(0)) * 1.0,
        "strength": F.col("strength"),
    }


def persistence_compare(events: DataFrame) -> DataFrame:
    """Features of high-persistence events against the rest, with a rank-sum test."""
    return compare_groups(events, persistence_features(), "high", by=["kind"], few_groups=True)


def persistence_logit(events: DataFrame, kind: str | None = None, *, min_n: int = 50) -> DataFrame:
    """Logit of high persistence on log size, beta, attention and strength, per kind of event (or for one kind, without the column).

    One row per coefficient: estimate, standard error, z, p, 95 % interval, with N and McFadden's R².
    An event without a score counts as not high. A kind with too few rows or a single class is left out.
    """
    label = F.coalesce((F.col("persist_amp") >= F.col("persist_cut")).cast("double"), F.lit(0.0))
    x = persistence_features()
    rows = (events if kind is None else events.where(F.col("kind") == kind)).select(
        "kind", label.alias("label"), capped_size_log(F.col("market_cap")).alias("log_mcap"),
        x["beta"].alias("beta"), x["is_attention"].alias("is_attention"), x["strength"].alias("strength"),
    )
    fitted = logit_table(rows, "label", ["log_mcap", "beta", "is_attention", "strength"], by="kind", min_n=min_n)
    return fitted if kind is None else fitted.drop("kind")


def logit_table(df: DataFrame, label: str, features: list[str], *, by: str | None = None, min_n: int = 50, rounds: int = 50, tol: float = 1e-10) -> DataFrame:
    """Binomial regression with the summary a statistics package prints, for each group of the text column ``by``.

    Newton steps: each is one aggregation of the stored rows to the sums of weighted cross-products of features and constant and of the score, per
    group. What reaches the driver has the size of the coefficients; groups must be few, as constants of the query. Nulls in
    ``label``, ``features`` or ``by`` leave a row out; groups below ``min_n`` rows or with one class are left out.
    """
    spark = df.sparkSession
    schema = "_by string, variable string, coef double, std_err double, z double, p_value double, ci_lo double, ci_hi double, n long, pseudo_r2 double"
    size = len(features) + 1
    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    group = F.lit("all") if by is None else F.col(by).cast("string")
    rows = df.select(group.alias("_by"), F.col(label).cast("double").alias("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(x)))
    rows = materialize(rows.dropna(), "logit")
    y = F.col("_y")
    known = {r["_by"]: (r["n"], r["ones"]) for r in rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("ones")).collect()}
    known = {g: (n, ones) for g, (n, ones) in known.items() if n >= min_n and 0 < ones < n}
    beta, done, table = {g: np.zeros(size) for g in known}, set(), []
    for turn in range(rounds + 1):
        if len(done) == len(known):
            break
        at = F.create_map(*[F.lit(v) for g in known if g not in done for v in (g, beta[g].tolist())])
        eta = reduce(add, [F.col(f"_x{i}") * F.get("_b", i) for i in range(size)])
        step = rows.withColumn("_b", F.try_element_at(at, F.col("_by"))).where(F.col("_b").isNotNull())
        step = step.withColumn("_eta", eta).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_eta"))))
        weight = F.col("_p") * (1.0 - F.col("_p"))
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        fit = F.sum(y * F.col("_eta") - F.greatest(F.col("_eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs(F.col("_eta")))))
        sums = [F.sum(weight * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i, j in pairs]
        sums += [F.sum((y - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(size)]
        for r in step.groupBy("_by").agg(fit.alias("fit"), *sums).collect():
            g, info = r["_by"], np.zeros((size, size))
            for i, j in pairs:
                info[i, j] = info[j, i] = r[f"h{i}_{j}"]
            inverse = np.linalg.pinv(info, hermitian=True)
            move = inverse @ np.array([r[f"g{i}"] for i in range(size)])
            if np.abs(move).max() <= tol * (1.0 + np.abs(beta[g]).max()) or turn == rounds:
                done.add(g)
                table += _logit_rows(g, [*features, "const"], beta[g], np.sqrt(np.diag(inverse)), r["fit"], *known[g])
            else:
                beta[g] = beta[g] + move
    out = spark.createDataFrame(table, schema).withColumn("stars", stars(F.col("p_value")))
    return out.drop("_by") if by is None else out.withColumnRenamed("_by", by)


def _logit_rows(group: str, names: list[str], coefs: np.ndarray, errors: np.ndarray, fit: float, n: int, ones: float) -> list[tuple]:
    share = ones / n
    r2 = 1.0 - fit / (ones * math.log(share) + (n - ones) * math.log(1.0 - share))
    half = 1.959963984540054  # Fixed value: 97.5 % point of the normal distribution.
    out = []
    for name, b, se in zip(names, coefs.tolist(), errors.tolist()):
        z = b / se if se > 0 else None
        p = None if z is None else math.erfc(abs(z) / math.sqrt(2.0))
        out.append((group, name, b, se, z, p, b - half * se, b + half * se, int(n), r2))
    return out


def overlap_of_persistent(events: DataFrame, *, min_events: int = 10) -> DataFrame:
    """How many securities had high persistence after big events, after small ones, after both; empty with fewer than ``min_events`` of a kind."""
    hit, big = F.col("high") == 1, F.col("kind") == "big"
    enough = events.agg((F.least(F.count_if(big), F.count_if(~big)) >= min_events).alias("enough")).scalar()
    return set_overlap(events, "stock_code", hit & big, hit & ~big).where(enough)


def full_report(panel: DataFrame, index_rows: DataFrame) -> dict[str, DataFrame]:
    """Every table of the report, by name, from a study panel and the index rows.

    Event rows and market breadth are stored once; quantiles and the logit run their rounds at once, the rest is lazy. The panel need not be stored: it is
    read for the events, whose rows alone get curves, and for the breadth, which needs the flags alone.
    """
    events = event_rows(panel)
    breadth = materialize(market_breadth(panel), "breadth")
    tables = {
        "event_summary": event_summary(events),
        "return_stats": return_stats(events),
        "return_histograms": return_histograms(events),
        "persistence_stats": persistence_stats(events),
        "persistence_boxes": persistence_boxes(events),
        "persistence_curves": persistence_curves(events),
        "persistence_compare": persistence_compare(events),
        "persistence_logit": persistence_logit(events),
        "attention_stats": attention_stats(events),
        "feature_thirds": feature_thirds(events),
        "overlap": overlap_of_persistent(events),
        "market_amplitude": amplitude_export(breadth),
    }
    for flag in ("mkt_amp_hi", "mkt_amp_lo"):
        tables[f"index_after_{flag}"] = index_after_events(breadth, index_rows, flag)
    return tables


#: Columns that name a row of a report table; all other numbers are its values.
REPORT_KEYS = ("kind", "measure", "high", "is_attention", "curve", "k", "feature", "bucket", "variable", "bin", "date", "stock_code", "horizon")


def report_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as one: section, item (the row's key values, joined by blanks), value_name, value (double; null where there is none).

    Every table is computed and stored on its own, so that no plan holds more than one of them.
    """
    out = None
    for name, df in tables.items():
        keys = [c for c in REPORT_KEYS if c in df.columns]
        item = F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
        kinds = dict(df.dtypes)
        values = {c: F.col(c) for c in df.columns if c not in keys and kinds[c] in ("bigint", "int", "double")}
        long = unpivot(df.withColumn("item", item), ["item"], values, label="value_name").select(F.lit(name).alias("section"), "item", "value_name", "value")
        long = materialize(long, "report")
        out = long if out is None else out.unionByName(long)
    return out
