"""Group statistics: moments, quantiles, curves, histograms, box summaries, rank-sum test.

``few_groups`` promises that the number of groups is bounded by the calendar or by constants of the query,
which lets the small per-group tables be broadcast; otherwise Spark picks those joins from measured sizes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finpanel.functions.measures import stars
from finpanel.operators.quantiles import join_groups, quantiles
from finpanel.session import materialize


# Tasks get these functions by value: executors need numpy and pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unpivot(df: DataFrame, keep: Sequence[str], values: Mapping[str, Column] | Sequence[str], *, label: str = "measure") -> DataFrame:
    """Long form: ``keep`` columns, ``label`` and ``value`` (double), one row per value column."""
    items = values.items() if isinstance(values, Mapping) else [(c, F.col(c)) for c in values]
    pairs = [F.struct(F.lit(n).alias(label), c.cast("double").alias("value")) for n, c in items]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, f"_p.{label}", "_p.value")


def describe(df: DataFrame, value: str, by: Sequence[str], *, scale: float = 100.0, min_n: int = 1, few_groups: bool = False) -> DataFrame:
    """N, mean, median, sample std, bias-corrected skew and excess kurtosis, P10/25/75/90, win rate.

    Mean, median, std and percentiles are multiplied by ``scale`` (fractions to percent); ``win_pct`` is
    the share of values > 0 in percent.
    """
    by = list(by)
    rows = df.where(F.nanvl(F.col(value).cast("double"), F.lit(None)).isNotNull())
    moments = rows.groupBy(*by).agg(
        F.count(value).alias("cnt"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        (F.avg(value) * scale).alias("mean"),
        (F.stddev_samp(value) * scale).alias("std"),
        F.skewness(value).alias("_g1"),
        F.kurtosis(value).alias("_g2"),
        (F.avg((F.col(value) > 0).cast("double")) * 100.0).alias("win_pct"),
    )
    moments = materialize(moments, "moments")
    spans = moments.select(*by, F.col("cnt").alias("n"), F.col("_lo").cast("double"), F.col("_hi").cast("double"))
    n, g1, g2 = F.col("cnt").cast("double"), F.col("_g1"), F.col("_g2")
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(
        n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6.0)
    )
    marks = quantiles(rows, by, value, [0.10, 0.25, 0.50, 0.75, 0.90], ["p10", "p25", "median", "p75", "p90"], spans=spans, few_groups=few_groups)
    joined = join_groups(moments.where(F.col("cnt") >= min_n), marks.drop("n"), by, few_groups=few_groups)
    return joined.select(
        *by, "cnt", "mean", (F.col("median") * scale).alias("median"), "std",
        skew.alias("skew"), kurt.alias("kurt"),
        *[(F.col(p) * scale).alias(p) for p in ("p10", "p25", "p75", "p90")], "win_pct",
    )


def tercile_stats(df: DataFrame, features: Mapping[str, Column], ret: str, *, by: Sequence[str] = (), min_n: int = 30, few_groups: bool = False) -> DataFrame:
    """Statistics of ``ret`` in the high (> P75), middle and low (< P25) third of each feature."""
    by = list(by)
    rows = df.where(F.col(ret).isNotNull())
    long = unpivot(rows, [*by, ret], features, label="feature").where(F.col("value").isNotNull())
    cuts = materialize(quantiles(long, [*by, "feature"], "value", [0.25, 0.75], ["_lo", "_hi"], few_groups=few_groups), "cuts")
    v = F.col("value")
    bucket = F.when(v > F.col("_hi"), "high").when(v < F.col("_lo"), "low").otherwise("middle")
    placed = join_groups(long, cuts.where(F.col("n") >= min_n), [*by, "feature"], few_groups=few_groups)
    placed = placed.where(F.col("n").isNotNull()).withColumn("bucket", bucket)
    return describe(placed, ret, [*by, "feature", "bucket"], few_groups=few_groups)


def curve_bands(df: DataFrame, curves: Mapping[str, float], by: Sequence[str], *, min_n: int = 5, few_groups: bool = False) -> DataFrame:
    """Median, P25 and P75 of offset curves (array columns) at every offset.

    ``curves`` maps each array column to its scale. Groups with fewer than ``min_n`` rows are left out.
    """
    by, names = list(by), list(curves)
    number = F.row_number().over(Window.orderBy(*by)) if few_groups and by else F.monotonically_increasing_id()
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_n)
    sizes = materialize(sizes.select(*by, "_rows", number.alias("_group")), "sizes")
    df = join_groups(df, sizes, by, few_groups=few_groups).where(F.col("_rows").isNotNull())

    # A group and a curve are one number, so that the many values behind the explode are matched and counted by whole numbers. Each curve is read alone.
    def of(i: int, curve: str) -> DataFrame:
        line = F.coalesce("_group", F.lit(0)) * len(names) + i
        each = df.select(line.alias("_line"), F.posexplode(curve).alias("k", "_y"))
        return each.select("_line", "k", (F.col("_y") * float(curves[curve])).alias("value"))  # scaled behind the explode, in compiled code

    long = reduce(DataFrame.unionAll, [of(i, c) for i, c in enumerate(names)])
    marks = quantiles(long, ["_line", "k"], "value", [0.25, 0.5, 0.75], ["p25", "median", "p75"], few_groups=few_groups)
    curve = F.element_at(F.array(*map(F.lit, names)), (F.col("_line") % len(names) + 1).cast("int")).alias("curve")
    marks = marks.select(F.expr(f"_line div {len(names)}").alias("_group"), curve, "k", F.col("n").alias("cnt"), "p25", "median", "p75")
    return join_groups(marks, sizes, ["_group"], few_groups=few_groups).select(*by, "curve", "k", "cnt", "p25", "median", "p75")


def histogram(df: DataFrame, value: str, by: Sequence[str], *, bins: int = 60, few_groups: bool = False) -> DataFrame:
    """Counts in ``bins`` equal bins between minimum and maximum, with the group mean."""
    by = list(by)
    rows = df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("mean"))
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    # The maximum belongs to the last bin; a constant group has the single bin 1.
    raw = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins).cast("int") + 1
    bucket = F.when(hi > lo, F.least(raw, F.lit(bins))).otherwise(1)
    placed = join_groups(rows, span, by, few_groups=few_groups).withColumn("bin", bucket)
    return placed.groupBy(*by, "lo", "hi", "mean", "bin").agg(F.count(F.lit(1)).alias("cnt"))


WIDTHS = [m * 10.0**k for k in range(-9, 13) for m in (1, 2, 5)]


def round_histogram(df: DataFrame, value: str, by: Sequence[str], *, most_bins: int = 60, few_groups: bool = False) -> DataFrame:
    """Counts in bins of a round width, aligned to its multiples, with the group mean: lo and hi are a bin's edges, hi not included.

    The width is the smallest of 1, 2 and 5 times a power of ten that covers a group with at most ``most_bins`` bins.
    """
    by = list(by)
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg("_v").alias("mean"))
    fits = F.filter(F.array(*(F.lit(w) for w in WIDTHS)), lambda w: F.floor(F.col("_hi") / w) - F.floor(F.col("_lo") / w) < most_bins)
    span = span.select(*by, "mean", F.get(fits, 0).alias("width"))
    placed = join_groups(rows, span, by, few_groups=few_groups).withColumn("_at", F.floor(F.col("_v") / F.col("width")))
    counts = placed.groupBy(*by, "mean", "width", "_at").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(*by, "mean", "width", (F.col("_at") * F.col("width")).alias("lo"), ((F.col("_at") + 1) * F.col("width")).alias("hi"), "cnt")


def box_summary(df: DataFrame, value: str, by: Sequence[str], *, few_groups: bool = False) -> DataFrame:
    """Quartiles, extremes, and whiskers (outermost values within 1.5 interquartile ranges)."""
    by = list(by)
    rows = df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    box = quantiles(rows, by, "_v", [0.25, 0.5, 0.75], ["q1", "median", "q3"], few_groups=few_groups)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    return (
        join_groups(rows, box, by, few_groups=few_groups)
        .groupBy(*by, F.col("n").alias("cnt"), "q1", "median", "q3")
        .agg(
            F.min("_v").alias("lo"), F.max("_v").alias("hi"),
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_lo"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_hi"),
        )
    )


EXACT_BELOW, MOST_PAIRS = 8, 1_000_000


def rank_sum_counts(m: int, n: int) -> list[int]:
    """In how many ways U takes each value 0 to m * n, for groups of m and n without ties.

    The counts are the coefficients of a Gaussian binomial: one factor (1 - q^(n+i)) / (1 - q^i) for each of the m values, in whole numbers.
    """
    counts = np.array([0] * (m * n + 1), dtype=object)
    counts[0] = 1
    for i in range(1, m + 1):
        if n + i <= m * n:
            counts[n + i :] = counts[n + i :] - counts[: -n - i]
        for r in range(min(i, len(counts))):
            counts[r::i] = np.cumsum(counts[r::i])
    return counts.tolist()


def exact_p(n1: int, n0: int, u: float) -> float:
    """Two-sided p of U: twice the share of arrangements whose U is as large as the larger of U and its mirror, at most 1."""
    counts = rank_sum_counts(min(n1, n0), max(n1, n0))
    upper = sum(counts[int(max(u, n1 * n0 - u)) :])
    return min(1.0, 2 * upper / sum(counts))


@F.pandas_udf(T.DoubleType())
def _two_sided_p(n1: pd.Series, n0: pd.Series, u: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    out = []
    for a, b, x, t, s in zip(n1, n0, u, ties, z):
        if t == 0 and 0 < min(a, b) <= EXACT_BELOW and a * b <= MOST_PAIRS:
            out.append(exact_p(int(a), int(b), x))
        else:
            out.append(None if pd.isna(s) else math.erfc(abs(s) / math.sqrt(2.0)))
    return pd.Series(out, dtype="float64")


def mann_whitney(df: DataFrame, value: str, group: str, by: Sequence[str] = (), *, per_range: int = 100_000, few_groups: bool = False) -> DataFrame:
    """Mann-Whitney U of group 1 against group 0, two-sided p.

    p is exact where one group has at most 8 values and no two values are equal, else the normal approximation with tie and continuity
    correction (also where such a small group meets so many values that there are more than a million pairs). Ranks never need one ordered pass over all
    values: rows are counted per distinct value, and the distinct values are sorted by ranges, as many as their number asks for
    (about ``per_range`` in each). A value's rank is the size of the ranges below plus its place inside its own.
    """
    by = list(by)
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v"), F.col(group).cast("int").alias("_g"))
    rows = rows.where(F.col("_v").isNotNull() & F.col("_g").isNotNull())
    counts = materialize(rows.groupBy(*by, "_v").agg(F.sum("_g").alias("_n1"), F.count(F.lit(1)).alias("_c")), "counts")
    parts = -(-counts.count() // per_range)
    if parts > 1:
        placed = materialize(counts.repartitionByRange(parts, *by, "_v").withColumn("_b", F.spark_partition_id()), "ranges")
    else:
        placed = counts.withColumn("_b", F.lit(0))
    per_part = placed.groupBy(*by, "_b").agg(F.sum("_c").alias("_size"))
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select(*by, "_b", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_before", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    ranked = join_groups(ranked, per_part, [*by, "_b"], few_groups=few_groups and parts <= 1)
    mid_rank = F.col("_below") + F.col("_before") + (F.col("_c") + 1) / 2.0
    c = F.col("_c").cast("double")
    total = ranked.groupBy(*by).agg(
        F.sum(F.col("_n1") * mid_rank).alias("_r1"),
        F.sum("_n1").alias("n1"),
        F.sum(F.col("_c") - F.col("_n1")).alias("n0"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    total = total.withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2.0)
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    gap = F.greatest(F.abs(F.col("u") - n1 * n0 / 2.0) - 0.5, F.lit(0.0))
    z = gap / F.nullif(spread, F.lit(0.0))
    return total.select(*by, "n1", "n0", "u", "_ties", z.alias("z")).withColumn("p_value", _two_sided_p("n1", "n0", "u", "_ties", "z")).drop("_ties")


def compare_groups(df: DataFrame, features: Mapping[str, Column], group: str, *, by: Sequence[str] = (), min_n: int = 5, few_groups: bool = False) -> DataFrame:
    """Mean and median of each feature in group 1 (``hi``) and 0 (``lo``), with the rank-sum p and stars."""
    by = list(by)
    long = unpivot(df, [*by, group], features, label="feature").where(F.col("value").isNotNull() & F.col(group).isNotNull())
    keys = [*by, "feature"]
    means = long.groupBy(*keys, group).agg(F.avg("value").alias("mean"), F.count("value").alias("cnt"))
    medians = quantiles(long, [*keys, group], "value", [0.5], ["median"], few_groups=few_groups).drop("n")
    both = join_groups(means, medians, [*keys, group], few_groups=few_groups)

    def of(col: str, g: int, name: str) -> Column:
        return F.max(F.when(F.col(group) == g, F.col(col))).alias(name)

    wide = both.groupBy(*keys).agg(
        of("cnt", 1, "n_hi"), of("cnt", 0, "n_lo"), of("mean", 1, "mean_hi"), of("median", 1, "median_hi"),
        of("mean", 0, "mean_lo"), of("median", 0, "median_lo"),
    ).where((F.col("n_hi") >= min_n) & (F.col("n_lo") >= min_n))
    tests = mann_whitney(long, "value", group, keys, few_groups=few_groups).select(*keys, "u", "z", "p_value")
    return join_groups(wide, tests, keys, few_groups=few_groups).withColumn("stars", stars(F.col("p_value")))
