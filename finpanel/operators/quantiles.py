"""Exact group quantiles without collecting or sorting a group.

A wanted rank lies in a range of values, at first the group's whole span. Each round cuts that range into equal sub-ranges, counts them, and goes
on with the one that holds the rank, cut down to the smallest and largest value found in it. Counters are bounded by the number of sub-ranges, whatever
the group's size, and counts prove where the rank is and how many values are left. A round separates a range's ends, so it always shrinks; when no
range has more than a bounded number of values, these are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.session import materialize


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], *, few_groups: bool, how: str = "left") -> DataFrame:
    """Attach one row of ``groups`` to every row; null group keys match each other.

    ``few_groups`` states that the number of groups is bounded by the calendar or by constants of the
    query, which bounds the broadcast. Otherwise Spark picks the join from measured sizes.
    """
    if not by:
        one = groups.select(F.struct(*groups.columns)).scalar()  # at most a single row
        joined = rows.withColumn("_one", one)
        kept = joined.where(F.col("_one").isNotNull()) if how == "inner" else joined
        return kept.select(*rows.columns, "_one.*")
    side = groups.select(*[F.col(b).alias(f"_g_{b}") for b in by], *[c for c in groups.columns if c not in by])
    if few_groups:
        side = F.broadcast(side)
    on = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
    return rows.join(side, on, how).drop(*[f"_g_{b}" for b in by])


def value_spans(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: n, and the smallest and largest value, as ``quantiles`` takes them."""
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _share(v: Column, lo: Column, hi: Column, ranges: int, first: bool) -> Column:
    """Where ``v`` lies between ``lo`` and ``hi``, from 0 to 1, never falling as ``v`` grows: linear in the value, or in its logarithm where the ends differ
    by orders of magnitude. Where they differ in sign it is linear around 0 and logarithmic beyond in the first round, and parts the signs later."""

    def between(scaled: Callable[[Column], Column]) -> Column:
        return (scaled(v) - scaled(lo)) / F.nullif(scaled(hi) - scaled(lo), F.lit(0.0))

    unit = F.greatest(F.abs(lo), F.abs(hi)) / float(1 << 20)
    return (
        F.when((lo > 0) & (hi / ranges > lo), between(F.log))
        .when((hi < 0) & (lo / ranges < hi), between(lambda x: -F.log(-x)))
        .when((lo < 0) & (hi > 0), between(lambda x: F.signum(x) * (F.log1p(F.abs(x) / unit) if first else 1.0)))
        .otherwise(between(lambda x: x / 2))  # halves: a span may be beyond all doubles
    )


def _match(left: DataFrame, right: DataFrame, by: Sequence[str], few_groups: bool, how: str, *more: Column) -> DataFrame:
    """Join on equal groups, null ones included, and further conditions; the group's columns stay once. Columns that are never null are matched by plain equality,
    which costs less."""
    side = right.withColumnsRenamed({b: f"_g_{b}" for b in by})
    on = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) if left.schema[b].nullable else F.col(b) == F.col(f"_g_{b}") for b in by]
    return left.join(F.broadcast(side) if few_groups else side, [*on, *more], how).drop(*[f"_g_{b}" for b in by])


def _settled(df: DataFrame, few_groups: bool) -> DataFrame:
    """A small table, computed: stored in the shared folder, or, with few groups, held by the driver as plain columns."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if few_groups else materialize(df, "ranks")


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    *,
    ranges: int = 1024,
    most_held: int = 100_000,
    spans: DataFrame | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles of the values: columns ``by``, ``n`` and one per quantile. Null and NaN are no values.

    Runs its rounds at once; each reads the input, after the first only the few values inside the wanted ranges are counted, and once no range has more
    than ``most_held`` values (0.8 MB), these are sorted. Store the input when it is costly. ``spans``: the stored result of ``value_spans`` where a caller has
    it, which saves one reading. For ``few_groups`` see :func:`join_groups`.
    """
    keys, probs = list(by), list(probs)
    names = list(names or [f"p{round(p * 100)}" for p in probs])
    rows = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where(F.col("_v").isNotNull())
    start = spans.select(*keys, "n", "_lo", "_hi") if spans is not None else value_spans(df, keys, value)
    by = keys or ["_all"]
    if not keys:
        rows, start = rows.withColumn("_all", F.lit(0)), start.withColumn("_all", F.lit(0))
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.posexplode(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])).alias("_j", "_rank")
    state = _settled(start.where("n > 0").select(*by, "n", ranks, "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_count")), few_groups)
    v, inside = F.col("_v"), F.col("_rank") - F.col("_before")
    is_open = (F.col("_lo") < F.col("_hi")) & (inside > 0) & (inside < F.col("_count") - 1)
    for turn in count():
        open_ = state.where(is_open)
        most = open_.agg(F.max("_count")).first()[0]
        if most is None:
            break
        edges = open_.select(*by, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct()
        met = _match(rows, edges, by, few_groups, "inner", v >= F.col("_from"), v <= F.col("_to"))
        wanted = open_.select(*by, "_j", F.col("_lo").alias("_start"), inside.alias("_inside"))
        # What is joined back is one row per wanted rank: the lists and counters themselves grow with the groups and stay in their tasks.
        if most <= most_held:
            held = met.groupBy(*by, "_from").agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
            picked = _match(held, wanted, by, few_groups, "inner", F.col("_start") == F.col("_from"))
            picked = picked.select(*by, F.col("_j").alias("_of"), F.get("_sorted", F.col("_inside").cast("int")).alias("_exact"))
            moved = {"_lo": F.coalesce("_exact", "_lo"), "_hi": F.coalesce("_exact", "_hi")}
        else:
            share = _share(v, F.col("_from"), F.col("_to"), ranges, first=turn == 0)
            cell = F.when(v == F.col("_to"), F.lit(ranges)).otherwise(F.coalesce(F.floor(share * ranges), F.lit(0)).cast("int"))
            cells = met.groupBy(*by, "_from", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            upto = F.sum("_c").over(Window.partitionBy(*by, "_from").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
            cells = cells.withColumn("_below", upto - F.col("_c"))
            holds = [F.col("_start") == F.col("_from"), F.col("_inside") >= F.col("_below"), F.col("_inside") < F.col("_below") + F.col("_c")]
            picked = _match(cells, wanted, by, few_groups, "inner", *holds).select(*by, F.col("_j").alias("_of"), "_least", "_most", "_below", "_c")
            found = F.col("_c").isNotNull()
            moved = {
                "_lo": F.when(found, F.col("_least")).otherwise(F.col("_lo")), "_hi": F.when(found, F.col("_most")).otherwise(F.col("_hi")),
                "_before": F.col("_before") + F.when(found, F.col("_below")).otherwise(0), "_count": F.coalesce("_c", "_count"),
            }
        done = _match(state, picked, by, few_groups, "left", F.col("_j") == F.col("_of"))
        state = _settled(done.select(*[moved.get(c, F.col(c)).alias(c) for c in state.columns]), few_groups)
        if most <= most_held:
            break
    exact = F.when(inside == 0, F.col("_lo")).otherwise(F.col("_hi"))
    wide = state.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_j") == j, exact)).alias(f"_q{j}") for j in range(2 * len(probs))])
    out = [(F.col(f"_q{2 * i}") + (F.col(f"_q{2 * i + 1}") - F.col(f"_q{2 * i}")) * (p - F.floor(p))).alias(name) for i, (p, name) in enumerate(zip(places, names))]
    return wide.select(*keys, "n", *out)
