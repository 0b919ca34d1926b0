"""One row per key: deduplication, splitting off bad rows, keyed fills and picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered_columns(df: DataFrame) -> list[Column]:
    """Columns as comparable values (maps have no order, so they enter as JSON text)."""
    return [
        F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]


def dedupe_latest(df: DataFrame, keys: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that is greatest by ``recency``; equal recency is decided by the whole row.

    An aggregate, not a ranking window: a key with very many copies is reduced before the shuffle.
    """
    return _pick(df, keys, F.max, recency)


def dedupe_first(df: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that is smallest by ``priority`` (then by the whole row)."""
    return _pick(df, keys, F.min, priority)


def _pick(df: DataFrame, keys: Sequence[str], pick, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = [F.col(f"`{k}`") for k in keys]
    if any(isinstance(df.schema[c].dataType, T.MapType) for c in rest):  # maps can't be compared, so the row travels beside its rank
        rank = F.struct(*[F.col(f"`{c}`") for c in order], *_ordered_columns(df))
        best = (F.max_by if pick is F.max else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in rest]), rank)
    else:  # the rank is the row, its recency first; keys are equal within a group
        first = [c for c in dict.fromkeys(order) if c not in keys]
        best = pick(F.struct(*[F.col(f"`{c}`") for c in [*first, *[c for c in rest if c not in first]]]))
    chosen = df.groupBy(*by).agg(best.alias("_row")) if rest else df.select(*by).distinct()
    return chosen.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`") for c in df.columns])


def _marked(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    bad = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    return df.withColumn("reject_reason", F.nullif(F.concat_ws(",", *bad), F.lit("")))


def reject_totals(df: DataFrame, rules: Mapping[str, Column], *, clean: str = "clean") -> DataFrame:
    """Rows per reason, as ``split_rejects`` gives them, and of clean rows, from one reading: columns ``reason`` and ``cnt``."""
    reason = F.coalesce("reject_reason", F.lit(clean))
    return _marked(df, rules).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("cnt"))


def split_rejects(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows with ``reject_reason``). A rule is true for a bad row."""
    marked = _marked(df, rules)
    good = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, marked.where(F.col("reject_reason").isNotNull())


def forward_fill(df: DataFrame, col: str, by: Sequence[str], *, order: str = "date", to: str | None = None) -> DataFrame:
    """Carry the last non-null value forward. A group is one series with one row per day."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to or f"{col}_filled", F.last(col, ignorenulls=True).over(w))


def as_of(left: DataFrame, series: DataFrame, value: str, *, on: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """Value of a dated series on the day itself, else the last non-null one before.

    Only the distinct days meet the series, so the ordered pass runs over at most one row per day (and
    key), never over the rows of ``left``; the result is joined back by day.
    """
    by = list(by)
    days = left.select(*by, on).distinct().withColumn(value, F.lit(None).cast(series.schema[value].dataType))
    known = series.select(*by, on, value)
    per_day = days.unionByName(known).groupBy(*by, on).agg(F.max(value).alias(value))
    filled = forward_fill(per_day, value, by, order=on, to=value)
    # Without keys the side is bounded by the calendar; with keys Spark decides from measured sizes.
    return left.join(filled if by else F.broadcast(filled), [*by, on], "left")


def latest(df: DataFrame, by: Sequence[str], n: int, *, order: str = "date") -> DataFrame:
    """Last ``n`` rows by day: of the whole frame (no ``by``), or per key."""
    if not by:
        return df.orderBy(F.col(order).desc()).limit(n)
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def on_latest_day(df: DataFrame, *, order: str = "date") -> DataFrame:
    """Rows of the last day present."""
    return df.where(F.col(order) == df.agg(F.max(order)).scalar())


def expected_diff(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """Values found but not expected, and expected but not found: columns ``value`` and ``problem``."""
    found = df.select(F.col(col).alias("value")).where(F.col(col).isNotNull()).distinct()
    listed = df.sparkSession.createDataFrame([(x,) for x in expected], "value string")
    extra = found.join(F.broadcast(listed), "value", "left_anti").withColumn("problem", F.lit("unexpected"))
    # Only listed values can match, so the found side is cut to the list before it meets it.
    seen = found.where(F.col("value").isin(*expected))
    absent = listed.join(F.broadcast(seen), "value", "left_anti").withColumn("problem", F.lit("missing"))
    return extra.unionByName(absent)


def set_overlap(df: DataFrame, member: str, in_a: Column, in_b: Column) -> DataFrame:
    """Sizes of two member sets, of their intersection and union, Jaccard and shares in percent."""
    flags = df.groupBy(member).agg(
        F.max(F.coalesce(in_a, F.lit(False)).cast("int")).alias("a"),
        F.max(F.coalesce(in_b, F.lit(False)).cast("int")).alias("b"),
    )
    sizes = flags.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n_both"),
        F.coalesce(F.sum(F.greatest("a", "b")), F.lit(0)).alias("n_any"),
    )

    def share(part: str, whole: str, scale: float = 1.0) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * scale).otherwise(0.0)

    return sizes.select(
        "*",
        share("n_both", "n_any").alias("jaccard"),
        share("n_both", "n_a", 100.0).alias("pct_of_a"),
        share("n_both", "n_b", 100.0).alias("pct_of_b"),
    )
