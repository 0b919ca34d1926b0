"""Exports of result tables. Parquet is the working format; text is for hand-over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finpanel.session import materialize


def write_csv(df: DataFrame, path: str, *, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """CSV with a header, globally ordered over its part files when ``order`` is given."""
    (df.orderBy(*order) if order else df).write.mode(mode).csv(path, header=True, encoding="UTF-8")


def write_json(df: DataFrame, path: str, *, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """One JSON record per line; nulls are kept as fields."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str], *, format: str = "csv", mode: str = "errorifexists", **options) -> None:
    """Files of sorted ranges: all rows of one file come before those of the next, by the ordinal in the files' names, whatever the number of files.

    Ties in ``order`` are broken by the other columns, so that the same rows always give the same sequence.
    """
    columns = [*order, *[c for c in df.columns if c not in order]]
    if format == "csv":
        options = {"header": True, "encoding": "UTF-8"} | options
    if format == "json":
        options = {"ignoreNullFields": False} | options
    df.orderBy(*[F.col(f"`{c}`") for c in columns]).write.mode(mode).format(format).options(**options).save(path)


def read_ordered(spark: SparkSession, path: str | Sequence[str], schema: str, *, format: str = "csv", row: str = "row", **options) -> DataFrame:
    """Rows of ``write_ordered`` with their number, from 1, in column ``row``: earlier files first, then place in the file.

    The files are read once: rows are stored with the running id they get in the scan. A split's rows have ids one after another, so that its first id and what
    stands before it, a running total over the splits with a narrow row for each, number its rows without ordering them again. File names are taken apart per split.
    """
    if format == "csv":
        options = {"header": True} | options
    found = spark.read.schema(schema).format(format).options(**options).load(path)
    names = found.columns
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    rows = materialize(found.select(*names, *place, F.monotonically_increasing_id().alias("_id")), "read")
    sizes = rows.groupBy(F.col("_path").alias("_of"), F.col("_start").alias("_from")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    name = F.substring_index("_of", "/", -1)
    sizes = sizes.withColumns({"_folder": F.expr("left(_of, length(_of) - length(substring_index(_of, '/', -1)))"), "_file": F.regexp_extract(name, r"^part-(\d+)", 1).cast("int"), "_name": name})
    before = Window.partitionBy("_folder").orderBy("_file", "_name", "_from").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.select("_of", "_from", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "splits")
    placed = rows.join(sizes, (F.col("_path") == F.col("_of")) & (F.col("_start") == F.col("_from")))
    return placed.select(*names, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(row))


def write_panel(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Panel as Parquet in ranges of (security, day), so later scans prune by code. Ranges follow the
    distribution of the rows, so files are even."""
    df.repartitionByRange("stock_code", "date").sortWithinPartitions("stock_code", "date").write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, *, buckets: int, key: str = "stock_code", order: str = "date", path: str | None = None, mode: str = "errorifexists") -> None:
    """Panel as a catalog table in buckets of the security, sorted by day.

    Windows and joins by security over the table then need no shuffle and no sort. Choose ``buckets`` so that
    one fits a task; each bucket is written by one task, hence the matching repartition.
    """
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key, order)
    (writer.option("path", path) if path else writer).saveAsTable(table)
