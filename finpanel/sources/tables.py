"""Keyed Parquet tables: upsert, insert-if-absent, snapshots, load reports, incremental loads.

A load writes its rows to a folder of its own, one part per month, and then a small pointer file, numbered one higher than the last: it names the schema and,
for each month, the folders that hold its rows. Readers follow the last complete pointer, so they see a load whole or not at all, whenever it
breaks off. Loads rewrite only the months they touch; nothing is overwritten, so a snapshot is a copy of the pointer, and older versions stay until
the table's owner removes their folders. Of two loads at a time the slower one fails and is to be repeated.

A table may be given a declared schema (DDL): batches are brought to it; a column that the schema lacks is an error, one that a batch lacks keeps what is
stored. Without one the table has all columns that any load brought, in the types they had first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finpanel.operators.keys import dedupe_latest
from finpanel.session import materialize
from finpanel.sources.files import first_bytes, names_in, write_new

PART, WHOLE = "part_month", "all"  # a table without a day column has one part
STORED = "_stored_"  # prefix of recency columns that are kept with the rows, for later loads to compare
MOST_POINTER_BYTES = 1 << 26


@dataclass(frozen=True)
class Version:
    """What a pointer file holds: ``parts`` maps a month to the folders of its rows, ``merged`` a stream to the last batch it merged."""

    number: int
    schema: str
    parts: dict[str, list[str]] = field(default_factory=dict)
    merged: dict[str, int] = field(default_factory=dict)

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def _pointers(path: str) -> str:
    return f"{path.rstrip('/')}/_versions"


def version_of(spark: SparkSession, path: str) -> Version | None:
    """The last complete version of the table; a pointer that broke off while it was written is passed over."""
    for name in reversed(names_in(spark, _pointers(path))):
        try:
            return Version(**json.loads(first_bytes(spark, f"{_pointers(path)}/{name}", MOST_POINTER_BYTES)))
        except (ValueError, TypeError):
            continue
    return None


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    names = names_in(spark, _pointers(path))
    last = int(names[-1].split(".")[0]) if names else 0
    current = version_of(spark, path)
    fresh = (current.number if current else 0) == version.number
    number = last + 1
    if not fresh or not write_new(spark, f"{_pointers(path)}/{number:012d}.json", json.dumps(asdict(replace(version, number=number))).encode()):
        raise RuntimeError(f"another load of {path} was faster; repeat this one")


def _rows(spark: SparkSession, path: str, version: Version, months: Sequence[str] | None = None) -> DataFrame:
    """Rows of a version, of some months only if given: other folders are not even listed."""
    folders = [f"{path.rstrip('/')}/{f}" for m, found in version.parts.items() if months is None or m in months for f in found]
    if not folders:
        return spark.createDataFrame([], version.struct)
    return spark.read.schema(version.struct).parquet(*folders)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None when it does not exist yet. Plain Parquet without versions is a table, too."""
    version = version_of(spark, path)
    if version is not None:
        return _rows(spark, path, version)
    try:
        return spark.read.parquet(path).drop(PART)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _visible(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(STORED)])


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    df = read_table(spark, path)
    if df is None:
        raise ValueError(f"no table at {path}")
    return _visible(df) if schema is None else conform(_visible(df), schema, complete=True)


def conform(df: DataFrame, schema: str | StructType, *, complete: bool = False) -> DataFrame:
    """The columns of ``df`` in the declared order and types; unknown ones raise, ``complete`` adds missing ones as nulls."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    unknown = sorted(c for c in set(df.columns) - set(declared.names) if not c.startswith(STORED))
    if unknown:
        raise ValueError(f"columns that the table does not declare: {unknown}")
    kept = [f for f in declared if complete or f.name in df.columns]
    hidden = [F.col(c) for c in df.columns if c.startswith(STORED) and c not in declared.names]
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kept], *hidden)


def _month(day: str) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("string")


def months_of(batch: DataFrame, day: str | None) -> list[str]:
    """Months of a stored batch, a list bounded by the calendar."""
    if day is None:
        return [WHOLE]
    return sorted(r[0] for r in batch.select(_month(day)).where(F.col(day).isNotNull()).distinct().collect())


def _write(df: DataFrame, path: str, day: str | None, months: Sequence[str]) -> dict[str, list[str]]:
    """Write rows to a new folder of the table: month -> folder.

    Rows are rebalanced by month first: few files per month, and a month that outgrows a task is split.
    """
    load = f"data/{uuid.uuid4().hex}"
    if day is None:
        df.write.parquet(f"{path.rstrip('/')}/{load}")
        return {WHOLE: [load]}
    rows = df.withColumn(PART, _month(day)).hint("rebalance", PART)
    rows.write.partitionBy(PART).parquet(f"{path.rstrip('/')}/{load}")
    return {m: [f"{load}/{PART}={m}"] for m in months}


def _as_stored(batch: DataFrame, stored: StructType) -> tuple[DataFrame, StructType]:
    """The batch in the types that are stored, and the table's schema with the columns that the batch brings along."""
    known = {f.name: f.dataType for f in stored}
    batch = batch.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in batch.columns])
    return batch, StructType([*stored.fields, *[f for f in batch.schema if f.name not in known]])


def upsert(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], *, day: str | None = None, recency: Sequence[str] = (), keep_recency: bool = False,
    stamp: str | None = None, schema: str | None = None, merged: Mapping[str, int] | None = None,
) -> None:
    """Insert the batch, replacing rows with the same key.

    Equal keys within the batch are reduced to the last by ``recency``; recency columns that start with ``_`` are not stored. With ``keep_recency`` they
    are, out of sight, and a batch row that is older than the stored one changes nothing, so that late batches do no harm.
    Columns the batch does not have keep their stored values, new columns are null in rows that are stored already.
    ``day`` must be one of the keys and not null; ``stamp`` names a column set to now; ``merged`` is noted with the version (see ``streaming``). For ``schema``
    see the module.
    """
    keys = list(keys)
    batch = dedupe_latest(batch, keys, recency or keys)
    if keep_recency:
        batch = batch.withColumns({f"{STORED}{c}": F.col(c) for c in recency})
    batch = batch.drop(*[c for c in recency if c.startswith("_")])
    if stamp:
        batch = batch.withColumn(stamp, F.current_timestamp())
    if schema is not None:
        batch = conform(batch, schema)
    batch = materialize(batch, "upsert-batch")
    months, version = months_of(batch, day), version_of(spark, path)
    if version is None:
        stored = read_table(spark, path)  # plain Parquet, which becomes the first version as a whole
        parts, number, noted, old = {}, 0, {}, None if stored is None else _visible(stored)
        months = months if old is None else sorted({*months, *months_of(old, day)})
        struct = batch.schema if old is None else old.schema
    else:
        parts, number, noted, struct = version.parts, version.number, version.merged, version.struct
        old = _rows(spark, path, version, months)
    batch, struct = _as_stored(batch, struct)
    if schema is not None:
        names = StructType.fromDDL(schema)
        struct = StructType([*names.fields, *[f for f in struct if f.name.startswith(STORED)]])
    rows = conform(batch, struct, complete=True)
    if old is not None:
        rows = _merge(old, batch, keys, recency if keep_recency else (), struct)
    written = _write(rows, path, day, months)
    _commit(spark, path, Version(number, struct.json(), {**parts, **written}, {**noted, **(merged or {})}))


def _merge(old: DataFrame, batch: DataFrame, keys: list[str], recency: Sequence[str], struct: StructType) -> DataFrame:
    """Stored rows with the batch's rows in place of those of the same key."""
    marks = [f"{STORED}{c}" for c in recency]
    if marks and set(marks) <= set(old.columns):
        theirs = old.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*marks).alias("_theirs"))
        on = [F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(keys)]
        newer = batch.join(theirs, on, "left").where(F.col("_theirs").isNull() | (F.struct(*[batch[m] for m in marks]) >= F.col("_theirs")))
        batch = materialize(newer.select(*[batch[c] for c in batch.columns]), "upsert-batch")
    missing = [c for c in old.columns if c not in batch.columns]
    fresh = batch.join(old.select(*keys, *missing), keys, "left") if missing else batch
    kept = old.join(batch.select(*keys), keys, "left_anti")
    return conform(kept.unionByName(fresh, allowMissingColumns=True), struct, complete=True)


def insert_new(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], *, day: str | None = None, schema: str | None = None) -> None:
    """Append the batch rows whose key is not stored yet; stored rows stay as they are."""
    keys = list(keys)
    if schema is not None:
        batch = conform(batch, schema, complete=True)
    batch = materialize(dedupe_latest(batch, keys, keys), "insert-batch")
    months, version = months_of(batch, day), version_of(spark, path)
    if version is None and read_table(spark, path) is not None:
        raise ValueError(f"the table at {path} has no versions yet; upsert makes the first one")
    if version is not None:
        batch, struct = _as_stored(batch, version.struct)
        batch = batch.join(_rows(spark, path, version, months).select(*keys), keys, "left_anti")
    else:
        version = Version(0, "")
        struct = batch.schema
    written = _write(conform(batch, struct, complete=True), path, day, months)
    parts = {**version.parts, **{m: [*version.parts.get(m, []), *found] for m, found in written.items()}}
    held = {m: [f for f in found if f not in written.get(m, ()) or _exists(spark, path, f)] for m, found in parts.items()}
    _commit(spark, path, Version(version.number, struct.json(), {m: found for m, found in held.items() if found}, version.merged))


def _exists(spark: SparkSession, path: str, folder: str) -> bool:
    """A month whose keys were all stored already gets no folder."""
    return bool(names_in(spark, f"{path.rstrip('/')}/{folder}"))


def snapshot(spark: SparkSession, path: str, backup: str, *, at: datetime | None = None) -> str | None:
    """Keep the table's pointer as ``backup/<name>_YYYYMMDD_HHMMSS``; None when the table is absent or empty.

    A pointer is all it takes, as no load changes a folder that is there already.
    """
    version = version_of(spark, path)
    if version is None or _rows(spark, path, version).isEmpty():
        return None
    name = path.rstrip("/").rsplit("/", 1)[-1]
    copy = f"{backup.rstrip('/')}/{name}_{(at or datetime.now()):%Y%m%d_%H%M%S}"
    if not write_new(spark, copy, json.dumps({"table": path.rstrip("/"), "version": asdict(version)}).encode()):
        raise ValueError(f"there is a snapshot {copy} already")
    return copy


def restore(spark: SparkSession, copy: str, path: str) -> None:
    """Make a snapshot the table's current version again."""
    kept = json.loads(first_bytes(spark, copy, MOST_POINTER_BYTES))
    if kept["table"] != path.rstrip("/"):
        raise ValueError(f"{copy} is a snapshot of {kept['table']}")
    current = version_of(spark, path)
    _commit(spark, path, replace(Version(**kept["version"]), number=current.number if current else 0))


def load_report(df: DataFrame, day: str, *, before: int = 0) -> DataFrame:
    """Rows now, rows added since ``before``, first and last day."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), (total - before).alias("added"),
        F.min(day).alias("min_date"), F.max(day).alias("max_date"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: (table_name, row_count)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def recent(batch: DataFrame, day: str, *, days: int | None = None, months: int | None = None) -> DataFrame:
    """Rows of the last ``days`` days, or from the month ``months`` back on, up to the batch's last day."""
    last = batch.agg(F.max(day)).scalar()
    since = F.date_sub(last, days) if days is not None else F.add_months(F.trunc(last, "month"), -(months or 0))
    return batch.where(F.col(day) >= since)


def incremental_load(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], *, day: str = "date", lookback_days: int | None = 7, lookback_months: int | None = None, schema: str | None = None) -> None:
    """Reload an overlap of recent days (or months) and upsert it; running twice changes nothing."""
    if lookback_months is not None:
        part = recent(batch, day, months=lookback_months)
    else:
        part = recent(batch, day, days=lookback_days)
    upsert(spark, path, part, keys, day=day, schema=schema)
