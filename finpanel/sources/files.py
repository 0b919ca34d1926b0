"""Small files in any store that Spark reaches: first bytes, names in a folder, files that are written once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def first_bytes(spark: SparkSession, path: str, size: int) -> bytes:
    """At most the first ``size`` bytes of a file."""
    where, store = _store(spark, path)
    stream = store.open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none if it does not exist."""
    where, store = _store(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def write_new(spark: SparkSession, path: str, content: bytes) -> bool:
    """Write a file that must not exist yet; False if it does."""
    where, store = _store(spark, path)
    if store.exists(where):
        return False
    stream = store.create(where, False)
    try:
        stream.write(content, 0, len(content))
    finally:
        stream.close()
    return True
