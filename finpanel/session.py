"""Session helpers: settings the package relies on, and where shared intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "finpanel", *, master: str | None = None, **conf: str) -> SparkSession:
    """Session with AQE (coalescing and skew joins) and a fixed time zone.

    Cluster sizing (shuffle partitions, memory, scan split size) is left to the submitter; pass it in
    ``conf`` with dots written as double underscores, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder of its own. On a
    cluster a machine-local folder would lose data with its executor, so an unset value is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="finpanel-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


_SCOPE: ContextVar[str] = ContextVar("scratch scope", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder, inside the current ``scratch_scope`` if there is one."""
    return f"{shared_folder(spark)}{_SCOPE.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """Intermediate tables that are made inside are removed at the end. Results must be written elsewhere or collected before."""
    token = _SCOPE.set(f"{_SCOPE.get()}/{name}-{uuid.uuid4().hex}")
    folder = shared_folder(spark) + _SCOPE.get()
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str = "stage", *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several later passes read only the
    columns they need instead of repeating the windows and shuffles above. The last columns can be named
    in ``by``: passes over some of their values then read only those.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
