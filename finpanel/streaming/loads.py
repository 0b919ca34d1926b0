"""Incremental loads as a stream: new files of a folder are merged into a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from finpanel.sources.tables import upsert, version_of


def stream_upsert(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    keys: Sequence[str],
    *,
    day: str,
    progress: str,
    clean: Callable[[DataFrame], DataFrame] | None = None,
    recency: Sequence[str] = (),
    schema: str | None = None,
) -> StreamingQuery:
    """Merge everything new in the streaming ``source`` into the table, then stop.

    Files are taken once (``progress`` keeps track, in a shared folder). The table's version notes the last micro-batch it holds, so one that is
    repeated after a failure is merged once. Of equal keys the greatest by ``recency`` counts, in one micro-batch and across them: it is stored with the
    rows, and a file that arrives late changes nothing that is newer. Give the source a column that tells, such as the file's name.
    """

    def merge(batch: DataFrame, number: int) -> None:
        version = version_of(spark, path)
        if version is None or version.merged.get(progress, -1) < number:
            rows = clean(batch) if clean else batch
            upsert(spark, path, rows, keys, day=day, recency=recency, keep_recency=bool(recency), schema=schema, merged={progress: number})

    return (
        source.writeStream.foreachBatch(merge)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
