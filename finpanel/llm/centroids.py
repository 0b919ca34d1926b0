"""Centroid clustering with the threshold algorithm: the nearest centroid from sorted lists, one per dimension.

Every dimension has the centroids sorted by their value in it. From a vector's own value a walk goes outward in all lists, one
centroid further per step. A centroid that is met for the first time gets its exact distance. One that has not been met is at least as far in each
dimension as the walk's frontier there, so once the sum over the frontiers strictly exceeds the best distance, no centroid is left
that could win or tie. All of it is integer arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, own, shared

by_value(__name__)

MOST = 1 << 26  # components beyond this would not leave room for squared distances in 64 bits


class Lists:
    """Centroids, and for each dimension their values in ascending order with the centroids' numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller one of ties), its squared distance, and how many centroids were met, per row."""
        k, dims = self.centroids.shape
        n = len(rows)
        cluster, best, met = np.full(n, k, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        at = np.arange(n)  # rows still walking
        up = np.stack([np.searchsorted(self.values[:, d], rows[:, d]) for d in range(dims)], axis=1) if n else np.zeros((0, dims), np.int64)
        down, seen = up - 1, np.zeros((n, k), dtype=bool)
        column = np.arange(dims)
        far = np.iinfo(np.int64).max
        while len(at):
            x = rows[at]
            above = np.where(up < k, np.abs(self.values[np.minimum(up, k - 1), column] - x), far)
            below = np.where(down >= 0, np.abs(x - self.values[np.maximum(down, 0), column]), far)
            rise = above <= below
            number = self.order[np.where(rise, np.minimum(up, k - 1), np.maximum(down, 0)), column]
            frontier = np.where(rise, above, below)
            up, down = up + rise, down - ~rise
            now = np.zeros((len(at), k), dtype=bool)
            now[np.arange(len(at))[:, None], number] = True
            new = now & ~seen
            seen |= now
            row, centroid = np.nonzero(new)
            distance = np.full((len(at), k), far)
            for first in range(0, len(row), 1 << 15):
                part = slice(first, first + (1 << 15))
                distance[row[part], centroid[part]] = ((x[row[part]] - self.centroids[centroid[part]]) ** 2).sum(axis=1)
            winner = distance.argmin(axis=1)  # the first, so the smallest number
            least = distance[np.arange(len(at)), winner]
            better = (least < best[at]) | (least == best[at]) & (winner < cluster[at])
            cluster[at[better]], best[at[better]] = winner[better], least[better]
            go = ((frontier**2).sum(axis=1) <= best[at]) & ~seen.all(axis=1)
            met[at[~go]] = seen[~go].sum(axis=1)
            at, up, down, seen = at[go], up[go], down[go], seen[go]
        return cluster, best, met


def _whole(column, dims: int, scale: int) -> np.ndarray:
    """Arrow lists of ``dims`` numbers as rows of integers floor(scale * x), in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.floor(scale * flat).reshape(-1, dims)
    if rows.size and np.abs(rows).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}: squared distances would not fit in 64 bits")
    return rows.astype(np.int64)


def _parts(batches, column: str, dims: int, scale: int, most_rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, most_rows):
            part = batch.slice(at, most_rows)
            yield part, _whole(part.column(column), dims, scale)


def _sums(handle, dims: int, scale: int, most_rows: int):
    """One row per cluster that a task's vectors fall in: cluster, n, sums."""

    def run(batches):
        lists = own(Lists, handle)
        k = len(lists.centroids)
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, rows in _parts(batches, "v", dims, scale, most_rows):
            cluster = lists.nearest(rows)[0]
            np.add.at(sums, cluster, rows)
            counts += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
            )

    return run


def _assigned(handle, dims: int, scale: int, most_rows: int):
    def run(batches):
        lists = own(Lists, handle)
        for part, rows in _parts(batches, "v", dims, scale, most_rows):
            cluster, distance, met = lists.nearest(rows)
            columns = [part.column("key"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(met, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "cluster", "distance", "met"])

    return run


class Clustering:
    """``centroids``: one array of integers per cluster. ``vectors``: the rows that were kept (key, v)."""

    def __init__(
        self, vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:", most_rows: int = 4096,
    ):
        """Fit ``k`` centroids in ``rounds`` rounds.

        Vectors count with exactly ``dims`` components, none of them null, NaN or infinite; component x becomes floor(scale * x), and one beyond 2**26 is an
        error, as distances would not fit. Centroids start as the ``k`` vectors with the smallest SHA-256 of ``salt`` and the key, in that order; equal
        keys are ordered by their components, null keys come last. Repeated rows are vectors of their own; of equal centroids only the one with the smaller
        number gets vectors. With fewer vectors than ``k`` there are as many centroids as vectors; an empty table has none. Only the named columns are
        read, so others cannot clash.

        Every round reads the vectors once and sends one row per task and cluster on, so a cluster of any size is no hot key. What is broadcast and what
        reaches the driver has k rows. Sums are exact: 64 bits in a task, decimals across tasks.
        """
        spark = vectors.sparkSession
        v = F.col(f"`{vector}`")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        kept = F.coalesce((F.size(v) == dims) & finite, F.lit(False))
        self.vectors = vectors.filter(kept).select(F.col(f"`{key}`").alias("key"), v.alias("v"))
        self.dims, self.scale, self.most_rows = dims, scale, most_rows
        first = self.vectors.select(F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
        start = first.toArrow()
        self.centroids = _whole(start.column("v").combine_chunks(), dims, scale)
        for _ in range(rounds if len(self.centroids) else 0):
            lists = shared(spark, Lists(self.centroids))
            found = self.vectors.mapInArrow(_sums(lists, dims, scale, most_rows), "cluster int, n long, sums array<long>")
            totals = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
            moved = self.centroids.copy()
            for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # one row per cluster
                moved[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dims)]
            self.centroids = moved
            lists.unpersist()

    def assigned(self) -> DataFrame:
        """key, cluster, distance (squared) and met (centroids whose distance was computed) of every vector that counts."""
        kind = self.vectors.schema["key"].dataType.simpleString()
        lists = shared(self.vectors.sparkSession, Lists(self.centroids))
        return self.vectors.mapInArrow(_assigned(lists, self.dims, self.scale, self.most_rows), f"key {kind}, cluster int, distance long, met int")
