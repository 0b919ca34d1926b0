"""Connected components of links by distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value
from finpanel.session import materialize

by_value(__name__)


class Sets:
    """Union-find over any integers; the root of a set is its smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches):
    """Links of one task as node, root of its own union-find: one row for every node, roots included."""
    sets, schema = Sets(), None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(a, b)
            sets.up.setdefault(sets.root(a), sets.root(a))
    if schema is None:
        return
    nodes = list(sets.up)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([sets.root(n) for n in part], pa.int64())], schema=schema)


def components(links: DataFrame, *, most_links: int = 200_000, stored: bool = False) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (long columns a, b; order and repeats don't matter).

    Tasks of at most about ``most_links`` links each shrink theirs to a forest, node to root. Across tasks a node hangs on the smallest of
    its roots, and the roots that it thereby joins are links for the next round, whose nodes are at most half as many, until one task's
    share holds all that is left. The rounds' answers are then put together backwards. A node has at most one row per task, so a
    hub is no hot key. Rounds write to the shared folder. A link of a node with itself makes a component of one; no links, no rows. Links that are
    read from stored tables anyway (``stored``) are not written again. The result is stored.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    if not stored:
        edges = materialize(edges, "components")
    layers = []
    while True:
        tasks = -(-edges.count() // most_links)
        dealt = edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks)
        forest = dealt.mapInArrow(_forest, "a long, b long")
        if tasks <= 1:
            layers.append(materialize(forest.toDF("node", "up"), "components"))
            break
        forest = materialize(forest, "components")  # with every root hanging on itself
        ups = materialize(forest.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "components")
        layers.append(ups)
        edges = materialize(forest.join(ups, F.col("a") == F.col("node")).filter("b <> up").select(F.col("b").alias("a"), F.col("up").alias("b")).distinct(), "components")
    found = layers.pop().withColumnRenamed("up", "component")
    deep = len(layers) > 0
    while layers:
        above = found.select(F.col("node").alias("of"), "component")
        found = layers.pop().join(above, F.col("up") == F.col("of"), "left").select("node", F.coalesce("component", "up").alias("component"))
    return materialize(found, "components") if deep else found


def small_components(linked: np.ndarray) -> np.ndarray:
    """Component (smallest index) of each row of a square matrix of links."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        lower = np.where(reach, label[None, :], len(linked)).min(axis=1)
        lower = lower[lower]
        if np.array_equal(lower, label):
            return label
        label = lower
