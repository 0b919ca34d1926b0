"""Links between the members of buckets, complete up to components, without writing out the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, checked_side
from finpanel.llm.components import components
from finpanel.session import materialize

by_value(__name__)


def shared_buckets(members: DataFrame) -> DataFrame:
    """node, bucket of the buckets with two nodes or more, each row once; stored.

    Counting shrinks a frequent bucket before the shuffle. Few buckets are shared, so they are mostly small enough to broadcast.
    """
    rows = members.select("node", "bucket")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select(F.col("bucket").alias("shared"))
    shared = checked_side(materialize(shared, "buckets"))
    return materialize(rows.join(shared, F.col("bucket") == F.col("shared"), "left_semi").distinct(), "buckets")


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Jaccard similarity of two sets given as sorted arrays; 0 for two empty ones."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one):
        return 0.0
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    shared = int((two[at] == one).sum())
    return shared / (len(one) + len(two) - shared)


def similarities(pairs: DataFrame, items: DataFrame, read: Callable, least: float) -> DataFrame:
    """a, b, sim for pairs a, b; for ``items`` and ``read`` see ``link_components``. A frequent node is spread by adaptive skew joins.

    A pair whose sizes alone keep it below ``least`` is not read and has no sim.
    """

    def similarity(one: pd.Series, two: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        out, last, known = [], None, None
        for a, b, m, n in zip(one, two, n1, n2):
            if min(m, n) < least * max(m, n):
                out.append(None)
                continue
            if known is None or b is not last and not np.array_equal(b, last):
                last, known = b, read(b)  # rows come sorted by b
            out.append(jaccard(read(a), known))
        return pd.Series(out, dtype="float64")

    one, two = (items.select(F.col("node").alias(f"n{i}"), F.col("items").alias(f"i{i}"), F.col("size").alias(f"s{i}")) for i in "12")
    both = pairs.join(one, F.col("a") == F.col("n1")).join(two, F.col("b") == F.col("n2"))
    return both.select("a", "b", F.pandas_udf(similarity, "double")("i1", "i2", "s1", "s2").alias("sim"))


FEW = 24  # members of a group whose pairs are compared in a plain loop


def _cells(column) -> list:
    """Values of an Arrow column, lists as slices of one array."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    whole, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [whole[x:y] for x, y in zip(edges[:-1], edges[1:])]


FIELDS = ("node", "component", "block", "size", "known", "open", "items")


def _runs(batches, keys: tuple[str, ...]):
    """Groups of sorted rows: key and one list per field. A group may go on in the next batch."""
    now, held = None, None
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        cells = [_cells(batch.column(f)) for f in FIELDS]
        for x, y in zip(edges[:-1], edges[1:]):
            if x == y:
                continue
            mine, part = tuple(key[:, x].tolist()), [c[x:y] for c in cells]
            if mine == now:
                held = [h + p for h, p in zip(held, part)]
                continue
            if now is not None:
                yield now, held
            now, held = mine, part
    if now is not None:
        yield now, held


def _left_over(least: float, read: Callable):
    """Links of a bucket's two blocks between nodes that are not connected.

    A pair that shares several open buckets is compared in one of them, chosen by the pair.
    """
    apart_by = 1 - least + 1e-9

    def few(bucket, apart, node, component, block, size, known, open_, items):
        sets, sets_of, out = [set(o.tolist()) for o in open_], {}, []
        for i, j in combinations(range(len(node)), 2):
            if component[i] == component[j] or apart and block[i] == block[j] or min(size[i], size[j]) < least * max(size[i], size[j]):
                continue
            if any(abs(x - y) > apart_by for x, y in zip(known[i].tolist(), known[j].tolist())):  # false for a distance that isn't known
                continue
            shared = sets[i] & sets[j]
            if len(shared) > 1 and sum(x < bucket for x in shared) != (node[i] % 1_000_003 + node[j] % 1_000_003) % len(shared):
                continue
            for x in (i, j):
                if x not in sets_of:
                    sets_of[x] = read(items[x])
            if jaccard(sets_of[i], sets_of[j]) >= least:
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        return out

    def many(bucket, apart, *columns):
        nodes, component, block, size = (np.array(c) for c in columns[:4])
        known, open_, items = columns[4:]
        may = (component[:, None] != component[None, :]) & (nodes[:, None] < nodes[None, :])
        if apart:
            may &= block[:, None] != block[None, :]
        may &= np.minimum(size[:, None], size[None, :]) >= least * np.maximum(size[:, None], size[None, :])
        far = np.array([d.tolist() for d in known], dtype=np.float64)
        for d in far.T:
            with np.errstate(invalid="ignore"):
                may &= ~(np.abs(d[:, None] - d[None, :]) > apart_by)
        buckets = np.unique(np.concatenate(open_))
        marks = np.zeros((len(nodes), len(buckets)), dtype=np.float32)
        for i, own in enumerate(open_):
            marks[i, np.searchsorted(buckets, own)] = 1
        before = marks[:, : np.searchsorted(buckets, bucket)]
        short = nodes % 1_000_003
        may &= (before @ before.T) == (short[:, None] + short[None, :]) % np.maximum(marks @ marks.T, 1)
        wanted = np.flatnonzero(may.any(axis=0) | may.any(axis=1))
        sets = {i: read(items[i]) for i in wanted.tolist()}
        return [(int(nodes[i]), int(nodes[j])) for i, j in zip(*(x.tolist() for x in np.nonzero(may))) if jaccard(sets[i], sets[j]) >= least]

    def run(batches):
        out = []
        for (bucket, low, high), columns in _runs(batches, ("bucket", "low", "high")):
            out += (few if len(columns[0]) <= FEW else many)(bucket, low != high, *columns)
            if len(out) >= 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def link_components(state: DataFrame, items: DataFrame, read: Callable = np.asarray, *, least: float = 0.8, pivots: int = 2, block: int = 256, block_items: int = 2_000_000) -> DataFrame:
    """node, component of all nodes that are linked, directly or not, with another one of a common bucket.

    ``state``: node, bucket (longs), as ``shared_buckets`` gives them. ``items``: node, items, size; ``read`` makes of ``items``
    the node's items as a sorted array without repeats, of that size. Two nodes are linked if the Jaccard similarity of their items
    is ``least`` or more.

    In every round each bucket compares one member, the pivot, with its other members, and drops the pivot: all pairs of the
    pivot are then settled. The member that shares the most buckets with others is the pivot, as the text that a group of copies was
    made from agrees with most of them. Members that are connected already need no comparison, so a large group of copies is
    done after a round or two, in as many comparisons as it has members. What ``pivots`` rounds leave are unlinked members of buckets
    whose signature is no proof. They are compared with all members that they aren't connected with, bucket by bucket in pairs of
    blocks of bounded rows and items, each pair in one bucket only. Jaccard distance is a metric, so a pair whose distances to a
    common pivot differ by more than a link allows needs no comparison. No link is lost.
    """
    sizes = state.groupBy("bucket").agg(F.count("*").alias("n"))
    degree = state.join(sizes.withColumnRenamed("bucket", "of"), F.col("bucket") == F.col("of")).groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("degree"))
    known = F.expr("CAST(array() AS array<double>)").alias("known")
    state = materialize(state.join(degree, F.col("node") == F.col("of")).select("node", "bucket", "degree", F.col("node").alias("component"), known), "buckets")
    groups = None
    for _ in range(pivots):
        if state.isEmpty():
            break
        top = F.max(F.struct("degree", (-F.col("node")).alias("neg"), "component"))
        best = state.groupBy(F.col("bucket").alias("at")).agg(top.alias("top")).select("at", (-F.col("top.neg")).alias("pivot"), F.col("top.component").alias("theirs"))
        met = materialize(state.join(best, F.col("bucket") == F.col("at")).filter("node <> pivot").drop("at"), "buckets")
        pairs = met.filter("component <> theirs").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        sims = materialize(similarities(pairs, items, read, least), "pairs")
        links = sims.filter(F.col("sim") >= least).select("a", "b")
        if groups is not None:
            links = links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        groups = components(links, stored=True)
        named = checked_side(groups.withColumnRenamed("node", "of").withColumnRenamed("component", "c"))
        near = met.join(checked_side(sims), (F.col("node") == F.col("a")) & (F.col("pivot") == F.col("b")), "left").join(named, F.col("node") == F.col("of"), "left")
        near = near.select("node", "bucket", "degree", F.coalesce("c", "node").alias("component"), F.concat("known", F.array(1 - F.col("sim"))).alias("known"))
        open_ = near.groupBy(F.col("bucket").alias("at")).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("at")
        state = materialize(near.join(checked_side(materialize(open_, "buckets")), F.col("bucket") == F.col("at"), "left_semi"), "buckets")
    if groups is None:
        return state.select("node", "component")
    if not state.isEmpty():
        sized = state.join(items.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
        blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_items)).cast("int")
        lengths = items.select(F.col("node").alias("of"), "size")
        held = state.join(lengths, F.col("node") == F.col("of")).groupBy(F.col("bucket").alias("at")).agg(blocks.alias("blocks"))
        all_ = state.groupBy(F.col("node").alias("of")).agg(F.collect_set("bucket").alias("open"))
        rows = sized.join(checked_side(materialize(held, "blocks")), F.col("bucket") == F.col("at")).join(all_, F.col("node") == F.col("of"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("node", "bucket", "component", "known", "open", "size", "items", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        ranked = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
        links = ranked.mapInArrow(_left_over(least, read), "a long, b long")
        groups = components(links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return groups
