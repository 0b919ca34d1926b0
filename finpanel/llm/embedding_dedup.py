"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Every tree splits the space again and again along random directions near the median; a vector close to a split goes down both
sides. Vectors of one label that share a leaf of any tree are compared by exact cosine, leaves of any size in blocks. A pair is
counted in the first leaf that it shares only, so counts need no list of pairs. Links then go through union-find.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, checked_side
from finpanel.llm.components import components, small_components
from finpanel.session import materialize

by_value(__name__)

TREE_BITS = 44  # a leaf's code is its tree's number above its path in the tree


def directions(trees: int, depth: int, dim: int, seed: int) -> np.ndarray:
    """A random unit vector for every level of every tree, for vectors of length ``dim``."""
    drawn = np.random.default_rng([seed, dim]).standard_normal((trees, depth, dim))
    return drawn / np.linalg.norm(drawn, axis=2, keepdims=True)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest entry first so that squares stay finite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(sample: np.ndarray, trees: int, depth: int, seed: int, least: int = 32) -> list[list[np.ndarray]]:
    """Per tree and level the split values by path. Levels that the sample can't resolve use the values of their ancestors.

    A split is the median of the sample's projections in a node, moved at random by up to a tenth of their spread.
    """
    rng = np.random.default_rng(seed + 1)
    axes = directions(trees, depth, sample.shape[1], seed)
    out = []
    for t in range(trees):
        paths, levels = np.zeros(len(sample), dtype=np.int64), []
        fine = max(0, int(math.log2(max(1, len(sample) / least))))
        for level in range(depth):
            along = sample @ axes[t, level]
            groups = paths >> max(0, level - fine)
            values = np.zeros(1 << min(level, fine))
            for g in range(len(values)):
                own = along[groups == g]
                if len(own) == 0:
                    own = along
                values[g] = np.median(own) + rng.uniform(-0.1, 0.1) * own.std()
            levels.append(values)
            paths = paths << 1 | (along > values[groups])
        out.append(levels)
    return out


def leaves_of(vectors: np.ndarray, forest: list[list[np.ndarray]], seed: int, margin: float) -> list[np.ndarray]:
    """Codes of all leaves that each vector reaches; within ``margin`` of a split it goes both ways."""
    trees, depth = len(forest), len(forest[0]) if forest else 0
    axes = directions(trees, depth, vectors.shape[1], seed)
    found: list[list[np.ndarray]] = []
    for t, levels in enumerate(forest):
        row, path = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        for level, values in enumerate(levels):
            along = (vectors @ axes[t, level])[row]
            split = values[path >> max(0, level - int(math.log2(len(values))))]
            left, right = along <= split + margin, along > split - margin
            row = np.concatenate([row[left], row[right]])
            path = np.concatenate([path[left] << 1, path[right] << 1 | 1])
        found.append([row, path + (t << TREE_BITS)])
    rows, codes = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    order = np.lexsort((codes, rows))
    return np.split(codes[order], np.searchsorted(rows[order], np.arange(1, len(vectors))))


def _route(forest, seed: int, margin: float):
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            codes: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                own = leaves_of(unit_rows(np.array([vectors[i] for i in at], dtype=np.float64)), forest.value.get(int(dim), forest.value[None]), seed, margin)
                for i, c in zip(at, own):
                    codes[i] = c
            columns = [batch.column(c) for c in ("node", "label", "copies", "vector")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.list_(pa.int64()))], names=["node", "label", "copies", "vector", "codes"])

    return run


def _covered(one: list[np.ndarray], two: list[np.ndarray], code: int) -> np.ndarray:
    """For rows of two blocks: whether they share a leaf whose code is below ``code``."""
    known = np.unique(np.concatenate([c[c < code] for c in one + two])) if one else np.zeros(0, np.int64)

    def marks(codes):
        out = np.zeros((len(codes), len(known)), dtype=np.float32)
        for i, c in enumerate(codes):
            out[i, np.searchsorted(known, c[c < code])] = 1
        return out

    return (marks(one) @ marks(two).T) > 0


def _compare(least: float):
    """Group function: links between two blocks of a leaf that no earlier leaf has; per node a count, and links for a forest."""
    columns = ["node", "n", "root"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        code, low, high = rows["code"].iloc[0], rows["low"].iloc[0], rows["high"].iloc[0]
        rows = rows.sort_values("node", kind="stable")
        vectors = rows["vector"].to_numpy()
        dims = np.array([len(v) for v in vectors])
        parts = []
        for dim in np.unique(dims):
            own = rows[dims == dim]
            if len(own) < 2:
                continue
            unit = unit_rows(np.array([np.asarray(v, dtype=np.float64) for v in own["vector"]]))
            linked = unit @ unit.T >= least
            np.fill_diagonal(linked, False)
            if low != high:
                block = own["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            linked = linked[np.ix_(some, some)]
            codes = [np.asarray(own["codes"].iloc[i]) for i in some]
            linked &= ~_covered(codes, codes, code)
            nodes, copies = own["node"].to_numpy()[some], own["copies"].to_numpy()[some]
            root = nodes[small_components(linked)]
            parts.append(pd.DataFrame({"node": nodes, "n": linked @ copies, "root": root}))
        found = pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        return found[found["n"] > 0][columns]

    return run


def links(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, trees: int = 8, leaf: int = 128, block: int = 512,
    most_sample: int = 20_000, most_numbers: int = 8_000_000, seed: int = 11,
) -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (smallest key reached by links), kept (key is that one).

    Rows are linked if their labels are equal and not null and the cosine of their vectors, in double precision, is ``least`` or more.
    The trees are fitted on at most ``most_sample`` (20,000) distinct vectors with at most ``most_numbers`` (8,000,000) components, the first by hash; all
    vectors go down them, in the precision that they have in the table. Depth follows the
    largest label, so that leaves hold some ``leaf`` vectors; a leaf that a dense cluster overfills is compared in pairs of blocks of
    ``block`` rows, all of them. The overlap is half the standard deviation of the distance along a random direction of a pair just linked.
    Equal vectors of a label are one node with a count from the start. Recall against all pairs: see README.

    Linked with nothing: rows whose label is null, or whose vector is null, empty, zero, or has null or non-finite entries; vectors of
    different length. Repeated rows are rows of their own; a null key counts as missing in component_id. Only the named columns are read.
    """
    spark = vectors.sparkSession
    values = F.transform(F.col("vector"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists(values, lambda x: x != 0), F.lit(False))
    kind = rows.schema["vector"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = rows.select("key", "label", F.col("vector").cast(kind).alias("vector"), usable.alias("usable"))
    rows = rows.withColumns({"d1": F.xxhash64(F.lit(1), "vector"), "d2": F.xxhash64(F.lit(2), "vector")})
    nodes = rows.filter("usable").groupBy("label", "d1", "d2").agg(F.first("vector").alias("vector"), F.min("key").alias("least_key"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    longest = nodes.agg(F.max(F.size("vector"))).first()[0] or 1
    drawn = nodes.orderBy(F.xxhash64("d1", "d2")).select("vector").limit(min(most_sample, max(1, most_numbers // longest))).toArrow().column("vector").combine_chunks()
    edges, numbers = drawn.offsets.to_numpy(), drawn.values.to_numpy(zero_copy_only=False)
    sample = [numbers[a:b].astype(np.float64) for a, b in zip(edges[:-1], edges[1:])]
    depth = max(0, math.ceil(math.log2(max(1, largest) / leaf)))
    forests = {}
    for dim in {len(v) for v in sample}:
        forests[dim] = fit(unit_rows(np.array([v for v in sample if len(v) == dim])), trees, depth, seed)
    forests[None] = [[np.zeros(1)] * depth for _ in range(trees)]
    dims = [len(v) for v in sample] or [1]
    margin = 0.5 * math.sqrt(2 - 2 * least) / math.sqrt(sum(dims) / len(dims))
    fields = nodes.schema["label"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(forests)
    routed = materialize(nodes.select("node", "label", "copies", "vector").mapInArrow(_route(shared, seed, margin), f"node long, label {fields}, copies long, vector {kind}, codes array<long>"), "routed")
    spread = routed.withColumn("code", F.explode("codes"))
    large = spread.groupBy(F.col("label").alias("in"), F.col("code").alias("at")).agg(F.count("*").alias("held")).filter(F.col("held") > block)
    large = checked_side(materialize(large.withColumn("blocks", F.ceil(F.col("held") / block).cast("int")).drop("held"), "leaves"))
    spread = spread.join(large, (F.col("label") == F.col("in")) & (F.col("code") == F.col("at")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("node", "label", "copies", "vector", "codes", "code", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = spread.groupBy("label", "code", "low", "high").applyInPandas(_compare(least), "node long, n long, root long")
    found = materialize(found, "links")
    counts = found.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("in"), "component")
    named = nodes.select("node", "label", "d1", "d2", "least_key", "copies").join(counts, F.col("node") == F.col("of"), "left").join(groups, F.col("node") == F.col("in"), "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy(F.col("component").alias("c")).agg(F.min("least_key").alias("component_id"))
    named = named.join(lowest, F.col("component") == F.col("c")).select(
        F.col("label").alias("l"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    named = checked_side(materialize(named, "named"))
    joined = rows.filter("usable").select("key", "label", "d1", "d2").join(named, (F.col("label") == F.col("l")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    rest = rows.filter(~F.col("usable")).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = joined.select("key", "n_links", "component_id").unionByName(rest)
    return both.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
