"""Near-duplicate documents by BagMinHash signatures over multisets of word shingles.

Every shingle's weight axis is cut into the intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; each has a Poisson process of points,
seeded by shingle and interval, with a place on the axis, a time, and a register. A register of a document holds the first time
among points below the document's weights, so two registers agree with exactly the probability of the weighted Jaccard
similarity. Points are drawn in order of time and a process stops at the latest time any register still waits for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, checked_side, mix, shingle_hashes, text_groups, word_hashes
from finpanel.llm.linking import link_components, shared_buckets
from finpanel.session import materialize

by_value(__name__)

_UNIT = 2.0**-53


def _unit(bits: np.ndarray) -> np.ndarray:
    """Numbers above 0 and up to 1 from 64 bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def bag_signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, n_owners: int, registers: int) -> np.ndarray:
    """Registers (first times) of each owner's multiset, given as rows owner, item hash, whole weight (each pair once)."""
    held = np.full(n_owners * registers, np.inf)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # intervals that begin below the weight
    row = np.repeat(np.arange(len(owner)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    high = 2.0**level
    own, limit = owner[row], weight[row].astype(np.float64)
    seed = mix(item[row] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    time = np.zeros(len(row))
    order = np.argsort(own, kind="stable")
    own, limit, low, high, seed, time = own[order], limit[order], low[order], high[order], seed[order], time[order]
    while len(own):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(_unit(seed)) / (high - low)
        more = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        register = (more % np.uint64(registers)).astype(np.int64)
        place = low + (high - low) * _unit(mix(more)) if len(own) else low
        counts = place <= limit
        np.minimum.at(held, (own * registers + register)[counts], time[counts])
        first = np.flatnonzero(np.diff(own, prepend=-1))  # owners that still draw, each once
        latest = held.reshape(n_owners, registers)[own[first]].max(axis=1)
        alive = time < np.repeat(latest, np.diff(first, append=len(own)))
        own, limit, low, high, seed, time = own[alive], limit[alive], low[alive], high[alive], seed[alive], time[alive]
    return held.reshape(n_owners, registers)


def band_keys(held: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of registers; equal registers give equal keys."""
    bits = held.view(np.uint64).reshape(len(held), bands, -1)
    keys = np.full(bits.shape[:2], 0, dtype=np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(bits.shape[2]):
        keys = mix(keys + bits[:, :, j])
    return keys


def bag_of(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, sorted, and their counts."""
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "surrogatepass")), size), return_counts=True)


def items_of(text: str, size: int) -> np.ndarray:
    """The multiset as a sorted set, the n-th occurrence of a shingle an item of its own: Jaccard similarity of such sets is the weighted one."""
    bag, counts = bag_of(text, size)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(mix(np.repeat(bag, counts) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def _itemised(size: int):
    def run(batches):
        for batch in batches:
            lists = pa.array([items_of(t, size) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, lists.value_lengths()], names=["node", "items", "size"])

    return run


def _sign(size: int, bands: int, rows: int, most_bytes: int):
    def run(batches):
        for part in text_groups(batches, "text", most_bytes):
            bags = [bag_of(t, size) for t in part.column("text").to_pylist()]
            n = np.array([len(b[0]) for b in bags])
            some = np.flatnonzero(n)
            keys = np.zeros((0, bands), dtype=np.uint64)
            if len(some):
                owner = np.repeat(np.arange(len(some)), n[some])
                held = bag_signatures(owner, np.concatenate([bags[i][0] for i in some]), np.concatenate([bags[i][1] for i in some]), len(some), bands * rows)
                keys = band_keys(held, bands)
            offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("key", "d1", "d2")] + [lists], names=["key", "d1", "d2", "bands"])

    return run


def _digests(text):
    """Two 64-bit hashes that stand for the text; rows with both equal are copies."""
    return F.xxhash64(F.lit(1), text).alias("d1"), F.xxhash64(F.lit(2), text).alias("d2")


def classes(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, bands: int = 20, rows: int = 6, most_bytes: int = 2_000_000,
) -> DataFrame:
    """Per row: key, d1, d2 (digests of the text), class_id (smallest key of its class).

    Two texts are linked if their multisets of ``size``-word shingles (lower-cased, words parted by white space; a shorter text is
    one shingle) overlap by ``least`` or more (weighted Jaccard); classes are what links connect. Equal texts are one node from the start,
    reduced before any exchange of signatures. Candidates share a band of registers and are verified on their texts; at similarity 0.8
    a pair shares one of 20 bands of 6 with probability 0.997.

    Null texts and texts without words are linked with nothing, not even each other: each is a class of its own. Repeated rows are
    copies. A null key sorts before others in its class only if it is alone. Only the named columns are read.
    """
    body = F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    source = documents.select(F.col(f"`{key}`").alias("key"), body.alias("text")).select("key", *_digests(F.col("text")), "text")
    signed = materialize(source.mapInArrow(_sign(size, bands, rows, most_bytes), "key long, d1 long, d2 long, bands array<long>"), "signed")
    nodes = signed.filter("size(bands) > 0").groupBy("d1", "d2").agg(F.min("key").alias("least_key"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared = shared_buckets(nodes.select("node", F.explode("bands").alias("bucket")))
    near = shared.select(F.col("node").alias("near")).distinct()
    wanted = materialize(nodes.join(near, F.col("node") == F.col("near"), "left_semi").select("node", F.col("d1").alias("w1"), F.col("d2").alias("w2")), "wanted")
    texts = source.join(checked_side(wanted), (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))).groupBy("node").agg(F.first("text").alias("text"))
    items = materialize(texts.mapInArrow(_itemised(size), "node long, items array<long>, size int"), "items")
    groups = link_components(shared, items, least=least)
    named = nodes.select("node", F.col("d1").alias("w1"), F.col("d2").alias("w2"), "least_key").join(groups.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy(F.col("component").alias("c")).agg(F.min("least_key").alias("class_id"))
    named = materialize(named.join(lowest, F.col("component") == F.col("c")).select("w1", "w2", "class_id"), "classes")
    found = signed.filter("size(bands) > 0").join(named, (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2")))
    rest = signed.filter("size(bands) = 0")
    return found.select(F.col("key").alias(key), "d1", "d2", "class_id").unionByName(rest.select(F.col("key").alias(key), "d1", "d2", F.col("key").alias("class_id")))


def deduplicate(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` with one row of each class of near copies, the one with the smallest key; all columns as they were.

    Of rows with one key and text one stays. Rows without words all stay (see ``classes``).
    """
    names = documents.columns
    judged = materialize(classes(documents, key=key, text=text, **options), "judged")
    gone = judged.filter(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("gone"), F.col("d1").alias("g1"), F.col("d2").alias("g2")).distinct()
    gone = checked_side(materialize(gone, "gone"))
    rows = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    body = F.col(f"c{names.index(text)}").cast("string")
    rows = rows.select("*", *_digests(F.lower(F.coalesce(body, F.lit("")))), body.rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    kept = rows.join(gone, F.col(f"c{names.index(key)}").eqNullSafe(F.col("gone")) & (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")), "left_anti")
    repeated = judged.filter(F.col(key).eqNullSafe(F.col("class_id"))).groupBy(key, "d1", "d2").count().filter("count > 1")
    if not repeated.isEmpty():
        plain = kept.filter(~F.coalesce("worded", F.lit(False)))
        kept = kept.filter("worded").dropDuplicates([f"c{names.index(key)}", "d1", "d2"]).unionByName(plain)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
