"""Line deduplication, near copies included: MinHash of character shingles, exact verification, union-find.

A line's signature is one-permutation MinHash: every shingle is hashed once, falls into one of the bins, and the bin keeps the
smallest hash; empty bins of short lines borrow from others by a fixed order of bins. Lines that share a band of bins are candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import _BASE, by_value, checked_side, free_name, mix, span_hashes, text_groups
from finpanel.llm.linking import link_components
from finpanel.session import materialize

by_value(__name__)

BLANK = " \t\r\x0b\x0c\x00"  # what is trimmed from lines
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 1 << 15  # characters that are hashed at once: arrays of this size stay in the cache


def line_bins(lines: list[str], size: int, bins: int) -> np.ndarray:
    """The smallest hash of each line's shingles of ``size`` characters in each bin, EMPTY where none falls; a shorter line is one shingle."""
    pad = "\0" * (size - 1)
    codes = np.frombuffer((pad.join(lines) + pad + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + len(pad))[:-1]))
    counts = np.maximum(lengths - size + 1, 1)
    line = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    hashes = mix(window_sums(codes, size)[at])
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    held = np.full(len(lines) * bins, EMPTY)
    np.minimum.at(held, line * bins + bin_, hashes)
    return held.reshape(len(lines), bins)


def window_sums(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial of each run of ``size`` codes, modulo 2**64: runs are put together from runs of 1, 2, 4 and so on."""
    base, width = _BASE, 1
    run = codes.astype(np.uint64) + np.uint64(1)
    total, done = np.zeros(len(codes), dtype=np.uint64), 0
    while True:
        n = len(codes) - size + 1
        if size & width:
            total[:n] += run[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            done += width
        width *= 2
        if width > size:
            return total[:n]
        half = width // 2
        run = run[: len(run) - half] + run[half:] * np.uint64(base)
        base = base * base % (1 << 64)


def pieces_of(line: str, size: int) -> list[str]:
    """A long line in pieces that overlap by a shingle less a character, so that they have the line's shingles."""
    return [line[i : i + PIECE + size - 1] for i in range(0, max(1, len(line) - size + 1), PIECE)]


def line_bands(lines: list[str], size: int, bands: int, rows: int) -> np.ndarray:
    """Band keys of each line. Empty bins of short lines borrow from others by a fixed order of bins; long lines are hashed piece by piece."""
    bins = bands * rows
    own, at = np.full((len(lines), bins), EMPTY), 0
    while at < len(lines):
        to, chars = at, 0
        while to < len(lines) and (to == at or chars + len(lines[to]) <= PIECE):
            chars += len(lines[to])
            to += 1
        if chars > PIECE:  # one long line
            for piece in pieces_of(lines[at], size):
                own[at] = np.minimum(own[at], line_bins([piece], size, bins)[0])
        else:
            own[at:to] = line_bins(lines[at:to], size, bins)
        at = to
    full = own.copy()
    order = np.argsort(mix(np.arange(bins * bins, dtype=np.uint64)).reshape(bins, bins), axis=1)
    lacking = np.argwhere(own == EMPTY)
    for step in range(bins):
        if not len(lacking):
            break
        borrowed = own[lacking[:, 0], order[lacking[:, 1], step]]
        full[lacking[:, 0], lacking[:, 1]] = borrowed
        lacking = lacking[borrowed == EMPTY]
    parts = full.reshape(len(lines), bands, rows)
    keys = np.zeros((len(lines), bands), dtype=np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        keys = mix(keys + parts[:, :, j])
    return keys


def digests(lines: list[str]) -> np.ndarray:
    """128 bits of each line as two longs."""
    packed = b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines)
    return np.frombuffer(packed, dtype="<i8").reshape(-1, 2)


def normal_lines(text: str | None) -> list[str]:
    """Lines as they are compared: trimmed and lower-cased."""
    return [raw.strip(BLANK).lower() for raw in text.split("\n")] if text else []


def _sign(size: int, bands: int, rows: int, most_bytes: int, named: Callable):
    names = ["key", "t", "place", "d1", "d2", "bands"]

    def run(batches):
        for part in text_groups(batches, "text", most_bytes):
            of, places, lines = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                for place, line in enumerate(normal_lines(text)):
                    if line:
                        of.append(i)
                        places.append(place)
                        lines.append(line)
            keys, both = line_bands(lines, size, bands, rows), named(lines)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            rows_of = pa.array(of, pa.int64())
            columns = [part.column("key").take(rows_of), part.column("t").take(rows_of), pa.array(places, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=names)

    return run


def items_of(line: str, size: int) -> np.ndarray:
    """Hashes of the line's shingles, sorted, each once."""
    found = []
    for piece in pieces_of(line, size):
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = min(size, len(codes))
        starts = np.arange(len(codes) - width + 1)
        found.append(np.unique(span_hashes(codes, starts, starts + width).view(np.int64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _picked(size: int, most_bytes: int):
    """The wanted lines of each text: node, line and number of distinct shingles."""

    def run(batches):
        for part in text_groups(batches, "text", most_bytes):
            nodes, lines = [], []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                own = normal_lines(text)
                nodes += [w["node"] for w in wanted]
                lines += [own[w["place"]] for w in wanted]
            sizes = pa.array([len(items_of(x, size)) for x in lines], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string()), sizes], names=["node", "items", "size"])

    return run


MOST_PLACES = 4_000_000  # lines that are named in a side that is broadcast


def _places_side(stored: DataFrame, places: str) -> DataFrame:
    """A stored table with a list of places in each row as one side of a join: broadcast if its lists are counted to be few and short."""
    whole = stored.agg(F.sum(F.size(places))).first()[0] or 0
    return checked_side(stored, 500_000) if whole <= MOST_PLACES else stored


def _text_id(text):
    """With the key, what tells one document from another that has the same key."""
    return F.xxhash64(text)


def repeated_lines(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 8, least: float = 0.8, bands: int = 10, rows: int = 4, most_bytes: int = 1_000_000, named: Callable = digests,
) -> DataFrame:
    """key, t, places: the lines (numbers from 0) that a document loses, for documents that lose any; ``t`` is the text's hash.

    Lines are compared trimmed and lower-cased. Two lines are linked if their sets of ``size``-character shingles have a Jaccard
    similarity of ``least`` or more (a shorter line is one shingle). Of the lines that links connect, in all documents and within
    one, the first stays: smallest key (null first), then place. Equal lines are found by a 128-bit hash (``named``), and that names them throughout.
    Candidates share one of the bands (at 0.8 with probability 0.995) and are verified on their text. Blank lines are never compared and
    stay. A line may be of any length.
    """
    body = F.col(f"`{text}`").cast("string")
    source = documents.select(F.col(f"`{key}`").alias("key"), _text_id(body).alias("t"), body.alias("text"))
    fields = "key {}, t long, place int, d1 long, d2 long, bands array<long>".format(source.schema["key"].dataType.simpleString())
    signed = materialize(source.mapInArrow(_sign(size, bands, rows, most_bytes, named), fields), "signed")
    members = signed.select("d1", "d2", F.explode("bands").alias("bucket"))
    ends = members.groupBy("bucket").agg(F.min("d2").alias("low"), F.max("d2").alias("high"))  # two lines that agree in d2 alone are told apart below
    several = ends.filter("low < high").select(F.col("bucket").alias("shared"))
    several = checked_side(materialize(several, "buckets"))
    shared = materialize(members.join(several, F.col("bucket") == F.col("shared"), "left_semi").distinct(), "buckets")
    nodes = materialize(shared.select("d1", "d2").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = checked_side(nodes.select(F.col("d1").alias("n1"), F.col("d2").alias("n2"), "node"))
    is_near = (F.col("d1") == F.col("n1")) & (F.col("d2") == F.col("n2"))
    state = materialize(shared.join(near, is_near).select("node", "bucket"), "buckets")
    one = signed.select("key", "t", "place", "d1", "d2").join(near, is_near).groupBy("node").agg(F.min(F.struct("key", "t", "place")).alias("one"))
    wanted = one.groupBy(F.col("one.key").alias("k"), F.col("one.t").alias("x")).agg(F.collect_list(F.struct("node", "one.place")).alias("wanted"))
    wanted = _places_side(materialize(wanted, "wanted"), "wanted")
    texts = source.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("t") == F.col("x"))).select("text", "wanted")
    lines = texts.mapInArrow(_picked(size, most_bytes), "node long, items string, size int").groupBy("node")  # repeated rows bring their lines again
    items = materialize(lines.agg(F.first("items").alias("items"), F.first("size").alias("size")), "items")  # lines are shorter than their hashes
    groups = link_components(state, items, lambda line: items_of(line, size), least=least).withColumnRenamed("node", "of")
    linked = nodes.join(groups, F.col("node") == F.col("of")).select("d1", "d2", "component")
    equal = signed.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select("d1", "d2", F.lit(None).cast("long").alias("component"))
    several = linked.unionByName(equal).groupBy(F.col("d1").alias("n1"), F.col("d2").alias("n2")).agg(F.max("component").alias("component"))
    several = checked_side(materialize(several, "groups"))
    alone = F.col("component").isNull()
    own = F.when(alone, F.col("d1")).alias("g1"), F.when(alone, F.col("d2")).alias("g2"), F.coalesce("component", F.lit(-1)).alias("g3")
    placed = materialize(signed.select("key", "t", "place", "d1", "d2").join(several, is_near).select("key", "t", "place", *own), "placed")
    first = placed.groupBy("g1", "g2", "g3").agg(F.min(F.struct("key", "place", "t")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("g1").alias("f1"), F.col("g2").alias("f2"), F.col("g3").alias("f3"), "first")
    first = checked_side(materialize(first, "firsts"))
    repeats = placed.join(first, F.col("g1").eqNullSafe(F.col("f1")) & F.col("g2").eqNullSafe(F.col("f2")) & (F.col("g3") == F.col("f3")))
    same = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("place") == F.col("first.place")) & (F.col("t") == F.col("first.t"))
    return repeats.filter(~same).groupBy("key", "t").agg(F.collect_set("place").alias("places"))


def deduplicate(documents: DataFrame, *, key: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", **options) -> DataFrame:
    """``documents`` with the repeated lines taken out of ``text``, and two columns added: how many lines that are not blank it had, and how many it lost.

    Null and empty texts stay as they are and have no line; rows that agree in key and text are one document and lose the same
    lines; an empty table gives an empty one. Other columns stay as they are; a new one whose name is taken gets underscores behind it.
    """
    names = documents.columns
    n_lines, n_dropped = free_name(n_lines, names), free_name(n_dropped, names)
    lost = repeated_lines(documents, key=key, text=text, **options)
    lost = materialize(lost.select(F.col("key").alias("k"), "t", "places"), "lost")
    lost = _places_side(lost, "places")
    rows = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    own, body = F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}").cast("string")
    joined = rows.join(lost, own.eqNullSafe(F.col("k")) & (_text_id(body) == F.col("t")), "left")
    def rest(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
        return F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n")

    once = F.transform(F.array(F.split(body, "\n", -1)), rest)  # the lines are a lambda's variable: split once
    kept = F.when(F.col("places").isNull(), body).otherwise(F.get(once, 0))
    n = F.coalesce(F.regexp_count(body, F.lit(r"[^ \t\r\x0B\x0C\x00\n][^\n]*")), F.lit(0)).cast("long")
    out = (kept.alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(names))
    return joined.select(*out, n.alias(n_lines), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias(n_dropped))
