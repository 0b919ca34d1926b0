"""What the operators of this subpackage share: task functions by value, words as hashes, batches of text."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(module: str) -> None:
    """Send functions of ``module`` to the executors as code, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all names in ``taken``, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def shared(spark: SparkSession, thing):
    """Broadcast an object's plain data, which workers can read without the package; ``own`` makes it the object again."""
    return spark.sparkContext.broadcast(vars(thing))


def own(kind: type, handle):
    thing = object.__new__(kind)
    vars(thing).update(handle.value)
    return thing


def checked_side(stored: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A stored table of narrow rows as one side of a join: broadcast if counted to be small, else left to a shuffled join."""
    return F.broadcast(stored) if stored.limit(most_rows + 1).count() <= most_rows else stored


def text_groups(batches, column: str, most_bytes: int):
    """Cut Arrow batches into runs of rows whose texts have about ``most_bytes`` together (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


GAPS = np.zeros(256, dtype=bool)  # bytes that end a word: white space
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept for the life of the worker."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers evenly (published constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every pair; equal bytes have equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """Hash of each run of bytes without white space, in order. Long texts go in pieces cut between words."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + piece)
        data = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        if end < len(text):
            gaps = np.flatnonzero(GAPS[data])
            if not len(gaps):  # one word fills the piece: take more
                piece *= 2
                continue
            end = at + int(gaps[-1]) + 1
            data = data[: end - at]
        word = ~GAPS[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        out.append(span_hashes(data, edge[0::2], edge[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter text with words is one shingle, a text without has none."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        total += mix(words[j : n - size + 1 + j] + _PLACES[j]) * _PLACES[j]
    return mix(total + np.uint64(size))
