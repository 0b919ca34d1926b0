"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

Every document is a sparse vector: its words, hashed and weighted by the logarithm of their counts, and one entry for the range
that each statistic of its structure falls in. The machine adds a bias, a weight per entry, and for each pair of entries the inner product of two
short vectors; all pairs together cost linear time, as half of the squared sum less the sum of squares per factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, mix, own, shared, shingle_hashes, text_groups, word_hashes
from finpanel.session import materialize

by_value(__name__)

WORD_BITS, RANGES = 14, 10
N_STATISTICS = 17
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#$%&*@^~<>{}[]\\/_=+`")] = True


def statistics(raw: bytes, words: np.ndarray, counts: np.ndarray, n_chars) -> np.ndarray:
    """Structure of a text, from its bytes, its word hashes in order and their counts; and its length as the table says."""
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size, n = max(1, len(raw)), max(1, len(words))
    spaces = seen[[32, 9, 10, 11, 12, 13]].sum()
    solid, lines = max(1, len(raw) - spaces), seen[10] + 1
    letters = max(1, seen[65:91].sum() + seen[97:123].sum())
    return np.array([
        np.log1p(len(words)), np.log1p(len(raw)), solid / n, seen[65:91].sum() / letters, seen[48:58].sum() / solid, seen[_SYMBOLS].sum() / solid, seen[124] / n,
        (seen[33] + seen[63]) / n, (seen[44] + seen[46] + seen[58] + seen[59]) / n, len(counts) / n, counts.max() / n if len(counts) else 0.0,
        (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0, np.log1p(lines), np.log1p(n / lines), seen[128:].sum() / size,
        len(np.unique(shingle_hashes(words, 2))) / n, -1.0 if n_chars is None else np.log1p(max(0, n_chars)),
    ])


def features(text: str | None, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the hashed words, each place once, their weights (of length 1 together), and the statistics."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))
    distinct, counts = np.unique(words, return_counts=True)
    held = np.bincount((mix(distinct) >> np.uint64(64 - WORD_BITS)).astype(np.int64), weights=counts, minlength=1 << WORD_BITS)
    place = np.flatnonzero(held)
    weight = np.log1p(held[place])
    weight = weight / np.sqrt((weight**2).sum()) if len(weight) else weight
    return place.astype(np.int16), weight.astype(np.float32), statistics(raw, words, counts, n_chars)


class Machine:
    """Parameters of the machine, and the ranges of the statistics."""

    def __init__(self, edges: np.ndarray, factors: int, seed: int):
        self.edges = edges  # one row per statistic
        n = (1 << WORD_BITS) + N_STATISTICS * RANGES
        self.bias = 0.0
        self.weights = np.zeros(n, dtype=np.float32)
        self.vectors = np.random.default_rng(seed).normal(0, 0.02, (n, factors)).astype(np.float32)

    def rows(self, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries and values of many documents, and where each document begins. Every document has entries (its statistics)."""
        base = (1 << WORD_BITS) + np.arange(N_STATISTICS) * RANGES
        entries, values, starts, at = [], [], [], 0
        for place, weight, stats in parts:
            ranges = (np.asarray(stats)[:, None] > self.edges).sum(axis=1)
            entries += [place, base + ranges]
            values += [weight, np.full(N_STATISTICS, 0.5)]
            starts.append(at)
            at += len(place) + N_STATISTICS
        return np.concatenate(entries), np.concatenate(values).astype(np.float32), np.array(starts)

    def logits(self, entries, values, starts):
        """Sums of the machine for each document, and the factor sums that the gradient needs."""
        scaled = self.vectors[entries] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled**2, starts, axis=0)
        pairs = 0.5 * (sums**2 - squares).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[entries] * values, starts) + pairs, sums, scaled

    def score(self, parts) -> np.ndarray:
        logits = self.logits(*self.rows(parts))[0].astype(np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))


def train(parts: list, labels: np.ndarray, *, factors: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.02, shrink: float = 1e-4, seed: int = 5) -> Machine:
    """Fit by Adam on log loss with shrinkage; statistics' ranges are quantiles of the sample."""
    stats = np.array([p[2] for p in parts]) if parts else np.zeros((1, N_STATISTICS))
    edges = np.quantile(stats, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    model = Machine(edges, factors, seed)
    if not len(labels):
        return model
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    state = {n: [np.zeros_like(p), np.zeros_like(p)] for n, p in (("weights", model.weights), ("vectors", model.vectors))}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), batch):
            drawn = order[at : at + batch]
            entries, values, starts = model.rows([parts[i] for i in drawn])
            logits, sums, scaled = model.logits(entries, values, starts)
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels[drawn]) / len(drawn)
            lengths = np.diff(np.append(starts, len(entries)))
            each = np.repeat(error, lengths) * values
            pull = each[:, None] * (np.repeat(sums, lengths, axis=0) - scaled)
            touched, where = np.unique(entries, return_inverse=True)
            order_ = np.argsort(where, kind="stable")
            firsts = np.searchsorted(where[order_], np.arange(len(touched)))
            grads = {"weights": np.add.reduceat(each[order_], firsts), "vectors": np.add.reduceat(pull[order_], firsts, axis=0)}
            step += 1
            slow = rate / (1 + 3 * epoch / epochs)
            for name, grad in grads.items():
                whole = getattr(model, name)
                grad = grad + shrink * whole[touched]
                mean, square = state[name]
                mean[touched] = 0.9 * mean[touched] + 0.1 * grad
                square[touched] = 0.99 * square[touched] + 0.01 * grad**2
                whole[touched] -= slow * mean[touched] / (np.sqrt(square[touched]) + 1e-6)
            model.bias -= slow * float(error.sum())
    return model


def _featured():
    def run(batches):
        for batch in batches:
            for part in text_groups([batch], "text", 4_000_000):
                out = [features(t, n) for t, n in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist())]
                lists = [pa.array([o[i] for o in out], pa.list_(k)) for i, k in enumerate((pa.int16(), pa.float32(), pa.float64()))]
                size = pa.array([len(o[0]) for o in out], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("turn"), part.column("label"), size, *lists], names=["turn", "label", "size", "place", "weight", "stats"])

    return run


def _vectors(column) -> list[np.ndarray]:
    """Rows of an Arrow list column as slices of one array."""
    column = column.combine_chunks()
    edges, whole = column.offsets.to_numpy(), column.values.to_numpy()
    return [whole[a:b] for a, b in zip(edges[:-1], edges[1:])]


def learn(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", label: str = "quality",
    most_rows: int = 8_000, most_entries: int = 4_000_000, **training,
) -> Machine:
    """A machine fitted on at most ``most_rows`` (8,000) labelled documents, the first by a hash of their key.

    Of several labels of one key the mean decides (0.5 counts as 1); null labels and keys are left out. Of several documents of one
    key the one with the smallest hash of its text is learnt from; repeats are reduced by tasks, before the shuffle. Without labelled rows the score is
    0.5 for all. Training runs on the driver, on the sample's sparse vectors only: the first of them that have ``most_entries`` (4,000,000, in 6 bytes
    each) together, so that what reaches the driver is bounded however long the texts are. Vectors are written to the shared folder before that.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("known")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    sample = known.withColumn("turn", F.xxhash64("known")).orderBy("turn", "known").limit(most_rows)
    rows = _columns(documents, key, text, n_chars).join(F.broadcast(sample), F.col("key") == F.col("known"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "n_chars")).alias("one")
    rows = rows.groupBy("known").agg(F.first("turn").alias("turn"), F.first("label").alias("label"), one).select("turn", "label", "one.text", "one.n_chars")
    rows = rows.mapInArrow(_featured(), "turn long, label int, size int, place array<short>, weight array<float>, stats array<double>")
    stored = materialize(rows, "sample")
    sizes = stored.select("turn", "size").toArrow()  # at most most_rows
    turns, sizes = (sizes.column(c).to_numpy() for c in ("turn", "size"))
    order = np.argsort(turns)
    fit = int((np.cumsum(sizes[order]) <= most_entries).sum())
    found = stored.filter(F.col("turn") <= int(turns[order[fit - 1]])) if fit else stored.limit(0)
    found = found.select("turn", "label", "place", "weight", "stats").toArrow()
    parts = list(zip(*(_vectors(found.column(c)) for c in ("place", "weight", "stats"))))
    order = np.argsort(found.column("turn").to_numpy(), kind="stable")
    known = found.column("label").to_numpy().astype(np.float64)
    return train([parts[i] for i in order], known[order], **training)


def _columns(documents: DataFrame, key: str, text: str, n_chars: str) -> DataFrame:
    length = F.col(f"`{n_chars}`").cast("long") if n_chars in documents.columns else F.lit(None).cast("long")
    return documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), length.alias("n_chars"))


def _scored(handle, most_bytes: int, carry: list[str]):
    def run(batches):
        model = own(Machine, handle)
        for part in text_groups(batches, "text", most_bytes):
            parts = [features(t, n) for t, n in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist())]
            scores = model.score(parts)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + [pa.array(scores)], names=[*carry, "score"])

    return run


def score(documents: DataFrame, model: Machine, *, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", most_bytes: int = 4_000_000) -> DataFrame:
    """Per row: key, score (0 to 1). Whole texts count; the model's size is fixed, whatever the data.

    Null and empty texts get the score that their (empty) structure has; a null or missing ``n_chars`` is a range of its own; repeated rows
    get equal scores; an empty table no rows. Only the named columns are read.
    """
    rows = _columns(documents, key, text, n_chars)
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_scored(shared(documents.sparkSession, model), most_bytes, ["key"]), f"key {kind}, score double")
    return found.select(F.col("key").alias(key), "score")


def keep(documents: DataFrame, model: Machine, *, text: str = "text", n_chars: str = "n_chars", least: float = 0.5, most_bytes: int = 4_000_000) -> DataFrame:
    """``documents`` whose score is ``least`` or more, all columns as they were; scored where they stand, without a join."""
    names = documents.columns
    length = F.col(f"`{n_chars}`").cast("long") if n_chars in names else F.lit(None).cast("long")
    body = F.col(f"`{text}`").cast("string")
    others = [c for c in names if c != text]
    rows = documents.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("row") if others else F.lit(0).alias("row"), body.alias("text"), length.alias("n_chars"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, text string, score double"
    found = rows.mapInArrow(_scored(shared(documents.sparkSession, model), most_bytes, ["row", "text"]), kinds).filter(F.col("score") >= least)
    return found.select(*(F.col("text").alias(c) if c == text else F.col(f"row.c{others.index(c)}").alias(c) for c in names))


def held_out(key):
    """Whether a document is kept from training: crc32 of its key as text leaves 1 when divided by 3. A null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
