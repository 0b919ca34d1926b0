"""Benchmark decontamination: suffix arrays over shards of the training text, searched with every suffix of the benchmark."""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, own, shared
from finpanel.session import materialize

by_value(__name__)

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on lower-cased UTF-8: digits, a to z, and all beyond ASCII
FOUND = {
    "spans": "array<struct<from: long, to: long>>", "items": "array<string>",
    "matches": "array<struct<item_id: string, item_from: long, doc_from: long, n_words: long>>",
}


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; only A to Z are lower-cased (``bytes.lower`` leaves other letters alone)."""
    return WORD.findall(text.lower())


class Index:
    """A bounded part of the benchmark: vocabulary, and its distinct windows as packed keys with the items they are from."""

    def __init__(self, segments: list[tuple[str, int, list[bytes]]], window: int):
        """``segments``: item, place of its first word, words; a segment longer than the window gives one window per place."""
        self.window, self.vocab = window, {}
        rows, owners, places = [], [], []
        for item, first, words in segments:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1)):
                rows.append(ids[at : at + window])
                owners.append(item)
                places.append(first + at)
        self.bits = max(1, int(len(self.vocab)).bit_length())
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        full = np.zeros((len(rows), window), dtype=np.uint64)
        for i, r in enumerate(rows):
            full[i, : len(r)] = r
        full = full.reshape(-1, window)
        distinct, which = np.unique(np.column_stack([full, lengths.astype(np.uint64)]), axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.owners = np.array(owners, dtype=object)[order]
        self.places = np.array(places, dtype=np.int64)[order]
        self.first = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
        grams, self.lengths = distinct[:, :window], distinct[:, window].astype(np.int64)
        self.low = self.pack(grams)
        top = np.uint64((1 << self.bits) - 1)
        self.high = self.pack(np.where(np.arange(window) < self.lengths[:, None], grams, top))
        self.firsts = np.unique(grams[:, 0]) if len(grams) else np.zeros(0, np.uint64)
        two = grams[self.lengths > 1]
        self.pairs = np.unique(two[:, 0] << np.uint64(self.bits) | two[:, 1])
        self.singles = np.unique(grams[self.lengths == 1, 0])

    def pack(self, grams: np.ndarray) -> np.ndarray:
        """Word numbers of each row in as few 64-bit keys as hold them; keys compare as the rows do."""
        per = 64 // self.bits
        keys = np.zeros((-(-grams.shape[1] // per), len(grams)), dtype=np.uint64)
        for j in range(grams.shape[1]):
            keys[j // per] = keys[j // per] << np.uint64(self.bits) | grams[:, j]
        left = (-grams.shape[1]) % per
        keys[-1] <<= np.uint64(left * self.bits if left * self.bits < 64 else 0)
        return keys


def _below(keys: np.ndarray, at: np.ndarray, wanted: np.ndarray, or_equal: bool) -> np.ndarray:
    """Whether keys[:, at] come before ``wanted`` (or are the same), key by key."""
    out = np.full(len(at), or_equal)
    for k, w in zip(keys[::-1], wanted[::-1]):
        here = k[at]
        out = (here < w) | ((here == w) & out)
    return out


def _search(keys: np.ndarray, wanted: np.ndarray, or_equal: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: how many sorted keys come before each."""
    n = keys.shape[1]
    low, high = np.zeros(wanted.shape[1], dtype=np.int64), np.full(wanted.shape[1], n, dtype=np.int64)
    for _ in range(int(n).bit_length()):
        open_ = low < high
        mid = (low + high) >> 1
        right = open_ & _below(keys, np.minimum(mid, n - 1), wanted, or_equal)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def find(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ids`` and window numbers of all occurrences of the index's windows.

    The suffix array holds the suffixes that can start a window (their first words start one), sorted by their first words as
    far as a window reaches. 0 marks words that no test has and the ends of documents; no window holds it.
    """
    padded = np.concatenate([ids, np.zeros(index.window, dtype=np.uint64)])
    pair = padded[: len(ids)] << np.uint64(index.bits) | padded[1 : len(ids) + 1]
    may = np.isin(pair, index.pairs) & (padded[1 : len(ids) + 1] > 0)
    if len(index.singles):
        may |= np.isin(ids, index.singles)
    at = np.flatnonzero(may & (ids > 0))
    if not len(at) or not index.low.shape[1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = index.pack(padded[at[:, None] + np.arange(index.window)])
    order = np.lexsort(keys[::-1])
    suffixes, keys = at[order], keys[:, order]
    low, high = _search(keys, index.low, False), _search(keys, index.high, True)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    steps = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return suffixes[np.repeat(low, counts) + steps], which


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"from": a, "to": b} for a, b in out]


def _longest(places, windows, index: Index) -> list[dict]:
    """Longest verbatim matches of one document: windows that follow each other in it and in the item, joined."""
    seen = sorted(
        (index.owners[k], int(p) - int(index.places[k]), int(p), int(index.lengths[w]))
        for p, w in zip(places, windows) for k in range(index.first[w], index.first[w + 1])
    )
    out: list[dict] = []
    last = None
    for item, shift, place, length in seen:
        if last == (item, shift) and place <= out[-1]["doc_from"] + out[-1]["n_words"] - length + 1:
            out[-1]["n_words"] = place + length - out[-1]["doc_from"]
        else:
            out.append({"item_id": item, "item_from": place - shift, "doc_from": place, "n_words": length})
        last = (item, shift)
    return out


def scan(index: Index, keep_text: bool, want_matches: bool, most_words: int):
    """Task function: one suffix array per ``most_words`` words of the task's rows (one row at least)."""

    def shard(rows: list[dict], parts: list[np.ndarray]) -> list[dict]:
        starts = np.cumsum([0] + [len(p) for p in parts])
        for r, p in zip(rows, parts):
            r["n_words"] = len(p) - 1
        places, windows = find(np.concatenate(parts), index)
        docs = np.searchsorted(starts, places, side="right") - 1
        order = np.lexsort((places, docs))
        docs, places, windows = docs[order], places[order], windows[order]
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], docs, [-1]))))
        for a, b in zip(edges[:-1], edges[1:]):
            r, within = rows[docs[a]], places[a:b] - starts[docs[a]]
            r["spans"] = _merge([(s["from"], s["to"]) for s in r["spans"]] + list(zip(within.tolist(), (within + index.lengths[windows[a:b]]).tolist())))
            hit = {i for w in np.unique(windows[a:b]) for i in index.owners[index.first[w] : index.first[w + 1]]}
            r["items"] = sorted(hit.union(r["items"]))
            if want_matches:
                r["matches"] = r["matches"] + _longest(within, windows[a:b], index)
        return rows

    def run(batches):
        known = index.vocab.get
        schema = None
        rows, parts, held = [], [], 0
        for batch in batches:
            schema = batch.schema
            texts = batch.column("text")
            for i, r in enumerate(batch.drop_columns(["text"]).to_pylist()):
                text = texts[i].as_py()
                found = words_of(text.encode("utf-8", "surrogatepass")) if text else ()
                ids = np.zeros(len(found) + 1, dtype=np.uint64)
                ids[:-1] = [known(w, 0) for w in found]
                rows.append(r | {"text": text if keep_text else None})
                parts.append(ids)
                held += len(ids)
                if held >= most_words:
                    yield pa.RecordBatch.from_pylist(shard(rows, parts), schema=schema)
                    rows, parts, held = [], [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(shard(rows, parts), schema=schema)

    return run


def _cut(window: int, most_words: int):
    """Items as segments: item, at (place of the first word), n and words, joined by blanks. Segments of a longer item overlap by a window less a word."""

    def run(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                words = words_of((text or "").encode("utf-8", "surrogatepass"))
                for at in range(0, max(1, len(words) - window + 1), most_words):
                    part = words[at : at + most_words + window - 1]
                    if part:
                        out.append((key if key is not None else "null", at, len(part), b" ".join(part)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["item", "at", "n", "words"])

    return run


def _built(window: int):
    """The index of each part, as plain data in bytes, from sorted segments."""

    def packed(part, held):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(vars(Index(held, window)))], pa.binary())], names=["part", "index"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for part, item, at, words in zip(*(batch.column(c).to_pylist() for c in ("part", "item", "at", "words"))):
                if part != now and held:
                    yield packed(now, held)
                    held = []
                now = part
                held.append((item, at, words.split(b" ")))
        if held:
            yield packed(now, held)

    return run


def indexes(benchmark: DataFrame, key: str, text: str, window: int, most_words: int):
    """The benchmark's indexes, each of about ``most_words`` words, one after another.

    Tasks cut items into segments and build the index of each part, a hashed share of the segments; they are kept in the shared folder, and the driver
    holds one at a time.
    """
    rows = benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    segments = materialize(rows.mapInArrow(_cut(window, most_words), "item string, at long, n long, words binary"), "segments")
    total = segments.agg(F.sum("n")).first()[0] or 0
    if not total:
        return
    parts = -(-total // most_words)
    dealt = segments.withColumn("part", F.pmod(F.xxhash64("item", "at"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "item", "at", "words")
    built = materialize(dealt.select("part", "item", "at", "words").mapInArrow(_built(window), "part int, index binary"), "indexes")
    for part in range(parts):
        for row in built.filter(F.col("part") == part).collect():  # one, or none if no segment fell into it
            index = object.__new__(Index)
            vars(index).update(pickle.loads(row["index"]))
            yield index


def _scanned(
    documents: DataFrame, benchmark: DataFrame, carry: list[str], keep_text: bool, want_matches: bool, *, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 13, shard_words: int = 500_000, most_words: int = 1_000_000,
) -> DataFrame:
    """row (the carried columns as c0, c1, ...), text, n_words, spans, items, matches of every document."""
    spark = documents.sparkSession
    state = documents.select(
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("row"), F.col(f"`{text}`").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), *(F.expr(f"CAST(array() AS {t})").alias(n) for n, t in FOUND.items()),
    )
    parts = indexes(benchmark, item, item_text, window, most_words)
    index, passes = next(parts, None), 0
    while index is not None or not passes:
        handle = shared(spark, index or Index([], window))
        index = next(parts, None)
        if passes:
            state = materialize(state, "decontaminate")
        state = _pass(state, handle, keep_text or index is not None, want_matches, shard_words)
        passes += 1
    return state


def _pass(state: DataFrame, handle, keep_text: bool, want_matches: bool, shard_words: int) -> DataFrame:
    def run(batches):
        yield from scan(own(Index, handle), keep_text, want_matches, shard_words)(batches)

    return state.mapInArrow(run, state.schema)


def _hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def _contaminated(least_share: float):
    return (_hit_words() > 0) & (_hit_words() * round(1 / least_share) >= F.col("n_words"))


def find_matches(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """For every document: key, n_words, spans (its words inside any window), items, matches (longest verbatim matches).

    Every task builds suffix arrays over shards of its own rows and searches them with all benchmark suffixes, so documents are
    never shuffled and a passage that very many documents share costs nothing extra. The benchmark is broadcast in parts of
    at most ``most_words`` words (1,000,000); if it needs several, each is a pass over the rows, which goes on from what the
    passes before have found (written to the shared folder).

    Options: text, item, item_text (column names), window (13 words), shard_words (500,000). Null or empty texts have no words
    and no match, as an item without words. An item of fewer words than the window is one window. Repeated documents are judged
    each; rows of ``benchmark`` with one key count as one item, a null key as ``null``. Only the named columns are read, so
    further columns cannot clash.
    """
    return _scanned(documents, benchmark, [key], False, True, **options).select(F.col("row.c0").alias(key), *("n_words", *FOUND))


def judge(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", least_share: float = 0.05, **options) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items, contaminated (words hit, and at least ``least_share`` of its words).

    Rows and odd input as in ``find_matches``.
    """
    return _scanned(documents, benchmark, [key], False, False, **options).select(
        F.col("row.c0").alias(key), "n_words", _hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        _contaminated(least_share).alias("contaminated"),
    )


def remove(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", least_share: float = 0.05, **options) -> DataFrame:
    """``documents`` without contaminated rows, all columns as they were. Rows are judged where they stand, without a join.

    A row without words is not contaminated and stays. The other columns ride along in a struct, so any names do.
    """
    carry = [c for c in documents.columns if c != text]
    found = _scanned(documents, benchmark, carry, True, False, text=text, **options).filter(~_contaminated(least_share))
    return found.select(*(F.col("text").alias(c) if c == text else F.col(f"row.c{carry.index(c)}").alias(c) for c in documents.columns))
