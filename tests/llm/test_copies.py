"""Near copies of documents, lines and embeddings, against all pairs; components; buckets that prove nothing."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from finpanel.llm import components, embedding_dedup, line_dedup, linking, near_dedup


def _roots(n, pairs):
    sets = components.Sets()
    for a, b in pairs:
        sets.join(a, b)
    return [sets.root(i) for i in range(n)]


@pytest.mark.parametrize("most_links", [7, 200_000])
def test_components(spark, most_links):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (0, 0)] + [(900, i) for i in range(901, 930)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long"), most_links=most_links)
    want = _roots(1000, pairs)
    assert {r.node: r.component for r in found.collect()} == {x: want[x] for p in pairs for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long"), most_links=most_links).collect() == []


@pytest.mark.parametrize("block", [3, 256])
def test_links_in_one_unproved_bucket(spark, block):
    """All nodes share one bucket; the links among them must come out whatever the pivots."""
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 10**9, 40)) for _ in range(4)]
    items = [np.unique(np.concatenate([rng.choice(b, 38, replace=False), rng.integers(0, 10**9, 2)])) for b in base for _ in range(8)]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(items)), 2) if linking.jaccard(items[i], items[j]) >= 0.8]
    state = spark.createDataFrame([(i, 1) for i in range(len(items))] + [(i, 2) for i in range(0, len(items), 2)], "node long, bucket long")
    table = spark.createDataFrame([(i, x.tolist(), len(x)) for i, x in enumerate(items)], "node long, items array<long>, size int")
    got = {r.node: r.component for r in linking.link_components(linking.shared_buckets(state), table, block=block).collect()}
    want = _roots(len(items), pairs)
    assert {i: got.get(i, i) for i in range(len(items))} == dict(enumerate(want))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(1, 2**60, 300).astype(np.uint64))
    b = np.concatenate([a[:240], rng.integers(1, 2**60, 60).astype(np.uint64)])
    wa = rng.integers(1, 6, len(a))
    wb = np.concatenate([wa[:240] + (np.arange(240) < 40) * 3, np.ones(60, int)])
    one, two = dict(zip(a, wa)), dict(zip(b, wb))
    share = sum(min(one.get(x, 0), two.get(x, 0)) for x in {*one, *two}) / sum(max(one.get(x, 0), two.get(x, 0)) for x in {*one, *two})
    held = near_dedup.bag_signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 8192)
    assert np.isfinite(held).all() and abs((held[0] == held[1]).mean() - share) < 0.02


def _texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = [word() if rng.random() < 0.015 else w for w in base]
            rows.append(" ".join(copy[: len(copy) // 2]) + "\n" + " ".join(copy[len(copy) // 2 :]))
    rows += [rows[3], rows[3].upper(), None, None, "", " \n ", "one", "one", "a a a a a a a a", "a a a a a a a a a", "x\n\nx\nx y", "\n".join(["same line here"] * 3)]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[5])]


def test_document_classes(spark):
    rows = _texts()
    bags = []
    for _, t in rows:
        w = (t or "").lower().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]
    want = _roots(len(rows), pairs)
    least = {r: min((rows[i][0] for i in range(len(rows)) if want[i] == r and rows[i][0] is not None), default=None) for r in set(want)}
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, d1 int, bands string")
    got = near_dedup.classes(docs).select("doc_id", "class_id").collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(key((rows[i][0], least[want[i]])) for i in range(len(rows)))
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({least[w] for i, w in enumerate(want) if bags[i]} | {rows[i][0] for i in range(len(rows)) if not bags[i]})
    assert near_dedup.classes(docs.limit(0)).collect() == [] and near_dedup.deduplicate(docs.limit(0)).collect() == []


def _without_repeats(rows, size=8):
    places, shingles = {}, []
    for k, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                places.setdefault(line.strip().lower(), set()).add((k is not None, k or 0, p))
    lines = list(places)
    shingles = [{x[i : i + size] for i in range(max(1, len(x) - size + 1))} for x in lines]
    want = _roots(len(lines), [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])])
    lost = set()
    for r in set(want):
        lost |= set(sorted(set().union(*(places[lines[i]] for i in range(len(lines)) if want[i] == r)))[1:])
    return [(k, t and "\n".join(x for p, x in enumerate(t.split("\n")) if (k is not None, k or 0, p) not in lost)) for k, t in rows]


def test_lines(spark):
    rows = _texts(7)
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_lines int")
    got = line_dedup.deduplicate(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"] and {r.n_lines for r in got.collect()} == {1}
    plain = {(r.doc_id, r.n_lines_, r.n_dropped) for r in got.collect()}
    assert all(n >= d for _, n, d in plain) and any(d for *_, d in plain)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(_without_repeats(rows), key=str)
    assert line_dedup.deduplicate(docs.limit(0)).collect() == []


def test_lines_whose_first_hash_agrees(spark):
    """Lines are named by 128 bits: two that agree in 64 of them are two lines, even where one of them has copies and near copies."""
    def named(lines):
        import numpy

        whole = line_dedup.digests(lines).copy()
        whole[:, 0] = 7
        return numpy.ascontiguousarray(whole)

    texts = ["a line that is quite long and stands here twice", "a line that is quite long and stands here twice.", "nothing of the kind", "a line that is quite long and stands here twice", "again something else entirely", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.deduplicate(docs, named=named).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_long_lines_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    lines = ["".join(rng.choice("abcdefghij ") for _ in range(n)) for n in (5, 7, 8, 9, 100, 999, 1000, 1007, 5000)]
    whole, sets = line_dedup.line_bands(lines, 8, 10, 4), [line_dedup.items_of(x, 8) for x in lines]
    for piece in (1, 50, 1000):
        monkeypatch.setattr(line_dedup, "PIECE", piece)
        assert np.array_equal(line_dedup.line_bands(lines, 8, 10, 4), whole)
        assert all(np.array_equal(line_dedup.items_of(x, 8), s) for x, s in zip(lines, sets))
    monkeypatch.undo()
    long = "x" * 10 + "".join(rng.choice("abcdefghij ") for _ in range(2_000_000))
    docs = spark.createDataFrame([(1, long), (2, "other\n" + long[:-9] + "changed"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.deduplicate(docs).collect()} == {1: (1, 0), 2: (2, 1), 3: (0, 0), 4: (0, 0)}


def _vectors():
    rng = np.random.default_rng(4)
    rows = []
    for group in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (base + rng.standard_normal(16) * 0.12).tolist(), int(group % 3)))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(5)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e30] * 16, [3e30] * 16]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None), (0, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "block": 3, "most_sample": 20}])
def test_embeddings(spark, options):
    rows = _vectors()
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]

    def near(i, j):
        if not (good[i] and good[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1]) / max(map(abs, rows[i][1])), np.array(rows[j][1]) / max(map(abs, rows[j][1]))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93

    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near(i, j)]
    counts, roots = Counter(x for p in pairs for x in p), _roots(len(rows), pairs)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    want = sorted((rows[i][0], counts[i], least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, codes int")
    got = sorted(map(tuple, embedding_dedup.links(df, **options).collect()))
    assert [g[0] for g in got] == [w[0] for w in want]
    if options:  # tiny leaves: recall
        assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    else:
        assert got == want
    assert embedding_dedup.links(df.limit(0)).collect() == []


def test_many_dropped_lines_are_not_broadcast(spark, monkeypatch):
    lines = "\n".join(f"line {'x' * i} number {i}" for i in range(20))
    docs = spark.createDataFrame([(i, lines) for i in range(3)], "doc_id long, text string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few = line_dedup.deduplicate(docs)
    monkeypatch.setattr(line_dedup, "MOST_PLACES", 10, raising=False)
    many = line_dedup.deduplicate(docs)
    assert hinted(few) and not hinted(many)
    assert sorted(few.collect()) == sorted(many.collect()) and sum(r.n_dropped for r in many.collect()) >= 40
