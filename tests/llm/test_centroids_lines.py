"""Centroid clustering against full distances, line-first cleaning against plain loops."""

import hashlib
import random
import re

import numpy as np
import pytest

from finpanel.llm import centroids, line_rules

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"


def brute_clusters(rows, dims, k, rounds, scale=256):
    kept = [(i, e) for i, e, *_ in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    whole = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in e], e) for i, e in kept]
    order = sorted(whole, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    centers = [list(r[1]) for r in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, x, _ in whole:
            groups.setdefault(nearest(x)[1], []).append(x)
        for i, xs in groups.items():
            centers[i] = [sum(c) // len(xs) for c in zip(*xs)]
    return centers, sorted(((i, *reversed(nearest(x))) for i, x, _ in whole), key=repr)


def vectors(seed, n, dims):
    rng = random.Random(seed)
    spots = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [rng.gauss(s, 0.2) for s in rng.choice(spots)], "x", 1) for i in range(n)]
    rows += [(900 + i, list(rows[3][1]), None, None) for i in range(n // 3)]  # a third are copies
    odd = [(1, None), (2, []), (3, [0.0] * (dims - 1)), (4, [None] + [0.0] * (dims - 1)), (5, [float("nan")] + [0.0] * (dims - 1)), (6, [float("-inf")] + [0.0] * (dims - 1))]
    return rows + [(*r, "x", 1) for r in odd] + [(None, [0.1] * dims, "x", 1), (3, [0.25] * dims, "x", 1), (3, [0.25] * dims, "x", 1)]


@pytest.mark.parametrize("dims,k,most_rows", [(8, 10, 4096), (3, 25, 7)])
def test_clusters_equal_full_search(spark, dims, k, most_rows):
    rows = vectors(dims, 120, dims)
    centers, want = brute_clusters(rows, dims, k, 3)
    found = centroids.Clustering(spark.createDataFrame(rows, SCHEMA).repartition(5), dims=dims, k=k, rounds=3, most_rows=most_rows)
    assert found.centroids.tolist() == centers
    got = found.assigned().collect()
    assert sorted(((r.key, r.cluster, r.distance) for r in got), key=repr) == want
    assert all(1 <= r.met <= k for r in got)


def test_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(0)
    centers = rng.integers(-1000, 1000, (40, 2))
    centers[7] = centers[30]  # equal centroids: the smaller number
    rows = np.concatenate([centers, rng.integers(-1200, 1200, (500, 2))])
    cluster, best, met = centroids.Lists(centers).nearest(rows)
    full = ((rows[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and cluster[30] == 7
    assert met.mean() < 15


def test_few_and_no_vectors(spark):
    empty = centroids.Clustering(spark.createDataFrame([], SCHEMA), dims=2, k=3)
    assert len(empty.centroids) == 0 and empty.assigned().collect() == []
    one = centroids.Clustering(spark.createDataFrame([(5, [0.5, -0.001], None, None)], SCHEMA), dims=2, k=3)
    assert [(r.key, r.cluster, r.distance) for r in one.assigned().collect()] == [(5, 0, 0)] and one.centroids.tolist() == [[128, -1]]
    with pytest.raises(Exception, match="beyond"):
        centroids.Clustering(spark.createDataFrame([(5, [1e30, 0.0], None, None)], SCHEMA), dims=2, k=3)


def brute_repeats(text):
    words = re.findall(line_rules.WORD, text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len(words), len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


def test_counts_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 30, 200):
        for alphabet in ("ab", "abcdefgh"):
            text = "".join(rng.choice(alphabet) + rng.choice([" ", "\n", "\t \x0b"]) for _ in range(n))
            assert line_rules.repeated_words(text) == brute_repeats(text)
    assert line_rules.repeated_words("a b c") == (2, 0)  # a no-break space is inside a word
    text = "One line.\nOne line.\n One line.\n\n \nab|<c> #1"
    cleaned, counts = line_rules.judged(text)
    got = dict(zip(line_rules.COUNTS, counts))
    assert got == {
        "n_words": 8, "word_chars": 32, "n_symbols": 4, "n_dup_lines": 1, "n_repeat_words": 6, "n_lines": 4, "n_punctuation": 1, "n_navigation": 0, "n_boilerplate": 0, "lost_chars": 8,
    }
    assert cleaned == "One line.\nOne line.\n One line.\n\n "


@pytest.mark.parametrize("line,rule", [
    ("It rained all day.", None), ("“It rained,” she said…”", None), ("a wrapped line of prose that goes on below without an end", None), ("他来了。", None),
    ("A heading", 0), ("word### other*** more&&& signs%%% than$$$ any### prose&&& would***.", 0), ("Home | News | Sport | Weather | Travel | Money | More.", 1),
    ("Read more about it now …", None), ("Home | News | About us and all that we did over the years.", None), ("Home › News › Our town in winter", 1), ("Contact our friendly team and support staff here today", None),
    ("Released under the MIT License.", 2), ("© 2020 Example, all rights reserved.", 2), ("This site uses cookies to work well.", 2),
    ("The newsletter said that copyright is a right of authors, no more and no less.", None),
])
def test_rules(line, rule):
    assert line_rules.failed_rule(line) == rule and line_rules.failed_rule(f"\t{line} \r") == rule


def test_verdicts_and_odd_rows(spark):
    prose = " ".join(f"Sentence{i} says word{i} once, then it{i} ends." for i in range(20))
    menu = "\n".join(f"Menu entry {i}" for i in range(60))
    long = "\n".join(prose for _ in range(200)) + " " + "x" * 100_000
    rows = [(1, prose), (2, prose + "\nHome\nReleased under the MIT License."), (3, menu + "\n" + prose), (4, "short text."), (5, None), (6, ""), (7, "so it is. " * 100), (8, long), (None, prose), (1, prose)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, kept string, n_words int").repartition(3)
    got = {}
    for r in line_rules.judge(docs, most_bytes=1000).collect():
        got.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    fine, poor, failed = (False, True), (False, False), (True, False)
    assert got == {1: [fine, fine], 2: [fine], 3: [poor], 4: [failed], 5: [failed], 6: [failed], 7: [failed], 8: [failed], None: [fine]}
    kept = line_rules.clean(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text == prose, r.kept, r.n_words) for r in kept.collect()) == [(0, True, "x", 7)] + [(1, True, "x", 7)] * 2 + [(2, True, "x", 7)]
    assert line_rules.judge(docs.limit(0)).collect() == [] and line_rules.clean(docs.limit(0)).collect() == []
