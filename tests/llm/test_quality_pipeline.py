"""The factorisation machine, the pipeline's stages, and the registered queries."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from checks.compare import connect, differences
from finpanel.llm import quality, queries

SF = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    parts = [quality.features(t, n) for t, n in (("a b b c", 7), ("", None), ("x y z x " * 50, 3))]
    model = quality.train(parts, np.array([1.0, 0.0, 1.0]), epochs=1)
    model.vectors, model.weights, model.bias = rng.normal(size=model.vectors.shape), rng.normal(size=model.weights.shape), 0.3
    entries, values, starts = model.rows(parts)
    for i, logit in enumerate(model.logits(entries, values, starts)[0]):
        own = slice(starts[i], [*starts, len(entries)][i + 1])
        e, x = entries[own], values[own].astype(float)
        pairs = sum(model.vectors[e[a]] @ model.vectors[e[b]] * x[a] * x[b] for a in range(len(e)) for b in range(a))
        assert logit == pytest.approx(0.3 + model.weights[e] @ x + pairs, rel=1e-4, abs=1e-4)


def test_learning_and_odd_rows(spark):
    rows = [(i, "good plain words of prose here " * 5 if i % 2 else "junk### junk### junk### !!! " * 5, 100) for i in range(120)]
    rows += [(200, None, None), (201, "", 0), (202, "x" * 300_000, -5), (0, rows[0][1], 100), (None, "good plain words", 1)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(120)) and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.5}
    again = quality.score(docs.repartition(5), quality.learn(docs.repartition(3), labels)).collect()
    assert {r.doc_id: r.score for r in again} == got
    assert quality.score(docs.limit(0), model).collect() == []
    blind = quality.learn(docs, labels.limit(0))
    assert {round(r.score, 2) for r in quality.score(docs, blind).collect()} == {0.5}
    held = docs.select(quality.held_out(F.col("doc_id")).alias("h"), "doc_id").collect()
    assert all(r.h == (duckdb_crc(r.doc_id) % 3 == 1) for r in held if r.doc_id is not None) and [r.h for r in held if r.doc_id is None] == [False]


def test_one_row_of_each_sampled_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda parts, labels, **_: seen.append(([(p.tolist(), s.tolist()) for p, _, s in parts], labels.tolist())))
    rows = [(i, f"text {i}", 6) for i in range(40)] + [(7, "text again", 9)] * 500 + [(7, None, None), (7, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.learn(docs, labels, most_rows=30)
    quality.learn(docs.repartition(7), labels, most_rows=30)
    quality.learn(docs, labels)
    assert [len(p) for p, _ in seen] == [30, 30, 40] and seen[0] == seen[1] and sum(seen[2][1]) == 20


def duckdb_crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


@present
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality(spark, sf).filter("held_out").toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    assert len(both) > 80 and (both.predicted == both.quality).mean() >= 0.95


@present
def test_stages(spark):
    """Each stage on what its predecessor kept: columns stay, ids come from the input, and the decisions hold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, names = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == names and {r.doc_id for r in rows} <= ids, name
        ids, docs = {r.doc_id for r in rows}, spark.createDataFrame(rows, out.schema)
        assert all(r.n_chars == len(r.text) for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == ids and all(r.taken <= 2 * r["size"] for r in last)


@present
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == []


def test_registered():
    found = driver.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 14))


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda parts, labels, **_: seen.append((sum(len(p) for p, _, _ in parts), len(parts))))
    docs = spark.range(60).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 30000), i -> concat('w', i * (id + 3)))) AS text", "9L AS n_chars")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    quality.learn(docs, labels, most_entries=200_000)
    quality.learn(docs, labels.limit(0), most_entries=200_000)
    (entries, rows), nothing = seen
    assert 150_000 < entries <= 200_000 and 10 <= rows < 60 and nothing == (0, 0)
    place, weight, _ = quality.features("a b b c " + "d " * 1000, 1)
    assert place.dtype == np.int16 and len(set(place.tolist())) == len(place) == 4 and weight.dtype == np.float32
