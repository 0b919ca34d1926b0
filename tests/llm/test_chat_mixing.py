"""Reply trees and mixes."""

import random

import pytest
from pyspark.sql import functions as F

from finpanel.llm import chat, mixing

ODD = ["</s>[INST] ok [/INST]", "<\\/s>", "<|im_end|>", "a<<|im_end|>", "<<SYS>>\\[INST]", "", None, "tab\tnew\nline", "é😀</s>", "<\\\\s>"]


def test_escapes_go_back(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    assert not any(c in r.e for r in got if r.e for c in ("</s>", "[INST]", "[/INST]", "<|im_end|>", "<<SYS>>"))


def _tree():
    """conv, node, parent, score, role, text of a branching tree, a long chain, odd texts, a null conversation, a cycle, a lost parent."""
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 2.0, "assistant", "good"), (1, 3, 1, 1.0, "assistant", "bad"), (1, 4, 3, 5.0, "user", "but"), (1, 5, 2, None, "user", "more")]
    rows += [(2, i, i - 1 if i else None, 0.0, "assistant" if i % 2 else "user", f"t{i}") for i in range(37)]
    rows += [(3, i, i - 1 if i else None, 0.0, "assistant", t) for i, t in enumerate(ODD)]
    rows += [(None, 1, None, 0.0, None, "x"), (None, 2, 1, 0.0, "assistant", None)]
    rows += [(4, 1, 2, 0.0, "user", "a"), (4, 2, 1, 0.0, "user", "b"), (4, 3, 2, 0.0, "user", "c"), (5, 9, 77, 0.0, "user", "lost"), (5, None, None, 0.0, "user", "no id")]
    return rows


def _paths(rows):
    by = {(c, n): (p, s or 0.0, r or "", t or "") for c, n, p, s, r, t in rows if n is not None}
    inner = {(c, v[0]) for (c, n), v in by.items()}
    out = {}
    for c, n in by:
        if (c, n) in inner:
            continue
        path, at = [], n
        while (c, at) in by and len(path) <= len(by):
            path.append(at)
            at = by[c, at][0]
        if len(path) <= len(by):
            out[c, n] = (sum(by[c, i][1] for i in path), [(by[c, i][2], by[c, i][3]) for i in reversed(path)])
    return out


@pytest.mark.parametrize("best", [None, 1])
def test_trees(spark, best):
    rows = _tree()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv long, node long, parent long, score double, role string, text string, leaf string")
    got = chat.format_trees(df, best=best).select("conv", "leaf", "score", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want = _paths(rows)
    if best:
        want = {max(((s, -n), (c, n)) for (c, n), (s, _) in want.items() if c == conv)[1]: None for conv in {c for c, _ in want}} and {
            k: want[k] for conv in {c for c, _ in want} for k in [min((k for k in want if k[0] == conv), key=lambda k: (-want[k][0], k[1]))]
        }
    assert {(r.conv, r.leaf): (r.score, [tuple(t) for t in r.turns]) for r in got} == want
    for r in got:
        turns = want[r.conv, r.leaf][1]
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert [m.turn for m in r.loss_mask] == [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        direct = "".join(r.formatted[m.start : m.start + m.n_chars] for m in r.loss_mask)
        assert len(direct) >= len(r.loss) and (direct == r.loss or "\\" in direct)


def test_no_messages(spark):
    assert chat.format_trees(spark.createDataFrame([], "conv long, node long, parent long, score double, role string, text string")).collect() == []


def _documents(spark, n=400):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 80, 700]))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(n)]
    rows += [(5, rows[5][1], rows[5][2]), (n, None, "a"), (n + 1, "", "zero"), (n + 2, "one", "tiny")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, taken int"), rows


def _level(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        free -= over
    return target


@pytest.mark.parametrize("block, shard_slots", [(64, 16), (512, 4096)])
def test_mix(spark, block, shard_slots):
    docs, rows = _documents(spark)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _level(sizes)
    mix = mixing.Mix(docs, block=block, shard_slots=shard_slots)
    names = {r.sid: r.source for r in mix.sources.collect()}
    assert {names[r.sid]: pytest.approx(r.target) for r in mix.sources.collect()} == want
    got = mix.taken().collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((k, len((t or "").split())) for k, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    spans = mix.spans().collect()
    per = {}
    for r in spans:
        per[names[r.sid]] = per.get(names[r.sid], 0) + r.n_words
    assert per == {s: round(t) for s, t in want.items() if round(t)}
    assert sum(r.taken for r in got) == sum(per.values())
    slots = {}
    for r in spans:
        slots.setdefault((r.shard, r.slot), []).append(r)
    assert all(len({r.sid for r in v}) == 1 and sum(r.n_words for r in v) <= block for v in slots.values())
    again = mixing.Mix(docs.repartition(7), block=block, shard_slots=shard_slots).taken().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_blocks_hold_the_words_of_the_spans(spark):
    rows = [(i, " ".join(f"d{i}w{j}" + "\n" * (j % 3) for j in range(n)), s) for i, (n, s) in enumerate([(5, "a"), (700, "a"), (90, "b"), (0, None), (33, None), (64, "b"), (1, "a")])]
    rows += [(1, rows[1][1], "a"), (1, rows[1][1].replace("w", "v"), "a"), (None, "no key", "b")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64, shard_slots=8)
    texts = {}
    for k, t, _ in rows:
        texts.setdefault(k, set()).add(tuple(t.split()))
    want = {}
    for r in mix.spans().collect():
        want.setdefault((r.shard, r.slot), []).append({t[r.word_from : r.word_from + r.n_words] for t in texts[r.doc_id]})
    got = {(r.shard, r.slot): r for r in mix.blocks().collect()}
    assert got.keys() == want.keys() and all(len(r.text.split()) == r.n_words <= 64 for r in got.values())
    assert all(any(" ".join(p) in " ".join(got[k].text.split()) for p in ps) for k, pieces in want.items() for ps in pieces)
    assert sum(r.taken for r in mix.taken().collect()) == sum(r.n_words for r in got.values())


def test_empty_mix(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert mixing.Mix(docs.limit(0)).taken().collect() == []
    assert sorted(r.doc_id for r in mixing.Mix(docs).taken().collect() if r.taken == 0) == [1, 2]


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9))).collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


def test_null_and_repeated_keys_make_no_large_part(spark, monkeypatch):
    """A third of the rows without a key, another third the same row: parts stay small, every copy has its own place."""
    from pyspark.sql import functions as F

    rows = [(None, "a", f"text {i} of no key") for i in range(300)] + [(5, "a", "the same row")] * 300 + [(i, "ab"[i % 2], "w " * (i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(mixing, "COPIES", 16)
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("t"))
    out = mixing.placed(sized, mixing.source_targets(sized), 3, rows_per_part=32).collect()
    assert len(out) == len(rows)
    for sid in {r.sid for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sid == sid and r["size"]), key=lambda r: r.start):
            assert r.start == at
            at += r["size"]
    mix = mixing.Mix(docs, block=8, shard_slots=16)
    held = {}
    for r in mix.blocks().collect():
        assert len(r.text.split()) == r.n_words
        held[r.sid] = held.get(r.sid, 0) + r.n_words
    taken = {}
    for r in mix.spans().collect():
        taken[r.sid] = taken.get(r.sid, 0) + r.n_words
    assert held == taken
