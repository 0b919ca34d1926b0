"""The prefix trie against plain dictionaries, with small blocks so that every split is taken."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from finpanel.llm import more_queries, prefix_trie


def brute_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, token, role, text))
    own = {c: [r[3:] for r in sorted(rs)] for c, rs in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=260):
    rng = random.Random(seed)
    texts = ["hi", "what is it?", "", None, "ein Satz", "x" * 50]
    rows = []
    for c in [*range(n), 399, 400, -7, -3, 1205]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text = "the same" if t == 0 and c % 3 == 0 else rng.choice(texts)
            rows.append((c, rng.choice([None, t]) if c % 50 == 7 else t, rng.choice(["user", None]) if c % 40 == 9 else "user", text))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 380) for t in range(7)]  # many copies
    rows += [(77, 3, "user", "again")] * 40 + [(None, 0, "user", "nobody")]
    rows += [(205, t, "user", f"long {t}") for t in range(400)]  # one conversation holds many rows
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"node": F.lit("x"), "seq": F.lit(1), "part": F.lit(None).cast("int")})


@pytest.mark.parametrize("seed,parts,siblings,most,block", [(1, 13, 2, 60, 16), (2, None, 4096, 200_000, 1 << 16)])
def test_trie_equals_dictionaries(spark, seed, parts, siblings, most, block):
    rows = conversations(seed)
    turns, ids = prefix_trie.rebuilt(frame(spark, rows).repartition(4), parts=parts)
    trie = prefix_trie.PrefixTrie(turns, ids, parts=parts, siblings=siblings, most=most, block=block)
    got = sorted((tuple(r) for r in trie.table().collect()), key=repr)
    assert got == brute_nodes(brute_rebuilt(rows))


def test_ends_in_pieces(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1000, 100) for t in range(2)]
    turns, ids = prefix_trie.rebuilt(frame(spark, rows), parts=6)
    got = prefix_trie.PrefixTrie(turns, ids, parts=6).end_digests(piece=3).collect()
    assert [r.digest for r in got] == [hashlib.sha256(",".join(map(str, range(0, 1000, 100))).encode()).hexdigest()]


def test_ranks_of_a_list(spark):
    order = list(range(3000))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, [*order[1:], None])], "id long, succ long")
    assert {r.id: r.pos for r in prefix_trie.list_ranks(links, most=100).collect()} == {x: i for i, x in enumerate(order)}


def test_few_and_no_conversations(spark):
    none = prefix_trie.PrefixTrie(*prefix_trie.rebuilt(frame(spark, [(None, 1, "user", "x")])))
    assert none.table().collect() == []
    rows = [(101, 0, "user", "x"), (104, 0, "user", "y"), (104, 1, "user", "z")]  # no base; heads of 101 and 104 fall away
    got = prefix_trie.PrefixTrie(*prefix_trie.rebuilt(frame(spark, rows))).table().collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_nodes(brute_rebuilt(rows))


def test_query_has_the_named_columns(spark, tmp_path):
    frame(spark, conversations(4, 20)).write.parquet(f"{tmp_path}/conversations.parquet")
    out = more_queries.op13_prefix_trie(spark, str(tmp_path))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in out.dtypes} == {"bigint", "string"}
