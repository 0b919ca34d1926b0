"""The prefix trie of sequences by the Euler-tour technique.

A node is a distinct beginning of sequences, named by a polynomial hash of its tokens, which a running pass over the sorted rows gives: in
parts, as a sequence may hold most rows. Each node has an enter and an exit arc; the arcs' successors make one list, the
tour. The list is ranked by contraction: elements whose hash is smaller than both neighbours' leave it, until one task's share is left, and are put
back in reverse. What a subtree holds is then the difference of two prefix sums at the places of its top's arcs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, checked_side
from finpanel.session import materialize

by_value(__name__)

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME
_LOW = (1 << 64) - 1
HASHES = ("hi", "lo", "phi", "plo")


def _halves(values: list[int]) -> list[pa.Array]:
    """Hashes as two columns of longs."""
    return [pa.array(np.array([v >> 64 for v in values], dtype=np.int64)), pa.array(np.array([v & _LOW for v in values], dtype=np.uint64).view(np.int64))]


def _whole(hi: int, lo: int) -> int:
    return (hi << 64) | (lo & _LOW)


def _local(carry: list[str]):
    """Place and hashes of each row within its sequence, as far as this part goes."""

    def run(batches):
        now, i, h = None, 0, 0
        for batch in batches:
            places, ends, befores = [], [], []
            for seq, token in zip(batch.column("seq").to_pylist(), batch.column("token").to_pylist()):
                if seq != now:
                    now, i, h = seq, 0, 0
                befores.append(h)
                i, h = i + 1, (h * BASE + int.from_bytes(token[:16], "big")) % PRIME
                places.append(i)
                ends.append(h)
            columns = [batch.column(c) for c in carry] + [pa.array(places, pa.int64()), *_halves(ends), *_halves(befores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "i", *HASHES])

    return run


def _carried(before: dict[int, tuple[int, int, int]]):
    """Places and hashes of whole sequences: those of rows whose sequence began in an earlier part are moved on."""

    def run(batches):
        for batch in batches:
            part, seq = batch.column("part").to_numpy(), batch.column("seq").to_numpy()
            for p in np.intersect1d(part, np.array(list(before), dtype=np.int64)).tolist():
                of, n, h = before[p]
                rows = np.flatnonzero((part == p) & (seq == of))
                values = {c: batch.column(c).to_numpy().copy() for c in ("i", *HASHES)}
                for r in rows.tolist():
                    i = int(values["i"][r])
                    up = h * pow(BASE, i - 1, PRIME) % PRIME
                    for a, b, moved in (("hi", "lo", up * BASE), ("phi", "plo", up)):
                        x = (_whole(int(values[a][r]), int(values[b][r])) + moved) % PRIME
                        values[a][r], values[b][r] = x >> 64, np.uint64(x & _LOW).astype(np.int64)
                values["i"][rows] += n
                columns = [pa.array(values[c]) if c in values else batch.column(c) for c in batch.schema.names]
                batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield batch

    return run


def running(rows: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """``rows`` with i (place within its ``seq``, from 1, by the columns ``order``, nulls first), hi, lo (hash of the tokens up to the row) and phi, plo (before it).

    ``rows``: seq (long, not null), token (binary of 16 bytes or more) and others. Rows are sorted by ranges, so a sequence may lie in many
    parts: each part numbers and hashes its own rows, and what its first sequence brings along follows from one row per part. Rows that
    agree in all of ``order`` are interchangeable. The result is read from the shared folder. ``parts``: number of ranges, else left to Spark.
    """
    keys, carry = ["seq", *order], [*rows.columns, "part"]
    sorted_ = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    fields = ", ".join(f"{c} {t}" for c, t in (*rows.dtypes, ("part", "int"), ("i", "long"), *((h, "long") for h in HASHES)))
    local = materialize(sorted_.withColumn("part", F.spark_partition_id()).mapInArrow(_local(carry), fields), "running")
    last = F.max(F.struct("seq", "i", "hi", "lo"))
    before, now, n, h = {}, None, 0, 0
    for row in sorted(local.groupBy("part").agg(F.min("seq").alias("first"), last.alias("last")).collect(), key=lambda r: r["part"]):  # one row per task
        if row["first"] == now:
            before[row["part"]] = (now, n, h)
        seq, i, hi, lo = row["last"]
        n, h = (n + i, (h * pow(BASE, i, PRIME) + _whole(hi, lo)) % PRIME) if seq == now else (i, _whole(hi, lo))
        now = seq
    return (local.mapInArrow(_carried(before), fields) if before else local).drop("part")


def _follow(batches):
    """Places of one task's elements id, pred, succ, on: from the one without a predecessor onwards."""
    rows = [(i, p, s, w) for b in batches for i, p, s, w in zip(*(b.column(c).to_pylist() for c in ("id", "pred", "succ", "on")))]
    step, at, place = {i: (s, w) for i, _, s, w in rows}, next((i for i, p, _, _ in rows if p is None), None), 0
    ids, places = [], []
    while at is not None:
        ids.append(at)
        places.append(place)
        at, weight = step[at]
        place += weight
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["id", "pos"])


def list_ranks(links: DataFrame, *, most: int = 200_000) -> DataFrame:
    """id, pos: the place, from 0, of each element of one list given as id, succ (null at the end). Stored.

    In every round the elements whose hash is smaller than both neighbours' leave the list, about a third, no two of them in a row; their
    neighbours learn of each other and of the distance in one shuffle. When at most ``most`` are left, one task walks them. Then the rounds are
    undone: an element stands behind its former predecessor. All rounds together handle a few times the list, whatever its shape. No links, no rows.
    """
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    ends = links.select("id", "succ", none.alias("pred")).unionByName(links.filter("succ IS NOT NULL").select(F.col("succ").alias("id"), none.alias("succ"), F.col("id").alias("pred")))
    level = materialize(ends.groupBy("id").agg(F.max("pred").alias("pred"), F.max("succ").alias("succ")).select("id", "pred", "succ", one.alias("back"), one.alias("on")), "tour")
    gone = []
    while level.count() > most:
        turn = F.lit(len(gone))
        own = F.xxhash64(turn, "id")
        out = F.coalesce((own < F.xxhash64(turn, "pred")) & (own < F.xxhash64(turn, "succ")) & F.col("pred").isNotNull() & F.col("succ").isNotNull(), F.lit(False))
        left = materialize(level.filter(out), "tour")
        gone.append(left)
        told = {"npred": none, "nback": none, "nsucc": none, "non": none}
        stay = level.filter(~out).select("id", "pred", "succ", "back", "on", *(v.alias(c) for c, v in told.items()))
        empty = {"pred": none, "succ": none, "back": none, "on": none} | told
        to_pred = empty | {"nsucc": F.col("succ"), "non": F.col("on")}
        to_succ = empty | {"npred": F.col("pred"), "nback": F.col("back")}
        rows = stay.unionByName(left.select(F.col("pred").alias("id"), *(v.alias(c) for c, v in to_pred.items())))
        rows = rows.unionByName(left.select(F.col("succ").alias("id"), *(v.alias(c) for c, v in to_succ.items())))
        met = rows.groupBy("id").agg(*(F.max(c).alias(c) for c in empty))
        level = materialize(met.select(
            "id", F.coalesce("npred", "pred").alias("pred"), F.coalesce("nsucc", "succ").alias("succ"),
            (F.col("back") + F.coalesce("nback", F.lit(0))).alias("back"), (F.col("on") + F.coalesce("non", F.lit(0))).alias("on"),
        ), "tour")
    found = materialize(level.select("id", "pred", "succ", "on").coalesce(1).mapInArrow(_follow, "id long, pos long"), "tour")
    while gone:
        left = gone.pop().select(F.col("id").alias("left"), "pred", "back")
        back = left.join(found, F.col("pred") == F.col("id")).select(F.col("left").alias("id"), (F.col("pos") + F.col("back")).alias("pos"))
        found = materialize(found.unionByName(back), "tour")
    return found


def prefix_sums(rows: DataFrame, *values: str, block: int = 1 << 16) -> DataFrame:
    """``rows`` with s_<value>, the sum of each value over all rows whose pos (from 0, no two equal) is not larger.

    Running sums are taken in blocks of ``block`` places; what stands before a block is the running sum of the blocks, in blocks again.
    """
    rows = rows.withColumn("block", F.expr(f"pos div {int(block)}"))
    before = [F.lit(0).cast("long").alias(f"b_{v}") for v in values]
    totals = materialize(rows.groupBy("block").agg(*(F.sum(v).alias(v) for v in values)), "blocks")
    if totals.count() > 1:
        sums = prefix_sums(totals.withColumnRenamed("block", "pos"), *values, block=block)
        sums = sums.select(F.col("pos").alias("of"), *((F.col(f"s_{v}") - F.col(v)).alias(f"b_{v}") for v in values))
        rows = rows.join(checked_side(materialize(sums, "blocks")), F.col("block") == F.col("of")).drop("of")
    else:
        rows = rows.select("*", *before)
    up = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s_{v}": F.col(f"b_{v}") + F.sum(v).over(up) for v in values})
    return rows.drop("block", *(f"b_{v}" for v in values))


def _pieces(most: int):
    """Runs of equal nodes in sorted rows hi, lo, seq as texts of at most ``most`` numbers, with the first number of each."""

    def run(batches):
        for batch in batches:
            hi, lo, seq = (batch.column(c).to_numpy() for c in ("hi", "lo", "seq"))
            new = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            edges = np.unique(np.concatenate([new, np.arange(0, len(seq) + 1, most), [len(seq)]]))
            texts = [",".join(map(str, seq[a:b].tolist())) for a, b in zip(edges[:-1], edges[1:])]
            at = edges[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at]), pa.array(seq[at]), pa.array(texts, pa.string())], names=["hi", "lo", "first", "text"])

    return run


def _digests(batches):
    """SHA-256 of each node's pieces, which come in order, joined by commas."""
    now, digest = None, None
    for batch in batches:
        done = []
        for hi, lo, text in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "text"))):
            if (hi, lo) == now:
                digest.update(b",")
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (hi, lo), hashlib.sha256()
            digest.update(text.encode())
        yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(*now, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["hi", "lo", "digest"])


class PrefixTrie:
    """``nodes``: node, hi, lo (its hash; the root's is 0), parent (null at the root), member (smallest sequence), parent_member, depth, n_members, n_children, weight."""

    def __init__(self, rows: DataFrame, sequences: DataFrame, *, parts: int | None = None, siblings: int = 256, most: int = 200_000, block: int = 1 << 16):
        """Build the trie of ``rows``: seq (long), at, token (binary, 16 bytes of a digest or more), weight (long).

        A sequence is its rows in the order of ``at``; ``sequences`` (seq) names each one once, those without rows, too. No sequence, no node. The weight
        of a node is the smallest of its last tokens' weights. A node's name has 127 bits. Nodes that many sequences share are reduced in tasks before the shuffle; a
        node's children are chained in groups of about ``siblings`` (256), so one with very many children is spread, too. ``most`` and ``block``: see
        ``list_ranks`` and ``prefix_sums``. Tables that are read again are stored in the shared folder.
        """
        self.siblings, self.most, self.block, self.parts = siblings, most, block, parts
        zero = F.lit(0).cast("long")
        self.sequences = sequences
        self.rows = materialize(running(rows.select("seq", "at", "token", "weight"), "at", parts=parts).select("seq", "i", "weight", *HASHES), "trie")
        below = self.rows.groupBy("hi", "lo").agg(
            F.min("phi").alias("phi"), F.min("plo").alias("plo"), F.min("seq").alias("member"), F.min("i").alias("depth"), F.count("*").alias("n_members"), F.min("weight").alias("weight")
        )
        root = sequences.agg(F.min("seq").alias("member"), F.count("*").alias("n_members")).filter("n_members > 0")
        root = root.select(zero.alias("hi"), zero.alias("lo"), zero.alias("phi"), zero.alias("plo"), "member", zero.alias("depth"), "n_members", zero.alias("weight"))
        named = materialize(below.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "trie")
        parents = named.select(F.col("hi").alias("uhi"), F.col("lo").alias("ulo"), F.col("node").alias("parent"), F.col("member").alias("parent_member"))
        nothing = F.lit(None).cast("long")
        found = named.filter("depth = 0").withColumns({"parent": nothing, "parent_member": nothing})
        self.root = found.first()
        if self.root:
            top = {"parent": F.lit(self.root["node"]), "parent_member": F.lit(self.root["member"])}
            deep = named.filter("depth > 1").join(parents, (F.col("phi") == F.col("uhi")) & (F.col("plo") == F.col("ulo"))).drop("uhi", "ulo")
            found = found.unionByName(named.filter("depth = 1").withColumns(top)).unionByName(deep)
        found = materialize(found.drop("phi", "plo"), "trie")
        children = found.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
        children = checked_side(materialize(children, "trie"))
        nodes = found.join(children, F.col("node") == F.col("of"), "left").withColumn("n_children", F.coalesce("n_children", zero)).drop("of")
        self.nodes = materialize(nodes, "trie")

    def arcs(self) -> DataFrame:
        """id, succ: the tour. A node's enter arc is twice its number, its exit arc one more; the exit arc of the root has no successor."""
        enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
        widest = self.nodes.agg(F.max("n_children")).first()[0] or 0
        group = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-widest // self.siblings))))
        kin = self.nodes.filter("parent IS NOT NULL").select("parent", "node", group.alias("part"))
        beside = kin.select("parent", "node", F.lead("node").over(Window.partitionBy("parent", "part").orderBy("node")).alias("next"))
        within = beside.filter("next IS NOT NULL").select(leave("node").alias("id"), enter("next").alias("succ"))
        groups = kin.groupBy("parent", "part").agg(F.min("node").alias("head"), F.max("node").alias("tail"))
        by_part = Window.partitionBy("parent").orderBy("part")
        groups = materialize(groups.select("parent", "head", "tail", F.lead("head").over(by_part).alias("next"), F.lag("head").over(by_part).isNull().alias("first")), "tour")
        between = groups.select(leave("tail").alias("id"), F.coalesce(enter("next"), leave("parent")).alias("succ"))
        down = groups.filter("first").select(enter("parent").alias("id"), enter("head").alias("succ"))
        leaves = self.nodes.filter("n_children = 0").select(enter("node").alias("id"), leave("node").alias("succ"))
        last = self.nodes.filter("parent IS NULL").select(leave("node").alias("id"), F.lit(None).cast("long").alias("succ"))
        return within.unionByName(between).unionByName(down).unionByName(leaves).unionByName(last)

    def subtrees(self) -> DataFrame:
        """node, n_leaves, saved: childless nodes, and the sum of (n_members - 1) * weight, in each node's subtree."""
        tour = list_ranks(self.arcs(), most=self.most).withColumn("of", F.shiftright("id", 1)).withColumn("enters", F.pmod("id", F.lit(2)) == 0)
        own = self.nodes.select("node", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_members") - 1) * F.col("weight")).alias("saving"))
        zero = F.lit(0).cast("long")
        tour = tour.join(own, F.col("of") == F.col("node")).select("node", "pos", *(F.when(F.col("enters"), F.col(c)).otherwise(zero).alias(c) for c in ("leaf", "saving")))
        sums = prefix_sums(materialize(tour, "tour"), "leaf", "saving", block=self.block)
        return sums.groupBy("node").agg(*((F.max(f"s_{v}") - F.min(F.col(f"s_{v}") - F.col(v))).alias(c) for v, c in (("leaf", "n_leaves"), ("saving", "saved"))))

    def end_digests(self, *, piece: int = 10_000) -> DataFrame:
        """hi, lo, digest: SHA-256 of the numbers of the sequences that end at a node, ascending, joined by commas; nodes where none ends are left out.

        Rows are sorted by ranges of node and sequence and joined to texts of at most ``piece`` numbers, so that the one task which must read all numbers of
        a node in order reads their text only, piece by piece.
        """
        last = self.rows.groupBy("seq").agg(F.max(F.struct("i", "hi", "lo")).alias("last"))
        ends = self.sequences.join(last.withColumnRenamed("seq", "of"), F.col("seq") == F.col("of"), "left")
        zero = F.lit(0).cast("long")
        ends = ends.select(F.coalesce("last.hi", zero).alias("hi"), F.coalesce("last.lo", zero).alias("lo"), "seq")
        keys = ("hi", "lo", "seq")
        ranged = (ends.repartitionByRange(self.parts, *keys) if self.parts else ends.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        pieces = materialize(ranged.mapInArrow(_pieces(piece), "hi long, lo long, first long, text string"), "ends")
        return pieces.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "text").mapInArrow(_digests, "hi long, lo long, digest string")

    def table(self) -> DataFrame:
        """All nodes with member, depth, parent_member, n_members, n_children, n_leaves, saved, ends (the digest; of nothing where no sequence ends)."""
        below = self.subtrees().withColumnRenamed("node", "top")
        ends = self.end_digests().withColumnsRenamed({"hi": "ehi", "lo": "elo"})
        rows = self.nodes.join(below, F.col("node") == F.col("top")).join(ends, (F.col("hi") == F.col("ehi")) & (F.col("lo") == F.col("elo")), "left")
        none = F.lit(hashlib.sha256().hexdigest())
        return rows.select("member", "depth", "parent_member", "n_members", "n_children", "n_leaves", "saved", F.coalesce("digest", none).alias("ends"))


def conversation_rows(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """seq, turn, token (digest of role and text), weight (the text's code points) of every row; null roles and texts are empty, rows without a conversation left out."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    token = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(f"`{conv}`").isNotNull())
    return rows.select(F.col(f"`{conv}`").cast("long").alias("seq"), F.col(f"`{turn}`").alias("turn"), token.alias("token"), F.length(text).cast("long").alias("weight"))


def rebuilt(conversations: DataFrame, *, every: int = 100, most_head: int = 5, parts: int | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows (seq, at, token, weight) of conversations that begin like their base, and all their ids (seq).

    Conversation c takes the first h rows of conversation c - c % ``every`` (all if it has fewer, none if it is absent) and then its own after its first
    h, h being crc32 of c in decimal modulo ``most_head`` + 1. Rows are ordered by turn, null first, ties by digest of role and text.
    """
    rows = running(conversation_rows(conversations, **columns), "turn", "token", parts=parts).select("seq", "i", "token", "weight")
    rows = materialize(rows, "turns")
    head = F.pmod(F.crc32(F.col("seq").cast("string").cast("binary")), F.lit(most_head + 1).cast("long"))
    ids = rows.groupBy("seq").agg(F.max("i").alias("length"))
    ids = materialize(ids.select("seq", "length", head.alias("head"), (F.col("seq") - F.col("seq") % every).alias("base")), "ids")
    heads = rows.filter((F.col("i") <= most_head) & (F.col("seq") % every == 0)).withColumnRenamed("seq", "of")
    taken = ids.filter("head > 0").join(heads, (F.col("base") == F.col("of")) & (F.col("i") <= F.col("head"))).select("seq", F.col("i").alias("at"), "token", "weight")
    lengths = ids.filter("seq = base").select(F.col("seq").alias("of"), F.col("length").alias("held"))
    short = ids.join(lengths, F.col("base") == F.col("of"), "left").select(F.col("seq").alias("c"), (F.col("head") - F.coalesce("held", F.lit(0))).alias("lacks")).filter("lacks > 0")
    short = checked_side(materialize(short, "ids"))
    own = rows.filter(F.col("i") > head).join(short, F.col("seq") == F.col("c"), "left").select("seq", (F.col("i") - F.coalesce("lacks", F.lit(0))).alias("at"), "token", "weight")
    return taken.unionByName(own), ids.select("seq")
