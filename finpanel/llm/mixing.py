"""Mixing sources to target weights: fixed-length blocks, drawn per output shard and found by permuted index.

Each source's documents, in hashed order, are one stream of words, cut into blocks. Output shards draw how many slots each
source gets (multinomial, by hash); a source's slots count up over the shards, and the i-th takes the block that a keyed
permutation of the source's block numbers gives for i. All of it is DataFrame code on numbers; texts are read once to count words.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.session import materialize

WORDS = r"[^\x20\x09-\x0D]+"
ROUNDS = 24
COPIES = 4096  # equal rows that are put in place at once


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: sid (0 up, by code point, null last), source, size, target.

    The sources share ``share`` times all words by weight; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight until none is above. Sorted by size for weight, the sources that stop come first, so one pass of
    running totals finds the level at which the rest share. One row per source goes through one task here.
    """
    every = Window.partitionBy()
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"))
    sid = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    rows = sources.withColumn("sid", sid).withColumn("weight", weight).withColumn("top", F.col("size") * float(most))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("top") / F.col("weight"), "sid")))
    up = Window.partitionBy(F.lit(0)).orderBy("rank")
    before = F.coalesce(F.sum("top").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("size").over(every) * float(share) - before) / left)
    open_ = F.col("top") > F.col("level") * F.col("weight")
    rows = rows.withColumn("final", F.min(F.when(open_, F.struct("rank", "level"))).over(every)["level"])
    target = F.least("top", F.coalesce(F.col("final") * F.col("weight"), F.col("top")))
    return rows.select("sid", "source", "size", target.alias("target"))


def permuted(i, n, *key):
    """The place of ``i`` in a keyed pseudorandom permutation of 0 to n - 1 (swap-or-not: each round mirrors i or leaves it)."""
    n = F.greatest(n, F.lit(1).cast("long"))

    def once(x, r):
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("mirror"), *key, r), n) - x + n, n)
        swap = F.pmod(F.xxhash64(F.lit("swap"), *key, r, F.greatest(x, mirror)), F.lit(2).cast("long")) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), once)


def placed(sized: DataFrame, sources: DataFrame, seed: int, rows_per_part: int = 4096) -> DataFrame:
    """Every document with its text's hash, its source's sid and the words before it in its source's stream (hashed order).

    A source may hold most rows, so running totals are taken within parts of the hash range and added to totals of the parts. Equal rows are one
    row with a count until their places are known, and rows with one key but other texts are parted by the hash, so that neither makes a part large.
    """
    alike = sized.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("n"))
    alike = materialize(alike.withColumn("h", F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "t", "size")), "mix")
    bits = max(0, math.ceil(math.log2(max(1, alike.count() / rows_per_part))))
    rows = alike.withColumn("part", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("long"))
    whole = F.col("size") * F.col("n")
    parts = rows.groupBy("source", "part").agg(F.sum(whole).alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    named = sources.select(F.col("source").alias("n_"), "sid")
    parts = parts.join(named, F.col("s").eqNullSafe(F.col("n_"))).select("s", "p", "base", "sid")
    within = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(whole).over(within), F.lit(0)))
    joined = rows.join(parts, rows["source"].eqNullSafe(parts["s"]) & (rows["part"] == parts["p"]))
    first = joined.select("doc_id", "t", "size", "sid", "n", (F.col("base") + F.col("inner")).alias("start"))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    copies = F.explode(F.sequence(F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1)).alias("copy")
    return runs.select("doc_id", "t", "size", "sid", "start", copies).select("doc_id", "t", "size", "sid", (F.col("start") + F.col("copy") * F.col("size")).alias("start"))


def drawn_slots(sources: DataFrame, seed: int, block: int, shard_slots: int) -> DataFrame:
    """shard, slot, sid, block, take: the block and the words of it that every slot of every shard takes.

    Every slot of a shard draws a source with odds in proportion to the sources' slots. Draws beyond a source's slots go to the
    sources that were drawn too seldom, matched by ordinal, so that every source gets exactly its slots. A first pass
    goes through all blocks of a source, a second starts anew in another order; the last slot takes only what the target still lacks.
    """
    spark, words = sources.sparkSession, F.round("target").cast("long")
    blocks = F.ceil(F.col("size") / block).cast("long")
    needed = F.when(F.col("words") <= F.col("size"), F.ceil(F.col("words") / block)).otherwise(F.col("blocks") + F.ceil((F.col("words") - F.col("size")) / block)).cast("long")
    order = Window.partitionBy(F.lit(0)).orderBy("sid")
    plan = sources.withColumns({"words": words, "blocks": blocks}).withColumn("slots", needed).filter("slots > 0")
    plan = plan.withColumn("first", F.sum("slots").over(order) - F.col("slots"))
    plan = materialize(plan.select("sid", "size", "words", "blocks", "slots", "first"), "mix")
    total, n_sources = plan.agg(F.sum("slots"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "shard long, slot long, sid int, block long, take long")
    width = max(1, total // max(1024, 4 * n_sources))
    cells = plan.select("sid", "slots", "first", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width))).alias("cell"))
    draws = spark.range(total).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod("id", F.lit(shard_slots)).alias("slot"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(total)).alias("r")
    ).withColumn("at", F.floor(F.col("r") / width))
    drawn = draws.join(cells, (F.col("at") == F.col("cell")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("first") + F.col("slots"))).select("shard", "slot", "sid")
    drawn = materialize(drawn, "mix")
    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("shard")
    counts = materialize(counts.select(F.col("sid").alias("cs"), F.col("shard").alias("ch"), "n", (F.sum("n").over(earlier) - F.col("n")).alias("base")), "mix")
    rank = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot"))
    numbered = drawn.withColumn("rank", rank).join(counts, (F.col("shard") == F.col("ch")) & (F.col("sid") == F.col("cs"))).select("shard", "slot", "sid", (F.col("base") + F.col("rank") - 1).alias("i"))
    got = counts.groupBy(F.col("cs").alias("gs")).agg(F.sum("n").alias("got"))
    balance = plan.join(got, F.col("sid") == F.col("gs"), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over, under = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    balance = materialize(balance.select(
        "sid", "size", "words", "blocks", "slots", "got", (F.sum(over).over(order) - over).alias("over_first"), (F.sum(under).over(order) - under).alias("under_first")
    ), "mix")
    limits = balance.select(F.col("sid").alias("ls"), "slots", "over_first")
    numbered = numbered.join(limits, F.col("sid") == F.col("ls"))
    kept = numbered.filter("i < slots").select("shard", "slot", "sid", "i")
    extra = numbered.filter("i >= slots").select("shard", "slot", (F.col("over_first") + F.col("i") - F.col("slots")).alias("ordinal"))
    lacking = balance.filter("got < slots").select("sid", (F.col("under_first") - F.col("got")).alias("shift"), F.explode(F.sequence("got", F.col("slots") - 1)).alias("i"))
    lacking = lacking.select("sid", "i", (F.col("shift") + F.col("i")).alias("lacks"))
    moved = extra.join(lacking, F.col("ordinal") == F.col("lacks")).select("shard", "slot", "sid", "i")
    facts = balance.select(F.col("sid").alias("fs"), "size", "words", "blocks")
    slots = kept.unionByName(moved).join(facts, F.col("sid") == F.col("fs"))
    again = F.when(F.col("i") >= F.col("blocks"), 1).otherwise(0).cast("long")
    slots = slots.withColumn("again", again).withColumn("j", F.col("i") - F.col("again") * F.col("blocks")).withColumn("whole", F.floor(F.col("size") / block))
    place = F.when(F.col("j") < F.col("whole"), permuted(F.col("j"), F.col("whole"), F.lit(seed), F.col("sid"), F.col("again"))).otherwise(F.col("whole"))
    take = F.least(F.lit(block).cast("long"), F.col("size") - F.col("j") * block, F.col("words") - F.col("again") * F.col("size") - F.col("j") * block)
    return slots.select("shard", "slot", "sid", place.alias("block"), take.alias("take"))


class Mix:
    """A drawn mix: ``sources``, ``documents`` (doc_id, t, size, sid, start) and ``slots`` as stored tables."""

    def __init__(self, documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, block: int = 512, shard_slots: int = 4096, **targets):
        """``targets``: weights, share, most (see ``source_targets``).

        Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, sorted last; repeated rows are
        documents of their own; an empty table gives an empty mix. Only the named columns are read, so others cannot clash. The
        same rows and seed give the same mix, in whatever order or partitions they come.
        """
        self.block = block
        sized = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("t"))
        sized = materialize(sized, "mix")
        self.texts = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), F.col(f"`{text}`").alias("text"))
        self.sources = materialize(source_targets(sized, **targets), "mix")
        self.documents = materialize(placed(sized, self.sources, seed), "mix")
        self.slots = drawn_slots(self.sources, seed, block, shard_slots)

    def _segments(self) -> DataFrame:
        """The part of every non-empty document that lies in each block: block_no, from, to in the source's stream."""
        b = self.block
        last = F.floor((F.col("start") + F.col("size") - 1) / b)
        rows = self.documents.filter("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / b), last)))
        return rows.select(
            "doc_id", "t", F.col("sid").alias("own"), "start", "block_no", F.greatest("start", F.col("block_no") * b).alias("from"),
            F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * b).alias("to"),
        )

    def _spans(self) -> DataFrame:
        joined = self._segments().join(self.slots, (F.col("own") == F.col("sid")) & (F.col("block_no") == F.col("block")))
        n = F.least("to", F.col("block") * self.block + F.col("take")) - F.col("from")
        return joined.select("shard", "slot", "sid", "doc_id", "t", "start", (F.col("from") - F.col("start")).alias("word_from"), n.alias("n_words")).filter("n_words > 0")

    def spans(self) -> DataFrame:
        """shard, slot, sid, doc_id, word_from, n_words: what every slot holds, by document; blocks are joined by index."""
        return self._spans().drop("t", "start")

    def blocks(self) -> DataFrame:
        """shard, slot, sid, n_words, text: the mix itself. Words keep the white space after them, a new line parts documents.

        A document's spans are collected before they meet its text, which is cut once, so only the words of the mix are shuffled on. Copies are documents
        of their own, so what is collected is bounded by a document's words.
        """
        each = self._spans().groupBy("sid", "doc_id", "t", "start").agg(F.collect_list(F.struct("shard", "slot", "word_from", "n_words")).alias("held"))
        each = each.join(self.sources.select(F.col("sid").alias("n"), "source"), F.col("sid") == F.col("n"))
        texts = self.texts.withColumn("x", F.xxhash64("text")).groupBy("k", "s", "x").agg(F.first("text").alias("text"))
        found = each.join(texts, F.col("doc_id").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("t") == F.col("x")))

        def cut(words):
            return F.transform("held", lambda h: F.struct(
                h["shard"].alias("shard"), h["slot"].alias("slot"), F.col("start").alias("start"), h["n_words"].alias("n"),
                F.array_join(F.slice(words, (h["word_from"] + 1).cast("int"), h["n_words"].cast("int")), "").alias("piece"),
            ))

        words = F.regexp_extract_all("text", F.lit(WORDS + r"[\x20\x09-\x0D]*"), F.lit(0))
        pieces = found.select("sid", F.inline(F.flatten(F.transform(F.array(words), cut))))  # the words are a lambda's variable: found once
        held = pieces.groupBy("shard", "slot", "sid").agg(F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
        return held.select("shard", "slot", "sid", "n_words", F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n").alias("text"))

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target (its source's), taken (words of its spans in the mix, repeats counted)."""
        held = self._spans().groupBy(F.col("sid").alias("of"), F.col("start").alias("at")).agg(F.sum("n_words").alias("held"))
        rows = self.documents.join(held, (F.col("size") > 0) & (F.col("sid") == F.col("of")) & (F.col("start") == F.col("at")), "left")
        facts = self.sources.select(F.col("sid").alias("own"), F.col("size").alias("source_size"), "target")
        rows = rows.select("doc_id", "size", "sid", F.coalesce("held", F.lit(0).cast("long")).alias("taken"))
        return rows.join(facts, F.col("own") == F.col("sid")).select("doc_id", "size", "source_size", "target", "taken")
