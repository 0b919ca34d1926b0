"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each formatted as one conversation.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings of this and other usual templates get a
backslash after their first character wherever they occur in roles and texts; one that has such backslashes already gets
one more, so taking one away restores every text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finpanel.session import materialize

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of chat templates, without their first character.
CONTROL = r"(\|(?:im_start|im_sep|im_end|endoftext|system|user|assistant|end)\|>|/?s>|/?INST\]|</?SYS>>)"


def escape(text):
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text):
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def _same(own: str, other: str):
    """Join condition of two frames whose second names its conversation ``conv2``: same conversation (null included), equal nodes."""
    return F.col("conv").eqNullSafe(F.col("conv2")) & (F.col(own) == F.col(other))


def chosen_paths(messages: DataFrame, *, best: int | None = None) -> DataFrame:
    """Rows conv, leaf, node, place: the nodes of each chosen path, ``place`` counted back from the leaf.

    ``messages`` has conv, node, parent, score, one row per node. Self-joins double the distance every node looks up the tree, so
    a path of n turns takes log2(n) joins; the chosen leaves then gather their ancestors with the same tables, far jumps first.
    A branch's score is the sum along its path, null counting 0; with ``best`` only that many per conversation are kept (ties: the
    smaller leaf). A parent that is not there makes a root; nodes that never reach a root stand on a cycle and have no path.
    """
    nodes = messages.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("conv").alias("conv2"), F.col("node").alias("up"))
    jump = materialize(nodes.join(known, _same("parent", "up")).select("conv", "node", "up", "score"), "chat")
    largest = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    steps = []  # the k-th: every node that has an ancestor 2**k above it, that ancestor, and the scores up to it
    while not jump.isEmpty():
        if 1 << len(steps) >= largest:
            break  # further up than a conversation has nodes: these nodes lead to a cycle
        steps.append(jump)
        far = jump.select(F.col("conv").alias("conv2"), F.col("node").alias("near"), F.col("up").alias("further"), F.col("score").alias("beyond"))
        jump = materialize(jump.join(far, _same("up", "near")).select("conv", "node", F.col("further").alias("up"), (F.col("score") + F.col("beyond")).alias("score")), "chat")
    leaves = nodes.select("conv", F.col("node").alias("leaf"), "score")
    if steps:
        parents = steps[0].select(F.col("conv").alias("conv2"), F.col("up").alias("inner")).distinct()
        leaves = leaves.join(parents, _same("leaf", "inner"), "left_anti")
    leaves = leaves.join(jump.select(F.col("conv").alias("conv2"), F.col("node").alias("endless")), _same("leaf", "endless"), "left_anti")
    if best is not None:
        leaves = materialize(_best(leaves, steps, nodes, best), "chat")
    rows = leaves.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("place"))
    for k in range(len(steps) - 1, -1, -1):
        step = steps[k].select(F.col("conv").alias("conv2"), F.col("node").alias("from"), "up")
        above = rows.join(step, _same("node", "from")).select("conv", "leaf", F.col("up").alias("node"), (F.col("place") + (1 << k)).alias("place"))
        rows = rows.unionByName(above)
        if k and k % 4 == 0:
            rows = materialize(rows, "chat")
    return rows


def _best(leaves: DataFrame, steps: list[DataFrame], nodes: DataFrame, best: int) -> DataFrame:
    """The leaves of the ``best`` branches of each conversation: every leaf walks up to its root, far jumps first, adding scores."""
    walk = leaves.select("conv", "leaf", F.col("leaf").alias("at"), F.lit(0.0).alias("total"))
    for step in reversed(steps):
        far = step.select(F.col("conv").alias("conv2"), F.col("node").alias("near"), "up", "score")
        walk = walk.join(far, _same("at", "near"), "left").select("conv", "leaf", F.coalesce("up", "at").alias("at"), (F.col("total") + F.coalesce("score", F.lit(0.0))).alias("total"))
    roots = nodes.select(F.col("conv").alias("conv2"), F.col("node").alias("root"), "score")
    walk = walk.join(roots, _same("at", "root")).withColumn("total", F.col("total") + F.col("score"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("total").desc(), "leaf"))
    return walk.withColumn("rank", rank).filter(F.col("rank") <= best).select("conv", "leaf")


def format_trees(messages: DataFrame, *, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: conv, leaf, score, formatted, loss_mask.

    ``messages``: conv, node, parent, score, role, text. ``loss_mask`` lists the texts of role ``learn`` as structs: turn (from 0),
    start (code points before it in ``formatted``), within (in its turn), n_chars. Null roles and texts are empty; of rows with one
    conversation and node the smallest (parent, score, role, text) counts; a null node is none and is left out; an empty table
    gives no rows. Only the named columns are read. A path is one output row and so must fit a task; a conversation of many
    branches need not, as paths are grouped by leaf.
    """
    each = messages.filter("node IS NOT NULL").groupBy("conv", "node").agg(
        F.min(F.struct("parent", F.col("score").cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m")
    ).select("conv", "node", "m.*")
    each = materialize(each, "chat")
    paths = chosen_paths(each, best=best)
    texts = each.select(F.col("conv").alias("conv2"), F.col("node").alias("of"), F.coalesce("score", F.lit(0.0)).alias("score"), "role", "text")
    turns = paths.join(texts, _same("node", "of")).select(
        "conv", "leaf", "score", "place", (F.col("role") == learn).alias("learn"), escape("role").alias("role"), escape("text").alias("text")
    )
    path = Window.partitionBy("conv", "leaf").orderBy(F.col("place").desc())
    head = F.length("role") + len(START) + len(MIDDLE)
    turns = turns.select(
        "conv", "leaf", "score", "learn", F.concat(F.lit(START), "role", F.lit(MIDDLE), "text", F.lit(END)).alias("piece"),
        head.cast("long").alias("within"), F.length("text").cast("long").alias("n_chars"), F.row_number().over(path).alias("turn"),
        F.coalesce(F.sum(head + F.length("text") + len(END)).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    whole = turns.groupBy("conv", "leaf").agg(
        F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("turn", "piece", "learn", "before", "within", "n_chars"))).alias("turns")
    )
    mask = F.transform(
        F.filter("turns", lambda t: t["learn"]),
        lambda t: F.struct((t["turn"] - 1).alias("turn"), (t["before"] + t["within"]).alias("start"), t["within"].alias("within"), t["n_chars"].alias("n_chars")),
    )
    return whole.select("conv", "leaf", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def pieces(formatted):
    """The turns of a formatted conversation as written, each without its end mark."""
    parts = F.split(formatted, r"\Q" + END + r"\E", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted):
    """The turns of a formatted conversation, read back: array of role and text."""
    halves = F.transform(pieces(formatted), lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"\Q" + MIDDLE + r"\E", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def read_loss(formatted, mask):
    """All text under the loss mask, unescaped, nothing between."""
    parts = pieces(formatted)
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(F.get(parts, m["turn"]), m["within"].cast("int") + 1, m["n_chars"].cast("int")))), "")
