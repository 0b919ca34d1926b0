"""URL filter: a trie over reversed host labels and path segments, longest match between allow and block rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value
from finpanel.session import materialize

by_value(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "struct<labels int, chars int, block int, rule string>"


def build_trie(rules) -> dict:
    """Trie of (host, path, verdict) triples.

    A host node maps labels to host nodes and may hold, under ``None``, the root of its paths. A path node has ``kids`` (whole
    segments) and ``tails``: a rule whose last segment is only begun, by the length and text of that beginning.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        labels = host.split(".") if host else []
        for label in reversed(labels):
            node = node.setdefault(label, {})
        paths = node.setdefault(None, {"kids": {}, "tails": {}, "any": None})
        found = (len(labels), len(path), int(verdict == "block"), host + path)
        if not path:
            paths["any"] = max(found, paths["any"] or found)
            continue
        *whole, begun = path[1:].split("/")
        for segment in whole:
            paths = paths["kids"].setdefault(segment, {"kids": {}, "tails": {}, "any": None})
        known = paths["tails"].setdefault(len(begun), {})
        known[begun] = max(found, known.get(begun, found))
    return root


def longest(root: dict, host: str, path: str):
    """The longest rule that fits: most host labels, then the longest path, then block before allow; or None."""
    nodes, node = [root], root
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        nodes.append(node)
    segments = path[1:].split("/") if path else []
    for node in reversed(nodes):
        paths = node.get(None)
        if paths is None:
            continue
        best = paths["any"]
        for i, segment in enumerate(segments):
            for size, known in paths["tails"].items():
                found = known.get(segment[:size]) if len(segment) >= size else None
                if found is not None and (best is None or found > best):
                    best = found
            paths = paths["kids"].get(segment) if i + 1 < len(segments) else None
            if paths is None:
                break
        if best is not None:
            return best
    return None


def split_url(url):
    """Columns host and path: host after the first ``://`` up to ``/``, ``?``, ``#``; path up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _tries(rules: DataFrame, most_chars: int):
    """Rules as tries of a bounded size each, read from the cluster a piece at a time."""
    held, size = [], 0
    for r in rules.select("host", "path", "verdict").toLocalIterator():
        if r.host is None or r.verdict not in ("allow", "block"):
            continue
        held.append((r.host.lower(), r.path or "", r.verdict))
        size += len(r.host) + len(r.path or "") + 200
        if size >= most_chars:
            yield build_trie(held)
            held, size = [], 0
    if held:
        yield build_trie(held)


def _look_up(shared):
    @F.pandas_udf(FOUND)
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        root = shared.value
        return pd.DataFrame([longest(root, h, p) or (None, None, None, None) for h, p in zip(hosts, paths)], columns=["labels", "chars", "block", "rule"]).astype(
            {"labels": "Int32", "chars": "Int32", "block": "Int32", "rule": "object"}
        )

    return look_up


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", most_chars: int = 64_000_000) -> DataFrame:
    """Verdict for every row of ``pages``: key, host, path, rule (null if none fits), verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the path starts with the
    rule's; an empty host fits every url. The trie is broadcast in pieces of at most ``most_chars`` estimated characters; with more than
    one, every piece is a pass of its own over rows of the shared folder, so that a task holds one at a time, and the longest rule of all passes wins.
    Rows are never shuffled, so a frequent host costs nothing extra.

    Null url or one without ``://``: empty host and path, which only a rule with an empty host and path can fit. Empty tables give
    no rows; repeated rows are judged each; only ``key`` and ``url`` are read, so other columns cannot clash. Rules with a null
    host or an unknown verdict are left out; of two equal rules block wins.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", F.lit(None).cast(FOUND))
    for n, trie in enumerate(_tries(rules, most_chars)):
        rows = materialize(rows, "verdicts") if n else rows
        found = _look_up(pages.sparkSession.sparkContext.broadcast(trie))("host", "path")
        rows = rows.withColumn("best", F.greatest("best", F.when(found["rule"].isNotNull(), found)))
    verdict = F.when(F.col("best.block") == 1, "block").when(F.col("best.block") == 0, "allow").otherwise(default)
    return rows.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
