"""Line-first cleaning: rules on punctuation, navigation and boilerplate decide line by line, then a document that lost too much goes.

A word is a run of characters other than space and the control characters 9 to 13. A line without words is blank: it is never judged and stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value, text_groups

by_value(__name__)

GAP = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&<"  # the symbols that do not part labels

# The rules' patterns, which the SQL of the query uses as they stand.
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*$"""
SEPARATOR = r"[|>»›•·]+"
MENU = (
    r"(?i)^(home|menu|skip to|back to top|read more|click here|next|previous|sign in|sign up|log ?in|log ?out|register|share|print|search|subscribe|follow us"
    r"|contact|about us|site ?map|faq|help)([^A-Za-z]|$)"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright (©|\(c\)|[0-9]{4})|©|(privacy|cookie) policy|terms (of use|of service|and conditions)"
    r"|(uses?|use of|accept|enable) (cookies|javascript)|lorem ipsum|(licensed|released) under|^powered by|subscribe to (our|the) newsletter|unsubscribe|(share|follow us|like us) on )"
)
SHORT, MENU_WORDS, NOTICE_WORDS = 8, 5, 40  # an unpunctuated line, a menu entry and a notice have fewer, at most, and at most so many words
MARK_SHARE, LABEL_WORDS = 10, 5  # in percent of a line's characters; words per separator in a row of labels

_WORD, _END, _SEPARATOR, _MENU, _BOILERPLATE = (re.compile(p) for p in (WORD, SENTENCE_END, SEPARATOR, MENU, BOILERPLATE))
RULES = ("punctuation", "navigation", "boilerplate")


def solid(text: str) -> int:
    """Characters inside words."""
    return len(text) - sum(map(text.count, GAP))


def failed_rule(line: str) -> int | None:
    """The first of RULES that a line with words fails, as its number.

    Punctuation: a line of fewer than 8 words that does not end like a sentence, or one in which more than a tenth of the characters are marks. Navigation:
    labels of few words between two separators or more, or a short line that starts like a menu entry and is no sentence. Boilerplate: a legal, cookie,
    script, licence or newsletter notice in a line of 40 words at most.
    """
    line = line.strip(GAP)
    words = _WORD.findall(line)
    n, sentence = len(words), _END.search(line) is not None
    if n < SHORT and not sentence or 100 * sum(map(line.count, MARKS)) > MARK_SHARE * solid(line):
        return 0
    separators = sum(1 for w in words if _SEPARATOR.fullmatch(w)) if any(s in line for s in "|>»›•·") else 0
    if separators >= 2 and n <= LABEL_WORDS * separators or n <= MENU_WORDS and not sentence and _MENU.search(line):
        return 1
    if n <= NOTICE_WORDS and _BOILERPLATE.search(line):
        return 2
    return None


def repeated_words(text: str, size: int = 3) -> tuple[int, int]:
    """Words of the text, and words that stand in a window of ``size`` words that occurs twice or more, each word once."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(m.group(), len(seen)) for m in _WORD.finditer(text)), dtype=np.int64)
    n = len(ids)
    if n < size:
        return n, 0
    window, most = np.zeros(n - size + 1, dtype=np.int64), 1  # windows as numbers, exactly: renumbered where 63 bits would not do
    for j in range(size):
        if most * len(seen) >= 1 << 62:
            window, most = np.unique(window, return_inverse=True)[1], n
        window, most = window * len(seen) + ids[j : n - size + 1 + j], most * len(seen)
    window = np.unique(window, return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[:-size] += again
    edge[size:] -= again
    return n, int((np.cumsum(edge[:-1]) > 0).sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars")


def judged(text: str | None) -> tuple[str | None, list[int]]:
    """The text without the lines that fail a rule, and the values of COUNTS, all of the whole text."""
    whole = text or ""
    n_words, n_repeat = repeated_words(whole)
    seen, kept, failed = set(), [], [0, 0, 0]
    n_lines = n_dup = lost = 0
    for line in whole.split("\n"):
        if not line.strip(GAP):
            kept.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        rule = failed_rule(line)
        if rule is None:
            kept.append(line)
        else:
            failed[rule] += 1
            lost += solid(line)
    cleaned = text if lost == 0 else "\n".join(kept)
    return cleaned, [n_words, solid(whole), sum(map(whole.count, SYMBOLS)), n_dup, n_repeat, n_lines, *failed, lost]


def _judge(most_bytes: int, carry: str, with_text: bool):
    def run(batches):
        for part in text_groups(batches, "text", most_bytes):
            found = [judged(t) for t in part.column("text").to_pylist()]
            counts = np.array([f[1] for f in found], dtype=np.int64).reshape(-1, len(COUNTS))
            columns = [part.column(carry)] + ([pa.array([f[0] for f in found], pa.string())] if with_text else []) + [pa.array(c) for c in counts.T]
            yield pa.RecordBatch.from_arrays(columns, names=[carry, *(["text"] if with_text else []), *COUNTS])

    return run


def _verdict(rows: DataFrame, least_words: int, most_repeat: int, most_lost: int) -> DataFrame:
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_chars") <= most_lost * F.col("word_chars")))


def judge(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = 50, most_repeat: int = 50, most_lost: int = 30, most_bytes: int = 4_000_000,
) -> DataFrame:
    """Per row: key, the COUNTS, base_failed, kept.

    A document fails outright with fewer than ``least_words`` words or with more than ``most_repeat`` percent of them in repeated three-word windows; it is
    rejected, too, if the lines that fail a rule hold more than ``most_lost`` percent of its characters in words. A null or empty text has counts of 0
    and fails; repeated rows are judged each; an empty table gives no rows. A text of any length is read whole, in memory in proportion to it. It is a map over rows
    that reads the two named columns only, so others cannot clash.
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    found = _verdict(rows.mapInArrow(_judge(most_bytes, "key", False), kinds), least_words, most_repeat, most_lost)
    return found.withColumnRenamed("key", key)


def clean(
    documents: DataFrame, *, text: str = "text", least_words: int = 50, most_repeat: int = 50, most_lost: int = 30, most_bytes: int = 4_000_000,
) -> DataFrame:
    """The documents that ``judge`` keeps, without their failing lines; other columns stay as they are, whatever their names."""
    names = documents.columns
    others = [c for c in names if c != text]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(0)
    rows = documents.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, text string, " + ", ".join(f"{c} long" for c in COUNTS)
    found = _verdict(rows.mapInArrow(_judge(most_bytes, "row", True), kinds), least_words, most_repeat, most_lost).filter("kept")
    return found.select(*(F.col("text").alias(c) if c == text else F.col(f"row.c{others.index(c)}").alias(c) for c in names))
