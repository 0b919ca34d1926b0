"""The registered queries of centroid clustering, line-first cleaning, the prefix trie and ranked reply trees, and their SQL for DuckDB."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from finpanel.llm import centroids, chat, decontaminate, line_rules, prefix_trie, url_filter
from finpanel.llm.common import table
from finpanel.session import materialize

# ---- 11: centroid clusters --------------------------------------------------------------------------


def op11_centroids(spark, sf):
    fitted = centroids.Clustering(table(spark, sf, "embeddings"))
    rows = materialize(fitted.assigned().withColumnRenamed("key", "vec_id"), "clusters")
    totals = dict(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # one row per cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in fitted.centroids.tolist()]
    facts = [(i, int(totals.get(i, 0)), int(sum(totals.values())), d) for i, d in enumerate(digests)]
    facts = spark.createDataFrame(facts, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroids_sql(k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, salt: str = "2:") -> str:
    """Every round compares all vectors with all centroids: right for the test tables, slow for large ones."""
    near = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x, y)])"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, [CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id) NULLS LAST, embedding) - 1 AS INTEGER) AS c, x AS y FROM v
  ORDER BY c LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, min(row(d, c)) AS best FROM (SELECT n, c, {near} AS d FROM v, c{r}) GROUP BY n)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT best[2] AS c, i, sum(x[i]) AS s, count(*) AS w FROM a{r} JOIN v USING (n), range(1, {dims} + 1) AS t(i) GROUP BY ALL)")
            parts.append(f"u{r} AS (SELECT c, list(CAST((s - ((s % w) + w) % w) // w AS BIGINT) ORDER BY i) AS z FROM m{r} GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(z, y) AS y FROM c{r} LEFT JOIN u{r} USING (c))")
    return f"""WITH {", ".join(parts)},
found AS (SELECT vec_id, best[2] AS cluster, CAST(best[1] AS BIGINT) AS distance FROM a{rounds} JOIN v USING (n))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256 FROM found JOIN c{rounds} ON c = cluster"""


# ---- 12: lines, then documents ----------------------------------------------------------------------


def op12_line_rules(spark, sf):
    return line_rules.judge(table(spark, sf, "documents"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SYMBOLS = "[#*$%&|<>]"
LINE_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(regexp_extract_all(text, '{line_rules.WORD}')) AS w, unnest(range(1, len(regexp_extract_all(text, '{line_rules.WORD}')) + 1)) AS i FROM docs),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM
  (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE w3 IS NOT NULL),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM grams WHERE n > 1) GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS raw FROM docs),
lines AS (SELECT r, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM raw WHERE regexp_matches(raw, '{line_rules.WORD}')),
facts AS (SELECT *, len(w) AS n, list_sum([length(x) FOR x IN w]) AS chars, length(line) - length(regexp_replace(line, '[{line_rules.MARKS}]', '', 'g')) AS marks,
  len([x FOR x IN w IF regexp_full_match(x, {_quoted(line_rules.SEPARATOR)})]) AS separators, regexp_matches(line, {_quoted(line_rules.SENTENCE_END)}) AS sentence,
  regexp_matches(line, {_quoted(line_rules.MENU)}) AS menu, regexp_matches(line, {_quoted(line_rules.BOILERPLATE)}) AS notice
  FROM (SELECT *, regexp_extract_all(line, '{line_rules.WORD}') AS w FROM lines)),
ruled AS (SELECT *, CASE WHEN n < {line_rules.SHORT} AND NOT sentence OR 100 * marks > {line_rules.MARK_SHARE} * chars THEN 0
  WHEN separators >= 2 AND n <= {line_rules.LABEL_WORDS} * separators OR n <= {line_rules.MENU_WORDS} AND NOT sentence AND menu THEN 1
  WHEN n <= {line_rules.NOTICE_WORDS} AND notice THEN 2 END AS rule FROM facts),
by_doc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT raw) AS n_dup_lines, count(*) FILTER (rule = 0) AS n_punctuation, count(*) FILTER (rule = 1) AS n_navigation,
  count(*) FILTER (rule = 2) AS n_boilerplate, CAST(coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS BIGINT) AS lost_chars FROM ruled GROUP BY r),
whole AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '{_SYMBOLS}', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_punctuation, 0) AS n_punctuation,
  coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(lost_chars, 0) AS lost_chars
  FROM docs LEFT JOIN sizes USING (r) LEFT JOIN repeats USING (r) LEFT JOIN by_doc USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept FROM whole"""

# ---- 13: the prefix trie of conversations -----------------------------------------------------------


def op13_prefix_trie(spark, sf):
    rows, ids = prefix_trie.rebuilt(table(spark, sf, "conversations"))
    nodes = prefix_trie.PrefixTrie(rows, ids).table()
    names = {"member": "conv_id", "parent_member": "parent_conv_id", "n_members": "n_convs", "saved": "saved_tokens", "ends": "ends_sha256"}
    return nodes.withColumnsRenamed(names)


#: Every node is joined with all nodes below it: right for the test tables, slow for large ones. CRC-32 by its table of 256 remainders.
PREFIX_TRIE = """
WITH RECURSIVE remainders(i, x, s) AS (SELECT i, i, 0 FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, s + 1 FROM remainders WHERE s < 8),
crc AS (SELECT list(x ORDER BY i) AS t FROM remainders WHERE s = 8),
tokens AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token, length(coalesce(text, '')) AS weight
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, token, weight, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS i FROM tokens),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, count(*) AS n FROM turns GROUP BY conv_id),
heads AS (SELECT ids.*, coalesce(base.n, 0) AS held, xor(list_reduce(list_concat([4294967295], [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(ids.c AS VARCHAR), '')]),
  lambda a, d: xor(a >> 8, t[(xor(a, d) & 255) + 1])), 4294967295) % 6 AS h FROM ids LEFT JOIN ids AS base ON base.c = ids.b, crc),
rebuilt AS (SELECT c, i AS pos, token, weight FROM heads JOIN turns ON conv_id = b AND i <= h
  UNION ALL SELECT c, i - h + least(h, held), token, weight FROM turns JOIN heads ON conv_id = c WHERE i > h),
prefixes AS (SELECT c, pos, weight, string_agg(token, '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT p, pos, min(c) AS conv_id, count(*) AS n_convs, min(weight) AS weight FROM prefixes GROUP BY p, pos),
families AS (SELECT left(p, length(p) - 64) AS p, count(*) AS n_children FROM nodes WHERE pos > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN families USING (p)),
subtrees AS (SELECT left(p, 64 * d) AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * weight) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(pos + 1)) AS d FROM known) GROUP BY ALL),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, arg_max(p, pos) AS p FROM prefixes GROUP BY c) GROUP BY p)
SELECT known.conv_id, known.pos AS depth, up.conv_id AS parent_conv_id, known.n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM known JOIN subtrees USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes AS up ON known.pos > 0 AND up.p = left(known.p, length(known.p) - 64)"""

# ---- 6: ranked branches of reply trees --------------------------------------------------------------

BEST_BRANCHES = 3


def chat_branches(spark, sf):
    """Reply trees of eight conversations each, the best branches of every tree.

    Conversation k of a tree (conv_id modulo 8) continues the second turn of conversation (k - 1) div 2, or is a root if that has none. A turn's score is its text's length modulo 17.
    """
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, sf, "conversations").filter("conv_id IS NOT NULL").select("conv_id", turn.cast("long").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.expr("pmod(conv_id, 8)")
    rows = rows.select(
        F.floor(F.col("conv_id") / 8).alias("conv"), (place * 1000 + F.col("n")).alias("node"), "role", "text", (F.length("text") % 17).cast("double").alias("score"),
        F.when(F.col("n") > 1, place * 1000 + F.col("n") - 1).when(place > 0, F.expr("(pmod(conv_id, 8) - 1) div 2 * 1000 + 2")).alias("parent"),
    )
    out = chat.format_trees(rows, best=BEST_BRANCHES).withColumn("turns", chat.read_turns(F.col("formatted")))
    pieces = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(F.col("conv").alias("tree"), "leaf", "score", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(pieces, ""), 256).alias("turns_sha256"))


CHAT_BRANCHES = f"""
WITH RECURSIVE numbered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, (conv_id % 8 + 8) % 8 AS k FROM numbered),
nodes AS (SELECT (conv_id - k) // 8 AS tree, k * 1000 + n AS node, CASE WHEN n > 1 THEN k * 1000 + n - 1 WHEN k > 0 THEN (k - 1) // 2 * 1000 + 2 END AS parent,
  CAST(length(text) % 17 AS DOUBLE) AS score, role || chr(10) || text || chr(10) AS piece FROM placed),
linked AS (SELECT n.tree, n.node, p.node AS parent, n.score, n.piece FROM nodes n LEFT JOIN nodes p ON n.tree = p.tree AND n.parent = p.node),
leaves AS (SELECT * FROM linked l WHERE NOT EXISTS (SELECT 1 FROM linked k WHERE k.tree = l.tree AND k.parent = l.node)),
paths(tree, leaf, parent, score, turns, n_turns) AS (SELECT tree, node, parent, score, piece, 1 FROM leaves
  UNION ALL SELECT p.tree, p.leaf, l.parent, p.score + l.score, l.piece || p.turns, p.n_turns + 1 FROM paths p JOIN linked l ON l.tree = p.tree AND l.node = p.parent),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY score DESC, leaf) AS rank FROM paths WHERE parent IS NULL)
SELECT tree, leaf, score, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256 FROM ranked WHERE rank <= {BEST_BRANCHES}"""

# ---- 8: where benchmark passages stand --------------------------------------------------------------


def benchmark_matches(spark, sf):
    """The longest verbatim matches of benchmark items in documents: places are word numbers from 0."""
    found = decontaminate.find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.item_from", "m.doc_from", "m.n_words")


_LOWER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BENCHMARK_MATCHES = rf"""
WITH doc_words AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_LOWER_WORDS} AS w FROM benchmark),
item_windows AS (SELECT item_id, j, least(len(w), 13) AS n, array_to_string(w[j:j + 12], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM item_words WHERE len(w) > 0)),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, j, d.n, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run
  FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.gram = b.gram)
SELECT doc_id, item_id, min(j) - 1 AS item_from, min(i) - 1 AS doc_from, count(*) + any_value(n) - 1 AS n_words FROM hits GROUP BY doc_id, item_id, i - j, run"""

QUERIES = {"op11_centroids": op11_centroids, "op12_line_rules": op12_line_rules, "op13_prefix_trie": op13_prefix_trie, "chat_branches": chat_branches, "benchmark_matches": benchmark_matches}
SQL = {"op11_centroids": centroids_sql(), "op12_line_rules": LINE_RULES, "op13_prefix_trie": PREFIX_TRIE, "chat_branches": CHAT_BRANCHES, "benchmark_matches": BENCHMARK_MATCHES}
