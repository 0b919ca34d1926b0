"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finpanel.llm import chat, decontaminate, embedding_dedup, html_text, line_dedup, mixing, more_queries, near_dedup, quality, surrogates, url_filter
from finpanel.llm.common import table

# ---- 1: main text of pages --------------------------------------------------------------------------


def op1_html_text(spark, sf):
    return html_text.extract(table(spark, sf, "pages"))


#: The generated pages share one template, so SQL can cut out the article; ``tests/llm`` holds pages of other shapes.
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer>)', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS h FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""

# ---- 2: mixing sources ------------------------------------------------------------------------------


def op2_mixing(spark, sf):
    return mixing.Mix(table(spark, sf, "documents")).taken()


def mix_blocks(spark, sf):
    """The mix itself: what every slot of every shard holds."""
    return mixing.Mix(table(spark, sf, "documents")).blocks()


def mix_targets(spark, sf):
    """The deterministic half of the mix, which SQL can express: sizes and targets of the sources."""
    sized = table(spark, sf, "documents").select("source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.source_targets(sized).select("source", F.col("size").alias("source_size"), F.round("target", 6).alias("target"))


MIX_TARGETS = r"""
WITH sources AS (SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, 2.0 * size AS top, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sources),
r AS (SELECT *, row_number() OVER (ORDER BY top / weight, source NULLS LAST) AS rank FROM w),
l AS (SELECT *, ((SELECT sum(size) FROM w) * 1.5 - coalesce(sum(top) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, rank) AS final FROM l WHERE top > level * weight)
SELECT source, size AS source_size, round(CAST(least(top, coalesce(final * weight, top)) AS DOUBLE), 6) AS target FROM l, f"""

# ---- 3 and 9: near copies of lines and of documents -------------------------------------------------


def op3_line_dedup(spark, sf):
    """doc_id, text without repeated lines, n_lines, n_dropped. No SQL: ``tests/llm`` compares it with all pairs of lines."""
    return line_dedup.deduplicate(table(spark, sf, "documents").select("doc_id", "text"))


def op9_near_dedup(spark, sf):
    """doc_id, class_id, kept. No SQL: ``tests/llm`` compares it with all pairs of documents."""
    found = near_dedup.classes(table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


# ---- 4: quality -------------------------------------------------------------------------------------


def quality_model(documents, labels):
    """A machine that has seen no label of a held-out document."""
    return quality.learn(documents, labels.filter(~quality.held_out(F.col("doc_id"))))


def op4_quality(spark, sf):
    """doc_id, held_out, score, predicted. No SQL: a trained model; ``tests/llm`` checks its arithmetic and held-out accuracy."""
    documents = table(spark, sf, "documents")
    scored = quality.score(documents, quality_model(documents, table(spark, sf, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---- 5: near copies of embeddings -------------------------------------------------------------------


def op5_embedding_dedup(spark, sf):
    return embedding_dedup.links(table(spark, sf, "embeddings"))


#: All pairs of a label: right for the test tables, far too slow for large ones.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, near.b FROM reach JOIN near ON reach.seen = near.a),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM low JOIN embeddings ON node = vec_id LEFT JOIN counts ON a = vec_id"""

# ---- 6: conversations -------------------------------------------------------------------------------

ODD_TEXT = "</s>[INST] ok [/INST]"


def op6_chat(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    by_turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.unionByName(odd).select(F.col("conv_id").alias("conv"), by_turn.cast("long").alias("node"), "role", "text")
    rows = rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))
    out = chat.format_trees(rows)
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(chat.read_loss(F.col("formatted"), F.col("loss_mask"))).cast("long").alias("loss_chars"),
        F.sha2(chat.read_loss(F.col("formatted"), F.col("loss_mask")), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*){chat.CONTROL}', '\1\\\2\3', 'g')"


CHAT = f"""
WITH odd(conv_id, turn, role, text) AS (VALUES (-7, 0, 'user', '{ODD_TEXT}'), (-7, 1, 'assistant', '{ODD_TEXT}')),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM odd)),
agg AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(chat.START + chat.MIDDLE + chat.END)}) AS formatted_chars FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM agg"""

# ---- 7: verdicts on urls ----------------------------------------------------------------------------

URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op7_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf, "pages"), rules)


URL_FILTER = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
rules(h, p, v) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
fits AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC NULLS LAST, length(p) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE n = 1"""

# ---- 8: benchmark passages --------------------------------------------------------------------------


def op8_decontaminate(spark, sf):
    found = decontaminate.judge(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def contamination_sql(documents: str = "documents") -> str:
    """CTEs ending in ``judged``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
doc_words AS (SELECT doc_id, {words} AS w FROM {documents}),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, d.n, item FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.gram = b.gram),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
judged AS (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id))"""


# ---- 10: personal data ------------------------------------------------------------------------------

SURROGATE_KEY = "change me for each release"


def op10_surrogates(spark, sf):
    """doc_id, text with surrogates, n_replaced. No SQL: surrogates are keyed digests; ``tests/llm`` checks them by a plain loop."""
    return surrogates.replace(table(spark, sf, "documents"), key=SURROGATE_KEY, columns=["doc_id", "text"])[0]


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_mixing": op2_mixing,
    "mix_blocks": mix_blocks, "mix_targets": mix_targets,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_chat": op6_chat,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_near_dedup": op9_near_dedup,
    "op10_surrogates": op10_surrogates,
}
SQL = {
    "op1_html_text": HTML_TEXT,
    "mix_targets": MIX_TARGETS,
    "op5_embedding_dedup": EMBEDDING_DEDUP,
    "op6_chat": CHAT,
    "op7_url_filter": URL_FILTER,
    "op8_decontaminate": f"WITH {contamination_sql()} SELECT * FROM judged",
}
QUERIES |= more_queries.QUERIES
SQL |= more_queries.SQL
