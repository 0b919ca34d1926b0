"""Reference lists out of HTML pages: table rows under category rows, and link lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finpanel.operators.keys import dedupe_first
from finpanel.sources.sinks import write_ordered

# Code and name are separated by an ideographic space; positions of the other cells.
NAME_SPACE = "　"
LIST_CELLS = ("isin", "date", "market", "industry")
# Columns of the written lists.
LIST_COLUMNS = {
    "stocks": {"code": "代號", "name": "名稱"},
    "etf": {"code": "代號", "name": "名稱", "isin": "ISIN", "date": "上市日期", "market": "市場別"},
    "issued": {"code": "代號", "name": "名稱", "isin": "ISIN", "date": "發行日期"},
}

ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<td\b[^>]*>(.*?)</td>"
LINK = r'(?i)<li><a href="([^"]*)"[^>]*>([^<]*)</a>'


def plain_text(html: Column) -> Column:
    """Text of a fragment: tags removed, blanks trimmed."""
    return F.trim(F.regexp_replace(html, r"<[^>]*>", ""))


def decode_pages(pages: DataFrame, *, content: str = "content", charset: str = "ms950") -> DataFrame:
    """Column ``html`` from page bytes. Charsets beyond the standard ones need
    ``spark.sql.legacy.javaCharsets=true`` in the session."""
    return pages.withColumn("html", F.decode(F.col(content), charset))


def extract_table_rows(pages: DataFrame) -> DataFrame:
    """Listing rows of ``pages(page_id, html)``.

    A row with a single cell opens a category; the rows after it belong to it. Rows whose first cell has
    no ideographic space are left out. The carry-down runs within one page, which is one HTML document.
    """
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ROW), 1)).alias("pos", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(CELL), 1), plain_text)
    rows = rows.select("page_id", "pos", cells.alias("cells"))
    carried = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(F.size("cells") == 1, F.col("cells")[0])
    rows = rows.withColumn("category", F.coalesce(F.last(title, ignorenulls=True).over(carried), F.lit("")))
    first = F.get("cells", F.lit(0))
    parts = F.split(first, NAME_SPACE, 2)
    data = rows.where((F.size("cells") > 1) & first.contains(NAME_SPACE))
    rest = [F.coalesce(F.get("cells", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(LIST_CELLS)]
    return data.select("page_id", "pos", "category", F.trim(parts[0]).alias("code"), F.trim(parts[1]).alias("name"), *rest)


def extract_list_items(pages: DataFrame) -> DataFrame:
    """Links of HTML lists: (page_id, pos, href, name), ``pos`` from 0 within the page."""
    found = F.regexp_extract_all("html", F.lit(LINK), 0)
    items = pages.select("page_id", F.posexplode(found).alias("pos", "item"))
    return items.select(
        "page_id", "pos", F.regexp_extract("item", LINK, 1).alias("href"), F.trim(F.regexp_extract("item", LINK, 2)).alias("name")
    )


def extract_sectors(pages: DataFrame) -> DataFrame:
    """Sector links ``/index/^NNN/stocks`` by list group: (page_id, group_id, index_id, name)."""
    group = F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<ul[^>]*id="group\d+".*?</ul>'), 0))
    groups = pages.select("page_id", group.alias("html"), F.lit(None).alias("_"))
    groups = groups.withColumn("group_id", F.regexp_extract("html", r'(?i)id="group(\d+)"', 1).cast("int"))
    links = groups.select("page_id", "group_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), 0)).alias("item"))
    return links.select(
        "page_id", "group_id",
        F.regexp_extract("item", r"/index/\^(\w+)/stocks", 1).alias("index_id"),
        F.trim(F.regexp_extract("item", LINK, 2)).alias("name"),
    )


def select_category(listings: Sequence[DataFrame], category: str | None) -> DataFrame:
    """Rows of one category (or all) from several listings; of equal codes the earlier listing wins."""
    ranked = None
    for rank, rows in enumerate(listings):
        part = rows if category is None else rows.where(F.col("category") == category)
        part = part.withColumn("_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    order = ["_rank"] + [c for c in ("page_id", "pos") if c in ranked.columns]
    return dedupe_first(ranked, ["code"], order).drop("_rank")


def list_columns(rows: DataFrame, kind: str) -> DataFrame:
    """The column subset of one of the written lists, under its headers, ordered by code."""
    names = LIST_COLUMNS[kind]
    return rows.orderBy("code").select(*[F.col(c).alias(h) for c, h in names.items()])


# The written lists, by the listings they come from (in order of precedence), their category (None: all) and their columns.
LISTS = {
    "stocks": (("listed", "otc"), "股票", "stocks"),
    "emerging": (("emerging",), None, "stocks"),
    "etf": (("listed", "otc"), "ETF", "etf"),
    "funds": (("funds",), None, "issued"),
    "indices": (("indices",), None, "issued"),
}


def write_lists(listings: Mapping[str, DataFrame], folder: str, *, mode: str = "errorifexists") -> dict[str, str]:
    """Write every list whose listings are given, ordered by code, under ``folder``; list -> path.

    A list of all categories keeps repeated codes, one out of several listings the first of them.
    """
    paths = {}
    for name, (sources, category, kind) in LISTS.items():
        if not all(s in listings for s in sources):
            continue
        found = [listings[s] for s in sources]
        rows = found[0] if category is None else select_category(found, category)
        paths[name] = f"{folder.rstrip('/')}/{name}"
        columns = LIST_COLUMNS[kind]
        write_ordered(rows.select(*[F.col(c).alias(h) for c, h in columns.items()]), paths[name], [columns["code"]], mode=mode)
    return paths
