"""Main text of web pages: a tree of the page is scored and the best container is kept with its siblings.

Every block of text gives points for its length and its commas to its ancestors, less the further up they are; an element's
score is discounted by the share of its text that stands in links. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts and reader comments are cut out of the tree before, by element, role and class names. Class names alone don't cut what holds
most of the page's text, and if little of the page is left, it is scored again without them.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finpanel.llm.common import by_value

by_value(__name__)

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "search", "option", "legend",
}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
CUT = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "menu", "dialog", "iframe", "object", "embed", "applet",
    "button", "select", "option", "optgroup", "input", "textarea", "fieldset", "canvas", "audio", "video", "svg", "title", "search", "datalist", "xmp", "noembed", "noframes",
}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Parts of class names and ids that mark what is no article.
CUT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "adbox", "banner", "breadcrumb", "breadcrumbs", "byline-share", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "footer", "footnav", "gdpr", "header", "login",
    "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination",
    "paywall", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "rss", "search", "searchbox", "share", "sharing", "shoutbox",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "teaser", "toolbar", "topbar", "tracking", "widget", "widgets",
}
#: Of these, what often has more text than the article beside it.
OUTGROWS = {"comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "gdpr", "replies", "reply", "respond", "shoutbox"}
#: Parts that may stand beside those of CUT_NAMES in a name that marks what is no article; beside others, as in ``social-policy``, they mark nothing.
PLACES = {
    "area", "bar", "block", "blocks", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "entry", "form", "fixed", "global", "group", "head", "holder",
    "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "lower", "main", "meta", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "region",
    "right", "row", "secondary", "section", "site", "stories", "sticky", "thread", "title", "tools", "top", "upper", "us", "wrap", "wrapper", "article", "articles", "story", "text", "blog", "user",
}
FILED_UNDER = re.compile(r"(?:category|cat|tag)[-_]", re.I)  # class names that say what an article is about
GOOD_NAMES = {"article", "articles", "body", "content", "entry", "hentry", "main", "post", "story", "text", "blog", "page"}
CONTAINERS = {"div", "section", "article", "main", "body", "td"}  # their own text counts for themselves, else for the parent
COMMAS = ",、，،"
SHARES = (1, 2, 6, 9, 12, 15)  # an ancestor gets a block's points divided by this, the last for all further up
LEAD = 40  # characters outside links that make a text of its own
NOTICE = re.compile(r"(?:©|\(c\)\s*\d{4}|copyright\s+(?:©|\(c\)|\d{4})|all rights reserved)", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "parent", "kids", "names", "cut", "named", "score", "chars", "linked", "commas", "passed")

    def __init__(self, tag, parent, names=frozenset(), cut=False, named=False):
        self.tag, self.parent, self.kids, self.names, self.cut = tag, parent, [], names, cut
        self.named = named  # its class or id says that it is no article
        self.score, self.chars, self.linked, self.commas = 0.0, 0, 0, 0
        self.passed = [0.0] * len(SHARES)  # points by how many blocks below they come from


def _names(rest: str) -> tuple[frozenset, bool, bool]:
    """Parts of class and id, without those that only say what the element has (``with-sidebar``) or is about (``tag-cookies``, ``social-policy``);
    whether attributes hide it; whether a name of its own, not one like ``post-comments``, says that it is an article.
    """
    parts, hidden, good = set(), False, False
    for name, value in ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in ("class", "id"):
            for word in unescape(value.strip("\"'")).split():
                if FILED_UNDER.match(word):
                    continue
                words = [w.lower() for w in NAME_PART.findall(word)]
                words = {w for i, w in enumerate(words) if not (i and words[i - 1] in ("has", "with", "no", "without", "is"))}
                good |= bool(words & GOOD_NAMES) and not words & CUT_NAMES
                parts |= words if {w for w in words if not w.isdigit()} <= CUT_NAMES | PLACES else words - CUT_NAMES
        elif name == "role":
            hidden |= value.strip("\"'").lower() in CUT_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.strip("\"'").lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return frozenset(parts), hidden, good


def _is_named(tag: str, names: frozenset) -> bool:
    if tag == "article":
        return bool(names & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "teaser", "related"})
    if tag in HEADINGS or tag == "p":
        return bool(names & (CUT_NAMES - {"header"}))
    return bool(names & CUT_NAMES)


def parse(html: str) -> Node:
    """The page as a tree of its body; elements without an end tag are closed as browsers do."""
    root = Node("body", None)
    at, here = 0, root
    position, size = 0, len(html)
    while position < size:
        found = TOKEN.search(html, position)
        start = found.start() if found else size
        if start > at:
            here.kids.append(html[at:start])
        if not found:
            break
        position = at = found.end()
        tag = found["tag"] or found["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        rest = found["rest"] if found["tag"] else found["rest2"]
        if found["end"] or found["end2"]:
            if tag == "br":
                here.kids.append("\n")
            else:
                here = _close(here, tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            here = _implied(here, ("p",), ())
        if tag == "li":
            here = _implied(here, ("li",), ("ul", "ol", "menu", "dir"))
        elif tag in ("dt", "dd"):
            here = _implied(here, ("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            here = _implied(here, ("td", "th"), ("table", "tr"))
        elif tag == "tr":
            here = _implied(here, ("tr",), ("table",))
        elif tag in ("tbody", "thead", "tfoot"):
            here = _implied(here, ("tbody", "thead", "tfoot"), ("table",))
        elif tag == "option":
            here = _implied(here, ("option",), ("select",))
        elif tag in HEADINGS and here.tag in HEADINGS:
            here = here.parent
        if tag == "br":
            here.kids.append("\n")
            continue
        names, hidden, good = _names(rest) if rest else (frozenset(), False, False)
        may = tag not in ("html", "body", "main")
        node = Node(tag, here, names, may and (tag in CUT or hidden), may and not good and _is_named(tag, names))
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, position)
            position = at = end.end() if end else size
        elif tag == "plaintext":
            position = at = size
        elif tag not in VOID and not (rest.endswith("/") and tag in ("path", "circle", "rect", "use", "line")):
            here = node
    return root


SCOPES = {"table", "td", "th", "caption", "button", "object", "html", "body"}


def _implied(here: Node, tags, stops) -> Node:
    """Close an open element of ``tags`` that a new element ends, not beyond ``stops`` or a cell or section."""
    node = here
    while node.parent is not None:
        if node.tag in tags:
            return node.parent
        if node.tag in stops or (node.tag in SCOPES and not stops) or (not stops and node.tag in BLOCK):
            return here
        node = node.parent
    return here


def _close(here: Node, tag: str) -> Node:
    """Close the nearest open ``tag``; an end tag of text markup closes no block around it, and one without a start does nothing."""
    node = here
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if tag not in BLOCK and node.tag in BLOCK or node.tag in ("td", "th") and tag not in BLOCK | {"table"}:
            return here
        node = node.parent
    return here


def _opens_article(header: Node) -> bool:
    """Whether an article's own header belongs to its text: it has a heading, or a lead of its own."""
    stack, free = [header], 0
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                free += len(k.strip())
            elif k.tag in HEADINGS:
                return True
            elif k.tag != "a" and not k.cut:
                stack.append(k)
    return free >= LEAD


def _cut_nested(order: list[Node], free: dict[Node, int]) -> None:
    """Cut articles inside an article with a longer text of its own: its comments."""
    inside: dict[Node, list[Node]] = {}
    for node in order:
        up = node.parent
        while node.tag == "article" and up is not None and up.tag != "article":
            up = up.parent
        if node.tag == "article" and up is not None:
            inside.setdefault(up, []).append(node)
    for outer, nested in inside.items():
        own = free[outer] - sum(free[n] for n in nested)
        if own >= max(LEAD, *(free[n] for n in nested)):
            for n in nested:
                n.cut = True


def _introduced(node: Node, inside: bool) -> bool:
    """Whether a list of links is part of a text: a paragraph that ends in a colon stands before it, in an article any paragraph or heading."""
    before = None
    for k in node.parent.kids:
        if k is node:
            break
        if not isinstance(k, str) and not k.cut or isinstance(k, str) and k.strip():
            before = k
    if before is None or isinstance(before, str):
        return bool(before) and before.rstrip().endswith(":")
    last = next((k for k in reversed(before.kids) if isinstance(k, str) and k.strip()), "")
    return before.tag == "p" and last.rstrip().endswith(":") or inside and (before.tag == "p" or before.tag in HEADINGS)


def _cut_named(root: Node, level: int) -> int:
    """Cut elements by their class names: all but those with most of the page's unlinked text, which must also hold its title or main
    part if they are of a kind that outgrows articles (level 0); only of that kind (level 1); none (level 2).

    Returns the characters of the page's unlinked text, with that of elements cut here.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.cut:
            order.append(node)
            stack.extend(k for k in node.kids if not isinstance(k, str))
    free, leads = {}, set()
    for node in reversed(order):
        kids = [k for k in node.kids if not isinstance(k, str) and not k.cut]
        free[node] = 0 if node.tag == "a" else sum(len(k.strip()) for k in node.kids if isinstance(k, str)) + sum(free[k] for k in kids)
        if node.tag in ("h1", "main") or any(k in leads for k in kids):
            leads.add(node)
    _cut_nested(order, free)
    unnamed = any(n.tag == "article" and not n.named and not n.cut and free[n] >= LEAD for n in order)
    for node in order:
        if node.named and node.tag == "article" and unnamed:
            node.cut = True  # a teaser or advert beside the article, however long
        elif node.named:
            outgrows = bool(node.names & OUTGROWS)
            if level == 0:
                node.cut = 2 * free[node] <= free[root] or outgrows and node not in leads
            else:
                node.cut = level == 1 and outgrows
    return free[root]


def _measure(root: Node) -> list[Node]:
    """Cut what is no article, count text and linked text bottom-up, and pass the points of blocks to their ancestors.

    Returns the elements that are left, each before those inside it.
    """
    order, stack, within = [], [(root, False)], set()
    while stack:
        node, inside = stack.pop()
        if node.tag == "header" and not node.cut:
            node.cut = not (inside and _opens_article(node))
        if node.cut:
            continue
        order.append(node)
        inside |= node.tag in ("article", "main")
        if inside:
            within.add(node)
        stack.extend((k, inside) for k in node.kids if not isinstance(k, str))
    for node in reversed(order):
        links = own = 0
        for k in node.kids:
            if isinstance(k, str):
                text = k.strip()
                own += len(text)
                node.commas += sum(map(text.count, COMMAS))
            elif not k.cut:
                node.linked += k.chars if k.tag == "a" else k.linked
                links += 1
                if k.tag in BLOCK:
                    node.chars += k.chars
                else:
                    own += k.chars
                    node.commas += k.commas
        node.chars += own
        if node.tag in ("ul", "ol", "dl") and node.chars and node.linked >= 0.9 * node.chars and links >= 3 and not _introduced(node, node in within):
            node.cut = True  # a menu: a list of nothing but links
            continue
        if node.tag in BLOCK:
            if own:
                points = 1 + node.commas + min(own // 100, 3)
                if node.tag in CONTAINERS:
                    node.passed[0] += points
                elif node.parent is not None:
                    node.parent.passed[0] += points
            node.score = sum(p / s for p, s in zip(node.passed, SHARES))
        if node.parent is not None:
            up = node.parent.passed
            for i, p in enumerate(node.passed):
                up[min(i + (node.tag in BLOCK), len(SHARES) - 1)] += p
    for node in order:
        node.cut |= node.parent is not None and node.parent.cut
    return [n for n in order if not n.cut]


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.chars) if node.chars else 0.0


def _value(node: Node) -> float:
    bonus = 25 if node.tag == "article" else 10 if node.tag == "main" else 5 if node.names & GOOD_NAMES else 0
    return (node.score + bonus) * (1 - _density(node)) if node.chars else 0.0


def _shape(node: Node) -> tuple:
    return node.tag, frozenset(w for w in node.names if not w.isdigit())


def _raised(best: Node) -> Node:
    """``best``, or the highest element around it beside which stand further parts of the article.

    A part is an element whose own text has a good share of the best value, or one that lies as ``best`` does: by the same
    tags and class names from the common ancestor down. Siblings on the way that don't belong to the element, and containers of
    nothing but links in those beside the highest, are cut.
    """
    least, top, node, path = 0.2 * _value(best), best, best, [_shape(best)]
    while node.parent is not None:
        parts, stack = False, [(k, 0) for k in node.parent.kids if k is not node and not isinstance(k, str)]
        while stack and not parts:
            k, depth = stack.pop()
            if k.cut or not k.chars or k.tag not in BLOCK:
                continue
            alike = depth < len(path) and _shape(k) == path[-1 - depth]
            if alike and depth == len(path) - 1 and _density(k) < 0.25:
                parts = True
            elif k.tag in CONTAINERS and k.passed[0] and _density(k) < 0.25 and _value(k) >= least:
                parts = True
            stack.extend((x, depth + 1 if alike else len(path)) for x in k.kids if not isinstance(x, str))
        if parts:
            top = node
        path.append(_shape(node.parent))
        node = node.parent
    node = best
    while node is not top:
        for k in node.parent.kids:
            if not isinstance(k, str) and k is not node and not _belongs(k, least):
                k.cut = True
        node = node.parent
    stack = [k for k in top.parent.kids if k is not top and not isinstance(k, str)] if top is not best else []
    while stack:
        k = stack.pop()
        k.cut |= k.tag in CONTAINERS and _density(k) >= 0.5
        stack.extend(x for x in k.kids if not isinstance(x, str) and not k.cut)
    return top


def _belongs(k: Node, least: float) -> bool:
    """Whether a sibling of a part of the article is one, too."""
    if k.cut or not k.chars:
        return False
    if k.tag in HEADINGS:
        return True
    return _density(k) < 0.5 and (k.tag not in BLOCK or k.tag in ("p", "ul", "ol", "dl", "blockquote", "pre", "table", "figure") or k.score and _value(k) >= least or _density(k) < 0.25)


def _chosen(root: Node, order: list[Node]) -> list:
    """The best container, or the article around it, raised to where its parts stand, with the siblings that belong to it, in page order."""
    may = [n for n in order if n.tag in BLOCK and n.tag not in HEADINGS | {"p", "li", "tr", "pre"} and n.score]
    if not may:
        return [root]
    best = max(may, key=_value)  # of equal ones the outermost
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best, least, out, seen = up or best, 0.2 * _value(up or best), [], False
    if up is None:
        best = _raised(best)
    if best.parent is None:
        return [best]
    inside = best.tag in ("article", "main")
    for k in best.parent.kids:
        if k is best:
            out.append(k)
            seen = True
        elif isinstance(k, str):
            if k.strip() and not inside:
                out.append(k)
        elif k.cut or not k.chars:
            continue
        elif inside:
            if k.tag in HEADINGS and not seen or k.tag == best.tag and _value(k) >= 0.5 * _value(best):
                out.append(k)
        elif _belongs(k, least):
            out.append(k)
    return out


def _blocks(nodes: list) -> list[str]:
    """Texts of the blocks of the chosen elements, decoded, each with single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [(n, False) for n in reversed(nodes)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            run.append(unescape(node) if "&" in node else node)
        elif done:
            flush()
        elif not node.cut:
            if node.tag in BLOCK:
                flush()
                stack.append((node, True))
            stack.extend((k, False) for k in reversed(node.kids))
    flush()
    return out


def main_text(html: str | None) -> str:
    """Text of the article of one page."""
    if not html:
        return ""
    html, best = html.replace("\x00", ""), ""
    for level in range(3):
        root = parse(html)
        free = _cut_named(root, level)
        chosen = _chosen(root, _measure(root))
        blocks = _blocks(chosen)
        if not any(n.tag in ("article", "main") for n in chosen if not isinstance(n, str)):
            while len(blocks) > 1 and len(blocks[-1]) < 200 and NOTICE.match(blocks[-1]):
                blocks.pop()  # no element says where the article ends: the page's own notice stands below it
        text = " ".join(blocks)
        if len(text) > len(best):
            best = text
        if len(best) >= 0.1 * free or level == 1 and best:  # comments and notices only if there is nothing else
            break
    return best


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every row: key, url, text (empty if none), n_chars (code points).

    A map over rows, without shuffle: a long page or a frequent host is one row like any other. Null or empty html gives an
    empty text; a page without markup is its text; unclosed elements are closed as browsers do; repeated rows each give a row, an
    empty table none. Only the named columns are read, so further columns cannot clash.
    """

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    rows = rows.select("key", "url", text_of("html").alias("text"))
    return rows.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
