"""HTML extraction by site style trees.

Pages of one host are merged into a tree of elements: an element is named by the tags, classes and
ids on its way from the root. Over all distinct pages of the host, an inner element's importance is
the entropy of how its children are laid out, a text-bearing element's the entropy of its texts,
both scaled to 0..1 by the number of occurrences; without enough occurrences it is 1. A branch is
noise when nothing in it reaches the threshold: a menu with the same entries on every page, a fixed
footer. Marks in the page itself act as the prior: navigation, form, aside and similar elements,
and classes that name adverts, notices or comments are noise on any host, also one with a single
page. Where a page has an article element, text comes from it alone; inside it, repetition alone
removes nothing: a branch of low importance goes only if at least half of its text is links, and
never headings, paragraphs or a branch with a quarter of the text.

Equal pages, and pages whose articles share their least hash of word triples, count once as
evidence: the near copies of one article fall into a few such groups, however many they are.

Work: one pass emits (host, element, layout or text) rows of distinct pages, counted by grouped sums
that combine before the shuffle. Unimportant elements join back to the pages that hold them, and a
second pass extracts; pages are compressed for that shuffle. A hot host is spread over its elements; no host is gathered anywhere.

Defined cases: null or empty html gives an empty text. A null url is a host of its own. Repeated
rows and equal pages get equal texts. Truncated and ill-formed pages are
read as far as they go, unclosed elements end with their parents. An empty table gives no rows.
Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import add_from_text, table
from tallystone.session import materialize

THRESHOLD, MIN_PAGES, SIDE_SHARE, LINK_SHARE = 0.35, 4, 0.25, 0.5

# Element names of the HTML standard by their role, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object head title select option textarea button".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body".split())
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table article section div main nav aside footer header form body html".split())
TEXTUAL = frozenset("article main body html p h1 h2 h3 h4 h5 h6 pre blockquote b i em strong a span br".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices "
    "gdpr popup modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "reply replies disqus respond share sharing social related recommended newsletter subscribe signup login search widget toolbar "
    "pagination pager skip topbar".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LETTERS = re.compile(r"[a-z]+")
MARKED = re.compile(r"<!\[[^>]*>")
ARTICLE, ARTICLE_END, TAG = re.compile(r"<article\b", re.I), re.compile(r"</article\b", re.I), re.compile(r"<[^>]*>")


class Node:
    __slots__ = ("tag", "name", "parent", "children", "noise", "path", "text")

    def __init__(self, tag: str, name: str, parent: Node | None, noise: bool):
        self.tag, self.name, self.parent, self.noise = tag, name, parent, noise
        self.children: list[Node | str] = []
        self.path = xxhash.xxh64_intdigest(name.encode(), parent.path if parent else 0)


class TreeBuilder(HTMLParser):
    """A light tree of elements and texts; unclosed elements end where the standard ends them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", "", None, False)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end_before("p", SCOPES)
        for sibling in SIBLINGS.get(tag, ()):
            self._end_before(sibling, SCOPES)
        marks = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
        words = sorted(set(LETTERS.findall(f"{marks.get('class', '')} {marks.get('id', '')}".lower())))
        noise = tag in FURNITURE or marks.get("role", "").lower() in NOISE_ROLES
        noise = noise or (tag not in ("html", "body") and not NOISE_WORDS.isdisjoint(words))
        node = Node(tag, ".".join([tag, *words]), self.at, noise)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            if node.tag in SCOPES and tag not in SCOPES:
                return  # a stray end tag does not close what lies around it
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _end_before(self, tag: str, scopes: frozenset) -> None:
        node = self.at
        while node is not self.root and node.tag not in scopes:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent


def parse(html: str | None) -> Node:
    builder = TreeBuilder()
    builder.feed(MARKED.sub("", html or ""))
    builder.close()
    return builder.root


def walk(root: Node) -> list[Node]:
    """Elements, parents before children; no recursion, as pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def layout(node: Node) -> str:
    """The children's names in order, runs of one name once."""
    names = [c.name for c in node.children if isinstance(c, Node)]
    return " ".join(n for i, n in enumerate(names) if i == 0 or n != names[i - 1])


def own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_rows(root: Node) -> list[dict]:
    """One row for each element occurrence that has children or text: (path, kind, value)."""
    out = []
    for node in walk(root):
        if node is root or node.tag in RAW:
            continue
        text, inner = own_text(node), layout(node)
        if inner:
            out.append({"path": _signed(node.path), "kind": 0, "value": _signed(xxhash.xxh64_intdigest(inner.encode()))})
        if text:
            out.append({"path": _signed(node.path), "kind": 1, "value": _signed(xxhash.xxh64_intdigest(text.encode()))})
    return out


def evidence_key(html: str) -> int:
    """Equal for pages that count once: equal pages, and most near copies of an article."""
    start = ARTICLE.search(html)
    words: list[str] = []
    if start is not None:
        end = ARTICLE_END.search(html, start.end())
        words = TAG.sub(" ", html[start.start() : end.start() if end else len(html)]).split()
    if len(words) < 3:
        return _signed(xxhash.xxh64_intdigest(html.encode()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    mixed = (h[:-2] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:-1]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + h[2:]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return _signed(int((mixed ^ (mixed >> np.uint64(31))).min()))


def extract(html: str | None, low: set[int]) -> str:
    """The main text, given the unimportant elements of the page's host."""
    root = parse(html)
    nodes = walk(root)
    size = {id(n): sum(len(c.strip()) for c in n.children if isinstance(c, str)) for n in nodes}
    linked = dict.fromkeys(size, 0)  # text in links
    weak = {id(n): n is not root and _signed(n.path) in low for n in nodes}
    for n in reversed(nodes):  # children before parents
        if n.parent is not None:
            if not n.noise:
                size[id(n.parent)] += size[id(n)]
                linked[id(n.parent)] += size[id(n)] if n.tag == "a" else linked[id(n)]
            if not weak[id(n)] and (size[id(n)] or n.children):
                weak[id(n.parent)] = False
    mains = _outermost(root, lambda n: n.tag == "article") or _outermost(root, lambda n: n.tag == "main" or "#main" in n.name)
    total = sum(size[id(m)] for m in mains)
    pieces: list[str] = []
    todo: list[tuple[Node, bool] | str] = [(m, bool(mains)) for m in reversed(mains or [root])]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        node, inside = item
        if weak[id(node)] and size[id(node)]:
            side = size[id(node)] < SIDE_SHARE * total and linked[id(node)] >= LINK_SHARE * size[id(node)]
            if not inside or (node.tag not in TEXTUAL and side):
                continue
        edge = "\x00" if node.tag in BLOCKS else " " if node.tag == "br" else ""
        todo.append(edge)
        todo.extend(c if isinstance(c, str) else (c, inside) for c in reversed(node.children) if isinstance(c, str) or not c.noise)
        todo.append(edge)
    blocks = (" ".join(b.split()) for b in "".join(pieces).split("\x00"))
    return " ".join(b for b in blocks if b)


def _outermost(root: Node, test) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        if test(node):
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def host_of(url: F.Column) -> F.Column:
    """The host in lower case; empty where a url has none, "null" where there is no url."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("null"))


def unimportant(rows: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """Elements (host, path) none of whose kinds of evidence reaches the threshold."""
    each = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    # Entropy over m occurrences is ln m - sum(n ln n) / m; it is scaled by ln m.
    by_kind = each.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s")
    )
    enough = F.col("m") >= min_pages
    importance = F.when(enough, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    scored = by_kind.withColumn("importance", importance)
    return scored.groupBy("host", "path").agg(F.max("importance").alias("importance")).where(F.col("importance") < threshold)


def extract_pages(
    pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Rows (page_id, url, text), one a page."""
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("host", host_of(F.col("url")))
    made = add_from_text(
        page.select("host", "html"), "html", "style", "key bigint, rows array<struct<path:bigint,kind:int,value:bigint>>",
        lambda: lambda htmls: [{"key": evidence_key(h), "rows": style_rows(parse(h))} for h in htmls],
    )
    rows = made.select("host", "style.key", F.explode("style.rows").alias("r")).select("host", "key", "r.*")
    # Pages of one key are one; how often an element stands on a page does not matter, what it holds does.
    rows = materialize(rows.distinct(), "style")
    low = unimportant(rows, threshold, min_pages)
    held = rows.select("host", "path", "key").distinct().join(low.select("host", "path"), ["host", "path"])
    per_page = held.groupBy("host", "key").agg(F.collect_set("path").alias("low"))
    squeezed = add_from_text(
        page, "html", "packed", "key bigint, blob binary",
        lambda: lambda htmls: [{"key": evidence_key(h), "blob": zstandard.compress(h.encode(), 3)} for h in htmls],
    ).select("page_id", "url", "host", "packed.*")
    joined = squeezed.join(per_page, ["host", "key"], "left").select("page_id", "url", "blob", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            texts = [extract(zstandard.decompress(b).decode(), set(low or ())) for b, low in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    kind = page.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_pages(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
