"""Main text of web pages through a style tree for each site.

The pages of a host are merged into one tree of styles: a node is the path of tags with
their classes and ids from the root. For each node the tree knows how differently the
pages fill it: on what share of the pages that have the node a child sequence (presentation) or a
text directly inside it (content) does not stand, on average. That share does not depend on
the number of pages. A node that every page fills in the same way is site furniture; one that
every page fills differently is content. A branch outside the main element whose importance
(the larger of its own and that of the nodes below) stays under a threshold is removed from
every page of the host. Inside a main element nothing is judged so.

Statistics need several pages, and tell nothing about furniture that varies. So branches
whose tag, role, class or id names them as navigation, header, footer, sidebar, notice,
advert, form or comments are of no importance to begin with, as are scripts and styles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import keep

MIN_PAGES = 8  # a node seen on fewer pages of its host is judged by its names alone
MIN_IMPORTANCE = 0.2
MIN_SHARE = 0.05  # furniture stands on at least this share of the host's pages
MIN_VARIETY = 0.5  # some node of a host must be this important, or all its pages are one page's copies

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_TAGS = frozenset(
    "head script style template noscript nav header footer aside form button select option input textarea label iframe object embed "
    "svg canvas audio video map menu dialog datalist fieldset math".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|byline-social|comments?|commentlist|consent|cookies?|copyright|"
    r"disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promo|promoted|"
    r"recommended|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|"
    r"widgets?)(?:$|[-_\s\d])"
)
HEADINGS = re.compile(r"h[1-6]$")
# opening one of these ends an open one of those, up to a boundary
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary", "figcaption"}


@dataclass
class Node:
    tag: str
    style: str
    important: bool = True
    main: bool = False
    children: list[Node | str] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def element(tag: str, text: str, inside_main: bool) -> Node:
    found = attributes(text)
    names = " ".join(found.get(k, "") for k in ("class", "id")).lower()
    role = found.get("role", "").lower()
    style = tag + "".join("." + n for n in sorted(re.sub(r"\d+", "#", found.get("class", "")).split()))
    furniture = tag in DROPPED_TAGS or role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if tag == "header" and inside_main:
        furniture = False  # an article's own heading
    named = FURNITURE.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join(found.get(k, "") for k in ("class", "id"))).lower() if names else "")
    if named and inside_main and named[0].strip("-_ ") == "header":
        named = None
    if named and tag not in ("html", "body", "article", "main") and not HEADINGS.match(tag):
        furniture = True
    if tag == "article" and named and re.search(r"comment|repl|related|promo|sponsor|\bad", names):
        furniture = True
    return Node(tag, style, not furniture, tag in ("article", "main") or role in ("article", "main"))


def parse(source: str) -> Node:
    """Tree of a page. Unclosed and stray tags are taken as browsers would, roughly; comments vanish."""
    root = Node("", "")
    stack = [root]

    def close(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    at, end = 0, len(source)
    while at < end:
        match = TOKEN.match(source, at)
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            text = match[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(text)
            elif text.startswith("<![CDATA["):
                stack[-1].children.append(html.escape(text[9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if match[1] or match[4]:
            if tag == "br" or tag in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "td", "th", "section") and tag in ("p", "b", "i", "em", "strong", "a", "span"):
                    break
            continue
        rest = match[3] if match[2] else match[6]
        if tag in ENDS_P:
            close({"p"}, {"article", "main", "section", "div", "td", "th", "li", "blockquote", "body", "aside", "form", "button", "object"})
        if tag in ENDS:
            close(*ENDS[tag])
        node = element(tag, rest or "", any(n.main for n in stack))
        stack[-1].children.append(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            at = found.end() if found else end
        elif tag not in VOID and not (rest or "").rstrip().endswith("/"):
            stack.append(node)
    return root


def squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def direct_text(node: Node) -> str:
    """Text of a node with its inline children, without blocks below it."""
    return squeeze("".join(c if isinstance(c, str) else ("" if c.tag in BLOCK or not c.important else direct_text(c)) for c in node.children))


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def describe(root: Node) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(style path, inside a main element, digest of the child sequence, of the text) of each important element that is a block.

    Besides, each path with nulls, so that a set of these says that the page has it.
    """
    stack = [(root, "", False)]
    while stack:
        node, path, main = stack.pop()
        for child in node.children:
            if isinstance(child, Node) and child.important:
                below = f"{path}/{child.style}"
                if child.tag in BLOCK and child.tag not in ("br", "html", "body"):
                    kinds = "|".join(c.style for c in child.children if isinstance(c, Node) and c.tag in BLOCK)
                    yield below, main or child.main, digest(kinds), digest(direct_text(child))
                    yield below, main or child.main, None, None
                stack.append((child, below, main or child.main))


def blocks(root: Node, removed: frozenset[str]) -> str:
    """Texts of the blocks that stay, in page order. With a main element that has text, only what is inside one."""
    parts: list[tuple[bool, str]] = []
    held: list[str] = []

    def flush(main: bool) -> None:
        text = squeeze("".join(held))
        held.clear()
        if text:
            parts.append((main, text))

    # an explicit stack, since pages may nest deeply: (node, path, inside a main element) or a closing block
    todo: list[tuple] = [(root, "", False)]
    while todo:
        item = todo.pop()
        if item[0] is None:
            flush(item[1])
            continue
        node, path, main = item
        if isinstance(node, str):
            held.append(node)
            continue
        below = f"{path}/{node.style}" if node.tag else path
        if not node.important or below in removed:
            continue
        inside = main or node.main
        if node.tag in BLOCK:
            flush(main)
            todo.append((None, inside))
        todo.extend((c, below, inside) for c in reversed(node.children))
    flush(False)
    chosen = [t for m, t in parts if m] or [t for _, t in parts]
    return " ".join(chosen)


def site_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def unimportant(pages: DataFrame) -> DataFrame:
    """(host, removed): the style paths whose branches are site furniture on a host."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = set(describe(parse(source.as_py() or "")))
                rows += [(host, *x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()])],
                ["host", "path", "main", "kinds", "content"],
            )

    seen = pages.select("host", "html").mapInArrow(nodes, "host string, path string, main boolean, kinds long, content long")
    # a page's node in a style counts once; values are counted before they meet, so a hot host arrives as sums
    counted = seen.groupBy("host", "path", "main", "kinds", "content").agg(F.count("*").alias("n"))
    counted = keep(counted, "style_tree")

    # pages that have a path; one with the path inside and outside of main elements counts for both
    having = counted.where("content is null").groupBy("host", "path").agg(F.sum("n").alias("having"), F.max("main").alias("main"))

    def variety(value: str, name: str) -> DataFrame:
        n = counted.where("content is not null").groupBy("host", "path", value).agg(F.sum("n").alias("n")).join(having, ["host", "path"])
        repeated = F.sum(F.col("n") * F.least(F.lit(1.0), F.col("n") / F.col("having"))) / F.sum("n")
        return n.groupBy("host", "path").agg(F.sum("n").alias("total"), F.max("main").alias("main"), (1 - repeated).alias(name))

    presentation, content = variety("kinds", "presentation"), variety("content", "content").drop("main")
    size = pages.groupBy("host").agg(F.count("*").alias("pages"))
    importance = presentation.join(content.drop("total"), ["host", "path"]).join(size, "host")
    importance = importance.withColumn("importance", F.greatest("presentation", "content"))
    enough = (F.col("total") >= MIN_PAGES) & (F.col("total") >= MIN_SHARE * F.col("pages"))
    varied = importance.where(enough).groupBy("host").agg(F.max("importance").alias("top")).where(F.col("top") >= MIN_VARIETY)
    judged = enough & ~F.col("main") & (F.col("importance") < MIN_IMPORTANCE)
    low = importance.where(judged).join(varied, "host", "left_semi")
    # a branch goes only if nothing below it matters
    paths = importance.where(~judged).groupBy("host").agg(F.collect_set("path").alias("kept"))
    low = low.groupBy("host").agg(F.collect_set("path").alias("low")).join(paths, "host", "left")
    empty = F.array().cast("array<string>")
    removed = F.filter("low", lambda p: ~F.exists(F.coalesce("kept", empty), lambda k: F.startswith(k, F.concat(p, F.lit("/")))))
    return low.select("host", removed.alias("removed")).where(F.size("removed") > 0)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html), from the whole page.

    Blocks of the main element are joined in page order by one space, with character
    references decoded and white space squeezed; without a main element, all blocks that are
    no furniture. Null pages and such without text give the empty text; null and odd urls
    count as one host without a name. Repeated rows stay. No rows in, no rows out. Further
    columns are ignored.
    """
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), site_of(F.col("url")).alias("host")
    )
    removed = keep(unimportant(pages), "unimportant")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                blocks(parse(source.as_py()), frozenset(gone or ()))
                for source, gone in zip(batch.column(2), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    judged = pages.join(removed, "host", "left").select("page_id", "url", "html", "removed")
    return judged.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
