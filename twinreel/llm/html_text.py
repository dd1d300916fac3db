"""Main text of web pages by composite text density.

The page is parsed into a DOM with a forgiving parser.  Elements that are never
article text (scripts, menus, headers, footers, forms, adverts, comments ...) are
taken out by tag, role and class.  For each remaining node the composite text
density is the characters per tag, scaled by how few of them are link text; each
node's density sum adds its children's densities.  The subtree with the largest sum
is the article; the smallest density on the path from it to the body is the
threshold, and other subtrees hanging off that path are kept if they reach it.

Defined results: a null or empty page, or one without text outside boilerplate, has
an empty text.  Broken markup never fails.  Pages are handled whole, one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from twinreel.llm.common import bounded_batches

# HTML elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("script style noscript template head title svg math canvas object iframe form nav header footer aside menu dialog select option button textarea input datalist fieldset audio video map".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
KEEP = set("html body main article".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
BAD = set("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted nav navbar navigation menu menus submenu sidebar aside rail footer foot header masthead topbar breadcrumb breadcrumbs cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies disqus respond discussion share sharing social related recommended recommendations widget widgets pagination pager toolbar copyright disclaimer skip alert outbrain taboola form".split())
COMMENTS = set("comment comments commentlist reply replies disqus respond".split())
CLOSES = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "tbody": {"tbody", "tfoot"}, "thead": {"tbody", "tfoot"}}
#: Open elements that an implied end tag never passes.
SCOPE = set("ul ol dl table body html article section div main td th blockquote form nav aside header footer".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("bad", "chars", "density", "kids", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, bad: bool):
        self.tag, self.parent, self.bad, self.kids = tag, parent, bad, []


def _bad(tag: str, attrs: str) -> bool:
    if tag in NEVER:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    words: set[str] = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(a or b or c)
        if name in ("class", "id"):
            words.update(x.lower() for x in CAMEL.findall(value))
        elif name == "role" and value.lower() in ROLES and tag not in KEEP:
            return True
        elif name == "hidden" and tag not in KEEP or name == "style" and tag not in KEEP and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(words & (COMMENTS if tag in KEEP else BAD)) and tag not in ("html", "body")


def parse(page: str) -> Node:
    """The DOM: text children are strings with character references decoded."""
    root = Node("html", None, False)
    at, pos, n = root, 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        start = m.start() if m else n
        if start > pos:
            at.kids.append(html.unescape(page[pos:start]))
        if not m:
            break
        pos = m.end()
        if m[0].startswith("<![CDATA["):
            at.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            up = at
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                at = up.parent
            elif tag == "p" or tag == "br":
                at.kids.append(Node(tag, at, False))
            continue
        if tag == "html":
            continue
        for open_, closers in CLOSES.items():
            if tag in closers:
                up = at
                while up.parent is not None and up.tag != open_ and up.tag not in SCOPE:
                    up = up.parent
                if up.tag == open_ and up.parent is not None:
                    at = up.parent
        node = Node(tag, at, _bad(tag, attrs))
        at.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID:
            at = node
    return root


def _measure(root: Node) -> list[Node]:
    """Characters, tags, link characters and link tags of each kept node; the nodes, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.bad)
    order.reverse()
    for node in order:
        chars = tags = link_chars = link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                chars += len(k) - sum(map(str.isspace, k)) if len(k) < 64 else len(SPACE.sub("", k))
            elif not k.bad:
                chars, tags, link_chars, link_tags = chars + k.chars, tags + k.tags + 1, link_chars + k.link_chars, link_tags + k.link_tags
        if node.tag == "a":
            link_chars, link_tags = chars, link_tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    return order


def _score(order: list[Node], body: Node) -> None:
    c_body, lc_body = max(body.chars, 1), body.link_chars
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c == 0:
            node.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + lc_body / c_body * c + math.e)
            node.density = c / t * (math.log(max(c / max(lc, 1) * t / lt, 1.0)) + 1e-9) / max(math.log(base), 1.0) if base > 1 else 0.0
        node.sum = sum(k.density for k in node.kids if isinstance(k, Node) and not k.bad)


def _blocks(node: Node) -> Iterator[str]:
    """Blocks of the subtree, in page order, white space collapsed."""
    parts: list[str] = []
    stack: list[tuple[Node | str | None, bool]] = [(node, False)]
    while stack:
        item, closing = stack.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        edge = item.tag in BLOCK
        if edge and parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            parts = []
            if text:
                yield text
        if closing:
            continue
        if item.tag == "br":
            parts.append(" ")
        if edge:
            stack.append((item, True))
        stack.extend((k, False) for k in reversed(item.kids) if isinstance(k, str) or not k.bad)
    text = SPACE.sub(" ", "".join(parts)).strip()
    if text:
        yield text


def extract(page: str | None) -> str:
    """The main text: its blocks joined by newlines."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    if not body.chars:
        body = root
    _score(order, body)
    inside = [x for x in order if x.tag in BLOCK and x.chars]
    if not inside:
        return "\n".join(_blocks(body))
    best = max(inside, key=lambda x: (x.sum, x.density))
    # a paragraph or an inline wrapper is not an article: go up to what holds it, and to the semantic article
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    top = 0
    for i, x in enumerate(path):
        if x.tag in ("article", "main"):
            top = i
            if x.tag == "article":
                break
    while top + 1 < len(path) and path[top].tag in ("p", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "tbody", "table", "blockquote", "pre", "dl", "dt", "dd"):
        top += 1
    threshold = min(x.density for x in path)
    chosen = path[top]
    keep = {id(chosen)}
    if chosen.tag not in ("article", "main"):
        # siblings on the way to the body that are as dense as the sparsest node of the path
        for below, x in zip(path[top:], path[top + 1 :]):
            keep.update(id(k) for k in x.kids if isinstance(k, Node) and not k.bad and k is not below and k.chars and k.density >= threshold and 2 * k.link_chars <= k.chars)
    if len(keep) == 1:
        return "\n".join(_blocks(chosen))
    out, stack = [], [path[-1]]
    while stack:
        x = stack.pop()
        if id(x) in keep:
            out.extend(_blocks(x))
        else:
            stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and not k.bad)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every page; other columns are ignored."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([extract(x) for x in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text], ["page_id", "url", "text"])

    narrow = pages.select("page_id", "url", "html")
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")
