"""HTML extraction by composite text density.

Of every node, C is its text's characters, T its tags, LC its characters inside links and LT its link tags. Its density is C / T,
adjusted by links: C / T times the logarithm of (C / LC * T / LT), to a base that grows with the share of link text in the node and in
the body. A node's density sum is its children's total. The node of the largest sum is the main part; the smallest density on the
path from the body to it is the threshold that other parts must reach to be kept with it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilojoule.llm._shared import key, own_id, pieces, small_batches

# Fixed values of HTML: elements without an end, with raw content, and that stand in a line of text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of the key closes an open one of the values in the same container.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPES = frozenset("table ul ol dl select body html article section div main".split())
#: Parts that are never of the article.
_DROP = frozenset("head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas dialog menu menuitem audio video map noembed noframes".split())
#: Words in a class or id that speak against the article; a whole name of them says more than a part of one, as in `no-sidebar`.
_WORDS = r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|share|sharing|social|related|recommend\w*|sidebar|rail|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|site-header|page-header|comments?|comment-\w+|disqus|respond|replies|login|search|skip-link|pagination|pager|copyright|disclaimer|toolbar)"
_NOT_ARTICLE = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])")
_WHOLE_NAME = re.compile(rf"(?:^|\s){_WORDS}(?:[_-]{_WORDS})*(?:$|\s)")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_WHOLE = frozenset("html body main article".split())
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "doubt", "role", "chars", "tags", "link_chars", "link_tags", "density", "sum", "kept")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.dropped = self.kept = False
        self.doubt = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _boilerplate(tag: str, attrs: str, within_article: bool) -> bool:
    if tag in _DROP or tag == "header" and not within_article:
        return True
    if tag in _WHOLE or not attrs.strip():
        return False
    for name, *values in _ATTR.findall(attrs):
        value, name = next((v for v in values[:3] if v), "").lower(), (name or values[3]).lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _doubt(tag: str, attrs: str) -> int:
    """2 if a class or id says by a whole name that this isn't the article, 1 if by a part of a name, else 0."""
    if tag in _WHOLE or not attrs.strip():
        return 0
    values = [next((v for v in x[1:4] if v), "").lower() for x in _ATTR.findall(attrs) if x[0].lower() in ("class", "id")]
    return max((2 if _WHOLE_NAME.search(v) else 1 if _NOT_ARTICLE.search(v) else 0 for v in values), default=0)


def parse(page: str) -> Node:
    """The tree of a page; tags left open are closed where HTML says so, ends without a start are passed over."""
    root = Node("html", None)
    stack, at = [root], 0
    in_article = 0

    def leave(n: int) -> None:
        nonlocal in_article
        in_article -= sum(x.tag in ("article", "main") for x in stack[n:])
        del stack[n:]

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    leave(k)
                    break
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag not in _INLINE:  # a block ends the paragraph that is open
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    leave(k)
                    break
                if stack[k].tag in _SCOPES or stack[k].tag in ("li", "td", "th", "blockquote"):
                    break
        if tag in _CLOSES:
            low = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in _SCOPES), 0)
            k = next((k for k in range(low + 1, len(stack)) if stack[k].tag in _CLOSES[tag]), None)
            if k:
                leave(k)
        node = Node(tag, stack[-1])
        node.dropped = _boilerplate(tag, m[3], in_article > 0)
        node.doubt = 0 if node.dropped else _doubt(tag, m[3])
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.dropped = True
            at = end.end() if end else len(page)
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            in_article += tag in ("article", "main")


def _nodes(root: Node) -> list[Node]:
    """Every node that counts, a parent before its children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.dropped]
    return out


def weigh(root: Node) -> list[Node]:
    """Fills in counts, densities and density sums; returns the nodes."""
    nodes = _nodes(root)
    for n in reversed(nodes):
        own = sum(len(c) - c.count(" ") for c in n.children if isinstance(c, str))
        kids = [c for c in n.children if isinstance(c, Node) and not c.dropped]
        n.chars = own + sum(c.chars for c in kids)
        n.tags = len(kids) + sum(c.tags for c in kids)
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(c.link_chars for c in kids)
        n.link_tags = sum(c.link_tags + (c.tag == "a") for c in kids)
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        base = math.log(c / max(c - n.link_chars, 1) * n.link_chars + share * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1.0) if c else 0.0
    for n in nodes:
        n.sum = sum(c.density for c in n.children if isinstance(c, Node) and not c.dropped)
    return nodes


def settle(root: Node) -> None:
    """Drops the nodes in doubt, but none around the node of the largest density sum.

    That node is looked for in article and main elements if there are any outside of nodes in doubt. What is in doubt by a part of a
    name only goes if its density is below the threshold or half of its text is links.
    """
    nodes = _nodes(root)
    if not any(n.doubt for n in nodes):
        return
    weigh(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    doubtful, marked, scope = {id(root): False}, {id(root): False}, []
    for n in nodes[1:]:
        doubtful[id(n)] = doubtful[id(n.parent)] or n.doubt > 0
        marked[id(n)] = marked[id(n.parent)] or n.tag in ("article", "main") and n.chars > 0 and not doubtful[id(n)]
        if marked[id(n)]:
            scope.append(n)
    best = max(scope or _nodes(body), key=lambda n: n.sum)
    if not best.sum:  # no tags below: the fullest one
        best = max(scope or _nodes(body)[1:] or [body], key=lambda n: n.density)
    around, threshold, n = set(), math.inf, best
    while n is not None:
        around.add(id(n))
        threshold = min(threshold, n.density)
        if n is body:
            break
        n = n.parent
    for n in nodes:
        if n.doubt and id(n) not in around:
            n.dropped = n.doubt == 2 or n.density < threshold or n.link_chars * 2 >= n.chars


def main_parts(root: Node) -> None:
    """Marks the nodes whose texts are the article."""
    settle(root)
    nodes = weigh(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    below = _nodes(body)
    best = max(below, key=lambda n: n.sum)
    if not best.sum:  # no tags below: the text itself
        best = body
    # the article or main element around it is the author's own mark of the whole
    n = best
    while n is not None and n is not body:
        if n.tag in ("article", "main"):
            best = n
        n = n.parent
    best.kept = True
    threshold, n = math.inf, best
    while n is not None:
        threshold = min(threshold, n.density)
        if n is body:
            break
        n = n.parent
    if best.tag in ("article", "main"):
        return
    for n in below[1:]:
        if n.density >= threshold > 0 and n.tag not in _INLINE and n.link_chars * 2 < n.chars:
            n.kept = True


def blocks(root: Node) -> list[str]:
    """The kept text, block by block in page order, white space as one space."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [(root, root.kept)]
    while todo:
        x = todo.pop()
        if x is None:
            end()
            continue
        n, kept = x
        if isinstance(n, str):
            if kept:
                line.append(n)
            continue
        kept = kept or n.kept
        if n.tag in ("br", "wbr"):
            line.append(" " if n.tag == "br" else "")
            continue
        block = n.tag not in _INLINE
        if block:
            end()
            todo.append(None)
        todo += [(c, kept) for c in reversed(n.children) if isinstance(c, str) or not c.dropped]
    end()
    return out


def extract(page: str | None) -> str:
    root = parse(page or "")
    main_parts(root)
    return "\n\n".join(blocks(root))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "html", 8 << 20):
        texts = [extract(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks joined by an empty line.

    Null, empty and textless pages give the empty text. Row by row: null and repeated ids and repeated rows stay as they are, and
    other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(key(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "key long, url string, text string, n_chars long").select(own_id().alias("page_id"), "url", "text", "n_chars")
