"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each element has its composite text density
(Sun, Song and Liao 2011): characters per tag, adjusted by how much of its text and
how many of its tags are links. An element's score is the sum of its children's
densities, and the subtree with the highest score is the article. The smallest
density on the path from there to the body is the threshold: an ancestor takes the
article's place while another of its children is at least that dense, so that an
article dealt out over sibling boxes stays whole. Then the outermost ``article``
around it is taken, or else the ``main``, or else the smallest box that holds an h1 as
well: headlines and short sections beside the densest box stay.

What the page itself declares not to be the article counts as no text: menus, footers,
asides, forms, dialogs, headers outside an article, by tag or role, hidden elements, scripts and styles.

Class and id words (sidebar, advert, comments) decide nothing by themselves. A box that
they speak against scores a tenth, so that density chooses against it only if there is hardly
anything else, and they don't count for a box that holds a main heading or an article
(``<div class="has-sidebar">`` around a whole page). Around the article, such boxes
are left out. Inside it, or inside any article or main, such a box goes only if its text agrees: fewer than a
third of the article's characters per tag, links for half of it, or several such boxes within, as a list of
comments has; and there a name counts only if all its words are of that kind
(``social-links``, not ``social-impact``). Headings, paragraphs, tables, and sections
with a heading are never such boxes. Lists of nothing but links that are less dense than the threshold go too.

Blocks come out in page order. White space inside a block becomes one space,
character references are decoded, and blocks are joined by a line feed.

Defined results: a null or empty page has the empty text; unclosed and misnested
tags are repaired as browsers do, in the main; a tag that is cut off by the end of
the page is dropped; repeated rows are alike. Work is linear in the page, however deeply tags nest.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pointloom.llm._util import batches_of, column, in_small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg select".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A start tag closes an open element of these kinds, up to the boundary.
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_OUT_TAGS = frozenset("nav footer aside form dialog menu button fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promotions "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter subscribe subscription signup login popup popups "
    "overlay modal paywall sidebar sidebars aside rail menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot masthead topbar toolbar "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations pagination pager "
    "widget widgets skip copyright disclaimer legal".split()
)
_OUT_HEADER_WORDS = frozenset("header head masthead".split())
#: Words that say nothing of what a box holds.
_PLAIN_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons card container content desktop entry global group head header heading inner item items js left "
    "link links list main mobile outer page panel post posts right row section site slot story text thread title top unit wrap wrapper zone".split()
)
_NEVER_OUT = frozenset("html body main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are boxes: a class or id of others says how they look.
_BOXES = frozenset("a article center details div figure ins section span ul ol dl".split())
#: What a box that its class or id speaks against scores.
_DOUBT = 0.1
#: Inside the article it goes if it has less than this share of the article's characters per tag, this share in links, or so many such boxes within.
_THIN, _LINK_HEAVY, _SEVERAL = 1 / 3, 0.5, 2


class _Node:
    __slots__ = ("tag", "parent", "children", "out", "chars", "links", "tags", "link_tags", "density", "first", "last", "in_link", "named", "doubted", "headed", "core", "suspects", "declared", "within")

    def __init__(self, tag: str, parent: _Node | None, out: bool, named: int, first: int):
        self.tag, self.parent, self.out, self.named, self.first, self.last = tag, parent, out, named, first, first
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.declared = tag in ("article", "main") or (parent is not None and parent.declared)
        self.core = tag in ("h1", "main") or (tag == "article" and not named)
        self.children: list[_Node] = []
        self.chars = self.links = self.tags = self.link_tags = self.suspects = 0
        self.headed, self.doubted, self.within = tag in _HEADINGS, False, False
        self.density = 0.0


def _by_tag(tag: str, parent: _Node) -> bool:
    return tag in _OUT_TAGS or (tag == "header" and not parent.declared)


#: How a class or id speaks against an element: with some of its words, or with all that mean anything.
_SOME, _ALL = 1, 2


def _by_attributes(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is out by its role or because it is hidden, how its class and id speak against it, and whether the id alone does."""
    out, by = False, {"class": 0, "id": 0}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            out = True
        elif name == "role":
            out |= value.strip().lower() in _OUT_ROLES
        elif name == "style":
            out |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name in by:
            for token in value.split():
                words = {w.lower() for w in _CAMEL.findall(token)}
                against = words & _OUT_WORDS or (words & _OUT_HEADER_WORDS and tag in ("div", "section", "table", "td"))
                if against:
                    by[name] = max(by[name], _ALL if words <= _OUT_WORDS | _OUT_HEADER_WORDS | _PLAIN_WORDS or all(w.isdigit() for w in words - _OUT_WORDS) else _SOME)
    return out, max(by.values()), by["id"] > by["class"]


def _parse(page: str) -> tuple[_Node, list[_Node], list[tuple[_Node, str | None]]]:
    """The root, all nodes with parents first, and the text in page order; a None text ends a block."""
    root = _Node("#root", None, False, 0, 0)
    nodes, flow, stack, at = [root], [], [root], 0
    places: dict[str, list[int]] = {}  # where the stack holds a tag
    block_places: list[int] = []

    def text(a: int, b: int) -> None:
        if a < b and not stack[-1].out:
            flow.append((stack[-1], page[a:b]))

    def close(k: int) -> None:
        """Take stack[k:] off the stack."""
        for node in reversed(stack[k:]):
            places[node.tag].pop()
            node.last = len(flow)
            if node.tag in _BLOCK:
                block_places.pop()
                flow.append((node, None))
        del stack[k:]

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def find(tags: set[str], stop: set[str] = frozenset()) -> int:
        """The innermost open element of ``tags``, unless one of ``stop`` is inside it; 0 if there is none."""
        k = last(tags)
        return k if k and k >= last(stop) else 0

    size = len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(at, size)
            break
        m = _TOKEN.match(page, lt)
        if m is None:  # a < that starts no tag is text; one that starts a cut-off tag is dropped with the rest
            after = page[lt + 1 : lt + 2]
            if after.isalpha() or after == "/":
                gt = page.find(">", lt)
                text(at, lt)
                at = size if gt < 0 else gt + 1
                continue
            text(at, lt + 1)
            at = lt + 1
            continue
        text(at, lt)
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not find({"p"}):
                continue
            k = find({tag})
            if k and (tag in _BLOCK or not block_places or k > block_places[-1]):
                close(k)
            elif tag == "br":
                text(lt, lt)
            continue
        if tag in _CLOSES_P and (k := find({"p"}, {"table", "td", "th", "button", "object", "div", "article", "section"})):
            close(k)
        if tag in _CLOSED_BY and (k := find(*_CLOSED_BY[tag])):
            close(k)
        parent = stack[-1]
        if tag in _RAW:  # up to its end tag there are no tags
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or tag != "svg":
                at = end.end() if end else size
            continue
        if tag in _BLOCK:
            flow.append((parent, None))
        elif tag in ("br", "img", "input", "wbr"):
            if tag == "br" and not parent.out:
                flow.append((parent, " "))
        out, named, by_id = (False, 0, False) if not m[3] or tag in _NEVER_OUT else _by_attributes(tag, m[3])
        node = _Node(tag, parent, parent.out or out or _by_tag(tag, parent), named, len(flow))
        node.headed |= by_id and tag == "section"  # an anchor, if there is a heading
        nodes.append(node)
        parent.children.append(node)
        if tag not in _VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in _BLOCK:
                block_places.append(len(stack))
            stack.append(node)
        elif tag in _BLOCK:
            flow.append((parent, None))
    close(1)
    root.last = len(flow)
    return root, nodes, flow


def _measure(nodes: list[_Node], flow: list[tuple[_Node, str | None]]) -> None:
    for node, piece in flow:
        if piece is not None:
            n = len("".join(piece.split()))
            node.chars += n
            if node.in_link:
                node.links += n
    for node in reversed(nodes):  # children before parents
        if node.parent is not None and not node.out:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
            up.headed |= node.headed
            up.core |= node.core
            node.doubted = bool(node.named) and node.tag in _BOXES and not node.core
            up.suspects += node.suspects + node.doubted


def density(chars: int, tags: int, links: int, link_tags: int, link_share: float) -> float:
    """The composite text density of an element; ``link_share`` is the body's."""
    if not chars:
        return 0.0
    base = math.log(chars * max(links, 1) / max(chars - links, 1) + link_share * chars + math.e)
    ratio = chars * max(tags, 1) / (max(links, 1) * max(link_tags, 1))
    return chars / max(tags, 1) * max(math.log(max(ratio, 1.0)) / math.log(base), 0.0)


def _densities(nodes: list[_Node], body: _Node) -> None:
    share = body.links / max(body.chars, 1)
    for x in nodes:
        if not x.out:
            x.density = density(x.chars, x.tags, x.links, x.link_tags, share)


def _densest(nodes: list[_Node], body: _Node) -> _Node:
    """The subtree of the body whose children's densities have the largest sum, boxes in doubt for a tenth."""
    best, most = body, -1.0
    weight: dict[_Node | None, float] = {None: 1.0}
    for x in nodes:  # parents first
        x.within = x is body or (x.parent is not None and x.parent.within)
        # inside an article a mixed name says nothing
        doubt = x.doubted and (not x.declared or x.tag == "article" or (x.named == _ALL and not _structure(x)))
        weight[x] = _DOUBT if doubt else weight[x.parent]
    for x in nodes:
        if x.within and not x.out and x.chars:
            total = sum(c.density * weight[c] for c in x.children if not c.out)
            if total >= most:  # of equals the inner one
                best, most = x, total
    return best


def _structure(x: _Node) -> bool:
    """A section with a heading is a part of a text."""
    return x.tag == "section" and x.headed


def _grown(best: _Node, body: _Node) -> tuple[_Node, float]:
    """``best``, or the ancestor over whose children the article is dealt out, and the threshold."""
    while best is not body and best.tag not in _BLOCK:  # a box, not a run inside a paragraph
        best = best.parent
    path, threshold = best, best.density
    while path is not body:
        path = path.parent
        threshold = min(threshold, path.density)
    top = best
    while top is not body:
        others = any(c is not top and not c.out and not c.doubted and c.tag in _BLOCK and c.chars and c.density >= threshold for c in top.parent.children)
        if not others and top.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "tr", "tbody", "ul", "ol"):
            break
        top = top.parent
    return top, threshold


def _whole(top: _Node, nodes: list[_Node], body: _Node) -> _Node:
    """The outermost article around the densest text, or else the main, or else the smallest box that has an h1 too."""
    around = [top]
    while around[-1] is not body:
        around.append(around[-1].parent)
    for tag, k in (("article", -1), ("main", 0)):
        if found := [x for x in around if x.tag == tag]:
            return found[k]
    titled = set()
    for x in nodes:
        if x.tag == "h1" and not x.out and x.chars:
            while x is not None and x not in titled:
                titled.add(x)
                x = x.parent
    return next((x for x in around if x in titled), top)


def _left_out(nodes: list[_Node], article: _Node, top: _Node, threshold: float) -> list[tuple[int, int]]:
    """The stretches of the flow inside ``article`` that aren't part of it, in order."""
    path, x = set(), top
    while x is not None:
        path.add(x)
        x = x.parent
    typical = top.chars / (top.tags + 1)
    inside, drop = {}, []
    for x in nodes:  # parents first
        inside[x] = x is top or x.declared or inside.get(x.parent, False)
        if x.out or x in path or not article.first <= x.first <= x.last <= article.last:
            continue
        if x.doubted and x.tag == "article":  # of someone else
            gone = True
        elif x.doubted and not inside[x]:
            gone = True
        elif x.doubted and x.named == _ALL:
            thin = x.chars < _THIN * typical * (x.tags + 1) or x.links >= _LINK_HEAVY * x.chars
            gone = (thin and not _structure(x)) or x.suspects >= _SEVERAL
        else:
            gone = x.tag in ("ul", "ol") and bool(x.chars) and x.links == x.chars and x.density < threshold
        if gone:
            drop.append((x.first, x.last))
    return drop


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, nodes, flow = _parse(page)
    _measure(nodes, flow)
    body = next((x for x in nodes if x.tag == "body"), root)
    if not body.chars:
        body = root
    _densities(nodes, body)
    top, threshold = _grown(_densest(nodes, body), body)
    article = _whole(top, nodes, body)
    drop = _left_out(nodes, article, top, threshold)
    blocks, current, k, until = [], [], 0, 0
    for i in range(article.first, article.last):
        while k < len(drop) and drop[k][0] <= i:
            until = max(until, drop[k][1])
            k += 1
        piece = flow[i][1]
        if piece is None or flow[i][0].out:
            if piece is None:
                blocks.append("".join(current))
                current = []
        elif i >= until:
            current.append(piece)
    blocks.append("".join(current))
    clean = (" ".join(html.unescape(b).split()) if "&" in b else " ".join(b.split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, and n_chars in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in column(batch, "html")]
            yield batches_of(
                {
                    "page_id": column(batch, "page_id"),
                    "url": column(batch, "url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
            )

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return in_small_batches(pages).select("page_id", "url", "html").mapInArrow(run, schema)
