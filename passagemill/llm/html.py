"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements; text between two block boundaries is a block. Every block passes points for
its length and commas to its element, half of them to the parent and less to LEVELS further ancestors; an element's
points are discounted by its link density. The best element is the container; where it lies in an article or main element, that one
is. Beside an article or main element, siblings with a fair share of the best points, headings and paragraphs are kept as
well; on a page without, all that is left beside the container and beside each element around it, however short, unless it
is mostly links. Subtrees that are page furniture by element, role or class (menus, headers, footers, sidebars, notices, adverts, forms, comments) are
cut before scoring; a class alone doesn't cut what holds most of the points of a page without article, unless it names
comments, adverts or the like.

Malformed markup is read the way browsers do in outline: an open paragraph ends where a block begins, end tags without a
start are ignored, and what follows an unclosed comment or script is part of it. Character references are decoded; white
space inside a block, line breaks included, becomes one space; blocks are trimmed and joined in page order by a line feed.

Nulls: a null html is an empty page. A page without text gives an empty string. Repeated rows and null ids stay. Pages of
any length and depth are read whole, in time in proportion to their length; of elements with equal scores an article,
then the first, is best. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul noscript template select object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in "script style textarea title iframe noframes xmp noembed svg canvas audio video button".split()}
CUT = set("nav footer aside form head menu dialog noscript template select object search optgroup option fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that name page furniture, and those of them that always cut.
FURNITURE = set("nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side footer header masthead topbar banner ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification popup modal overlay lightbox share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager widget widgets toolbar copyright comment comments commentlist disqus replies respond reply discussion feedback skip teaser outbrain taboola trending popular tags".split())
ALWAYS = set("comment comments commentlist disqus replies respond ad ads advert adverts advertisement adsbygoogle sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs pagination".split())
NOT = set("with has no without is".split())
#: A start tag of the key ends an open element of the values, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: End tags don't reach past these for an element that isn't one of them.
WALLS = set("article main section body html table td th aside nav footer header".split())


LISTS = set("ul ol menu dir".split())
#: Ancestors beyond the parent that get points of a block.
LEVELS = 12


class Node:
    """A block element and what is asked of its ancestors: depth; inside, the nearest article or main above it; wall, the
    depth of the nearest of WALLS; para, the open paragraph; list, the list it is part of; first, by key of ENDS the outermost
    element that the key would end."""

    __slots__ = ("name", "parent", "cut", "soft", "points", "chars", "links", "kids", "depth", "inside", "wall", "para", "list", "first")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.cut, self.soft, self.points, self.chars, self.links, self.kids = name, parent, False, False, 0.0, 0, 0, []
        if not parent:
            self.depth, self.inside, self.wall, self.para, self.list, self.first = 0, None, 0, None, None, {}
            return
        parent.kids.append(self)
        self.depth = parent.depth + 1
        self.inside = parent if parent.name in ("article", "main") else parent.inside
        self.wall = self.depth if name in WALLS else parent.wall
        self.para = self if name == "p" else None if name in WALLS else parent.para
        self.list = self if name in LISTS else None if name in ("article", "main", "body") else parent.list
        self.first = parent.first
        if name in _ENDING:
            self.first = {k: None if name in walls else parent.first.get(k) or (self if name in ended else None) for k, (ended, walls) in ENDS.items()}


_ENDING = {x for ended, walls in ENDS.values() for x in ended | walls}


def _mark(node: Node, attrs: str) -> None:
    """Sets cut (page furniture) or soft (so by class alone)."""
    name = node.name
    node.cut = name in CUT
    inside = node.inside
    if name == "header" and not inside:
        node.cut = True
    if node.cut or not attrs:
        return
    got = {a.lower(): (b or c or d) for a, b, c, d in _ATTR.findall(attrs)}
    if got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        node.cut = name not in ("html", "body")
        return
    if name in ("html", "body", "main") or name == "article" and not (inside and inside.name == "article"):
        return
    for value in f"{got.get('class', '')} {got.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(value)}
        bad = words & FURNITURE
        if inside and bad == {"header"}:
            continue
        if bad and not words & NOT:
            if name in HEADINGS or name == "p" and not bad & {"ad", "ads", "advert", "advertisement", "cookie", "notice", "copyright", "share", "sponsored", "promo"}:
                continue
            if words & ALWAYS:
                node.cut = True
                return
            node.soft = True


def parsed(html: str) -> tuple[list[Node], list[tuple[Node, str, int, int]]]:
    """The elements, and blocks (element, text, characters, characters in links), in page order."""
    root = Node("#root", None)
    at, stack, blocks, nodes = root, [root], [], [root]
    opened: dict[str, list[int]] = {}  # depths of open elements by name
    text: list[str] = []
    linked = link_chars = 0
    pos = 0

    def flush() -> None:
        nonlocal link_chars
        if text:
            value = " ".join(unescape("".join(text)).split())
            text.clear()
            if value:
                blocks.append((at, value, len(value), min(link_chars, len(value))))
        link_chars = 0

    def close(to: int) -> None:
        nonlocal at
        flush()
        while len(stack) > to:
            opened[stack.pop().name].pop()
        at = stack[-1]

    while True:
        m = _TAG.search(html, pos)
        piece = html[pos : m.start() if m else len(html)]
        if piece:
            text.append(piece)
            if linked:
                link_chars += len(piece)
        if not m:
            break
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                linked = max(0, linked - 1)
            elif name in BLOCKS:
                own = opened.get(name)
                if own and (name in WALLS or own[-1] >= at.wall):
                    close(own[-1])
                else:
                    flush()
            elif name == "br":
                text.append(" ")
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/") or name != "svg":
                end = RAW[name].search(html, pos)
                if not end:
                    break
                pos = html.find(">", end.end())
                if pos < 0:
                    break
                pos += 1
            continue
        if name in BLOCKS:
            flush()
            linked = 0 if name not in ("div", "p", "section", *HEADINGS) else linked
            if name in ENDS:
                if first := at.first.get(name):
                    close(first.depth)
            if at.para:
                close(at.para.depth)
            if name in HEADINGS and stack[-1].name in HEADINGS:
                close(len(stack) - 1)
            if name in ("html", "body") and opened.get(name):
                continue
            if name == "body" and stack[-1].name == "head":
                close(len(stack) - 1)
            if name == "hr":
                continue
            at = Node(name, at)
            _mark(at, m[3])
            stack.append(at)
            nodes.append(at)
            opened.setdefault(name, []).append(at.depth)
        elif name == "br":
            text.append(" ")
        elif name == "a":
            linked = linked + 1 if re.search(r"\bhref\b", m[3], re.I) else linked
    flush()
    return nodes, blocks


def extracted(html: str | None) -> str:
    if not html:
        return ""
    nodes, blocks = parsed(html)
    root = nodes[0]

    def below(start, step) -> dict[Node, bool]:
        """Of each element, start for the root and else step(what its parent has, the element)."""
        out = {root: start}
        for x in nodes[1:]:
            out[x] = step(out[x.parent], x)
        return out

    gone = below(False, lambda up, x: up or x.cut)
    live = [b for b in blocks if not gone[b[0]]]
    total, worth = 0.0, []
    for node, value, chars, links in live:
        commas = sum(map(value.count, ",،、，"))
        points = (min(chars / 100, 3) + commas + (1 if chars >= 25 else 0)) * (1 - links / chars)
        worth.append(points)
        total += points
    # what only a class calls furniture goes unless it holds most of the page's points
    held: dict[Node, float] = {}
    for (node, *_), points in zip(live, worth):
        held[node] = held.get(node, 0) + points
    for x in reversed(nodes[1:]):
        if x in held:
            held[x.parent] = held.get(x.parent, 0) + held[x]
    soft = below(False, lambda up, x: up or x.soft)
    article = any((node.inside or node.name in ("article", "main")) and not soft[node] for node, *_ in live)
    held = {x: points for x, points in held.items() if x.soft}
    bad = {node for node, points in held.items() if article or points <= 0.5 * total}
    if bad:
        for node in bad:
            node.cut = True
        gone = below(False, lambda up, x: up or x.cut)
        keep = [not gone[b[0]] for b in live]
        live, worth = [b for b, k in zip(live, keep) if k], [w for w, k in zip(worth, keep) if k]
    if not live:
        return ""
    for (node, _, chars, links), points in zip(live, worth):
        own = node if node.name not in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt", "figcaption", *HEADINGS) or node.parent is None else node.parent
        level = 0
        node.chars += chars
        node.links += links
        while own is not None and own.name != "#root" and level < 2 + LEVELS:
            own.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            own, level = own.parent, level + 1
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.links += x.links
    seen: dict[Node, float] = {}
    for node, *_ in live:
        while node is not None and node not in seen:
            bonus = 1.25 if node.name in ("article", "main") else 1
            seen[node] = node.points * (1 - node.links / max(1, node.chars)) * bonus
            node = node.parent
    best = max(seen, key=lambda x: (seen[x], x.name == "article"))
    if seen[best] <= 0:
        best = next((x for x in seen if x.name in ("article", "main")), root)
    up = best if best.name in ("article", "main") else best.inside
    kept = {up or best}
    around: set[Node] = set()
    top = up or best
    if up is None:
        while top.parent is not None:
            beside = [x for x in top.parent.kids if x is not top and x.chars]
            while beside:
                x = beside.pop()
                if x.links < 0.3 * x.chars:
                    kept.add(x)
                else:
                    beside += [y for y in x.kids if y.chars and y.name not in HEADINGS]
            top = top.parent
            around.add(top)
    elif top.parent is not None and top.name not in ("body", "html", "#root"):
        limit = max(2.0, 0.2 * seen.get(top, 0))
        for x in top.parent.kids:
            if x is not top and x in seen and x.chars and x.links / x.chars < 0.3:
                same = x.name == top.name and x.name in ("article", "section", "div", "main", "td", "tr")
                if seen[x] >= limit and same or x.name in ("p", "blockquote", "pre") and x.chars >= 80 or x.name in HEADINGS:
                    kept.add(x)
    inside: dict[Node, bool] = {}
    out = []
    for node, value, chars, links in live:
        at, chain = node, []
        while at is not None and at not in inside and at not in kept:
            chain.append(at)
            at = at.parent
        ok = at is not None and (at in kept or inside[at])
        for x in chain:
            inside[x] = ok
        ok = ok or node in around and links < 0.3 * chars
        lists = node.list
        menu = lists is not None and len(lists.kids) > 2 and lists.links >= 0.9 * lists.chars
        if ok and not menu:
            out.append(value)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extracted(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, a row per row of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
