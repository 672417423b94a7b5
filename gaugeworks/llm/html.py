"""Main-text extraction by scoring the element tree of a page.

A tolerant parser builds the tree of block elements. Every paragraph gives points for its length
and commas to its ancestors, fully to the nearest container, less to the next ``LEVELS``; a container's points
are discounted by its share of link text, and the best one (of equal ones the first) is kept with those
siblings that score well or are plain paragraphs.

Elements that hold no article text are left out before scoring: by tag (menus, forms, scripts, ...), by role,
or by a class or id of which a whole token says so ("sidebar", "cookie-notice"). A token that only
contains such a word ("related-work") makes an element doubtful: it is left out if it consists of links
for more than ``DOUBTFUL_LINKS`` of its characters, else it counts like any other.

A null or empty page, or one without text outside of what is left out, gives the empty string. Whole
pages are parsed in one pass; as in browsers, elements deeper than ``DEPTH`` levels are not nested further, so the
work is linear in the length of a page. Repeated pages give equal rows; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/><]*)([^<>]*+)>|[!?][^>]*+>)""")
#: One attribute after another, so that quoted values are never searched for names.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?|["'=/]""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
CONTAINERS = {"body", "article", "main", "section", "div", "td", "center", "blockquote", "details", "figure", "html"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "th", "pre", "figcaption", "caption", "summary", "address"}
DROPPED = {"head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "button", "select", "dialog", "menu", "object", "canvas", "audio", "video", "map", "fieldset"}
BLOCKS = CONTAINERS | LEAVES | DROPPED | {"header", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "hr", "hgroup", "search"}
VOID = {"br", "hr", "img", "input", "meta", "link", "base", "col", "embed", "source", "track", "wbr", "area", "param"}
#: What an opening tag closes, and the tags the search for it does not leave.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"})}
#: Words in class names and ids of elements that hold no article text.
UNLIKELY = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disqus", "feedback", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended",
    "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "widget",
}
#: Words that beside one of those only tell its place or shape.
NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "form", "global", "group", "header", "inner", "item",
    "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "policy", "primary", "right", "row", "secondary", "section", "site", "slot",
    "sticky", "text", "thread", "top", "unit", "user", "reader", "wrap", "wrapper", "zone",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
LIKELY = {"article", "body", "content", "entry", "main", "post", "story", "text"}
TAG_POINTS = {"article": 25, "main": 15, "div": 5, "section": 5, "td": 3, "blockquote": 3}
#: A sibling is kept from this share of the best score on, and at least this score.
SIBLING_SHARE, SIBLING_LEAST, SIBLING_LINKS = 0.2, 10.0, 0.25
#: Share of link text from which a doubtful element is left out; containers that a text gives points to; greatest depth.
DOUBTFUL_LINKS, LEVELS, DEPTH = 0.25, 5, 512


class _Node:
    __slots__ = ("tag", "up", "box", "depth", "kids", "out", "doubtful", "inside", "likely", "points", "chars", "links")

    def __init__(self, tag: str, up: _Node | None, out: bool = False, doubtful: bool = False, likely: bool = False):
        self.tag, self.up, self.out, self.doubtful, self.likely = tag, up, out, doubtful, likely
        self.box = None if up is None else up if up.tag in CONTAINERS else up.box  # nearest container above
        self.depth = 0 if up is None else up.depth + 1
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.kids: list = []  # nodes and (text, linked characters)
        self.points = 0.0
        self.chars = self.links = 0


def _judged(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes rule it out, make it doubtful, or speak for it."""
    out = doubtful = likely = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            out = True
        elif key == "aria-hidden":
            out |= value.lower() == "true"
        elif key == "role":
            out |= value.lower() in ROLES
        elif key in ("class", "id"):
            for token in value.split():
                parts = {p.lower() for p in _NAME_PART.findall(token)}
                words = {p for p in parts if not p.isdigit()}
                if words & UNLIKELY:
                    if words <= UNLIKELY | NEUTRAL:
                        out = True
                    else:
                        doubtful = True
                likely |= bool(words & LIKELY)
    return out, doubtful, likely


def _parse(page: str) -> _Node:
    root = node = _Node("html", None)
    text: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole and not node.out:
                node.kids.append((whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    while True:
        m = _TAG.search(page, at)
        # a "<" that opens no tag stays in the text
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            linked += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            n = node
            while n is not None and n.tag != tag:
                n = n.up
            if n is not None and n.up is not None:
                node = n.up
                in_link = 0
            continue
        if tag == "html":
            continue
        if node.tag == "p" and tag not in VOID | {"hr"}:
            node = node.up
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            n = node
            while n.up is not None and n.tag not in walls:
                if n.tag in ends:
                    node = n.up
                    if tag != "tr" or n.tag == "tr":
                        break
                n = n.up
        if tag in VOID:
            continue
        named_out, doubtful, likely = _judged(attributes) if attributes else (False, False, False)
        out = node.out or tag in DROPPED or tag == "header" and not node.inside
        if tag not in ("html", "body", "main"):
            out |= named_out and not (tag == "article" and likely)
        if node.depth >= DEPTH:
            node = node.up
        child = _Node(tag, node, out, doubtful and not likely and tag != "body", likely)
        node.kids.append(child)
        node = child
    flush()
    return root


def _score(root: _Node) -> list[tuple[float, _Node]]:
    """Points, characters and links of every element, from the leaves up; (score, element) of the containers in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in reversed(n.kids) if k.__class__ is _Node and not k.out]
    for n in reversed(order):  # children before their parents
        for k in n.kids:
            if k.__class__ is tuple:
                n.chars += len(k[0])
                n.links += k[1]
        if n.doubtful and n.links > DOUBTFUL_LINKS * n.chars:
            n.out = True
        elif n.up is not None:
            n.up.chars += n.chars
            n.up.links += n.links
    for n in order:
        if n.up is not None and n.up.out:
            n.out = True
        if n.out:
            continue
        for k in n.kids:
            if k.__class__ is tuple:
                points = (1 + k[0].count(",") + min(len(k[0]) / 100, 3)) * (1 - k[1] / len(k[0]))
                up = n if n.tag in CONTAINERS else n.box
                for level in range(LEVELS):
                    if up is None:
                        break
                    up.points += points * (1.0, 0.5)[level] if level < 2 else points / (3 * level)
                    up = up.box
    found = []
    for n in order:
        if n.tag in CONTAINERS and n.chars and n.tag != "html" and not n.out:
            bonus = TAG_POINTS.get(n.tag, 0) + 15 * n.likely
            found.append(((n.points + bonus) * (1 - n.links / n.chars), n))
    return found


def _texts(node: _Node, into: list[str]) -> None:
    stack: list = [node]
    while stack:
        n = stack.pop()
        if n.__class__ is tuple:
            into.append(n[0])
        elif not n.out:
            stack += reversed(n.kids)


def main_text(page: str | None) -> str:
    """The article text of ``page``: blocks in page order, joined by two line feeds."""
    if not page:
        return ""
    root = _parse(page)
    found = _score(root)
    blocks: list[str] = []
    if not found:
        _texts(root, blocks)
        return "\n\n".join(blocks)
    scores = {id(n): s for s, n in found}
    top, best = max(found, key=lambda x: x[0])
    whole = best.tag in ("article", "main", "body")
    for k in best.up.kids if best.up is not None else [best]:
        if k.__class__ is tuple:
            if not whole and k[1] <= SIBLING_LINKS * len(k[0]):
                blocks.append(k[0])
        elif k is best or not k.out and (
            scores.get(id(k), 0) >= max(SIBLING_LEAST, SIBLING_SHARE * top)
            or not whole and k.tag in LEAVES and k.links <= SIBLING_LINKS * k.chars
        ):
            _texts(k, blocks)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url``, text and n_chars of every page; no shuffle."""
    src = pages.select(F.col(id).alias("i"), F.col(url).alias("u"), F.col(html).cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["i", "u", "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in src.schema]
    out = src.mapInArrow(run, f"i {kinds[0]}, u {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"i": id, "u": url})
