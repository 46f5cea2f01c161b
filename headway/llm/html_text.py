"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Elements that never hold the article (menus, headers, footers, sidebars, forms,
scripts, adverts, notices, comments; by tag, role, class or id) are pruned. Each paragraph then passes points for its
length and commas to its container, which passes half of what it got to its own parent, and so on up to the root; an
element's points are discounted by its link density. The best container and those siblings that score near it, or read
like paragraphs, are the main text.

Inside an ``article`` or ``main`` element only what the names of adverts, menus, notices, forms and comments mark is
pruned: its lists of links, tags and notes are text. Inside a block white space becomes one space; blocks are joined in
page order by a line feed. Character references are decoded; mathematics is text.

Null, empty and broken pages give what text their tree has, or an empty string; a tag that never ends ends at its first
``>``, or else takes the rest of the page. Repeated pages give equal rows. Pages are read whole, without recursion, in
time that grows with their length: a page is scanned once, and open elements are found by name.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import beside

#: Groups of tags (fixed values of the HTML standard, as far as they matter here).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of the article.
PRUNED = frozenset("head nav footer aside form button select option input label dialog menu search object embed canvas audio video map annotation annotation-xml".split())
#: What an open element of the key is closed by.
CLOSED_BY = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
#: An end tag doesn't reach beyond these, nor an implied end.
SCOPE = frozenset("html body table article section div ul ol dl main td th blockquote form aside nav header footer".split())
#: The open elements that a start tag closes, by tag.
CLOSES = {tag: [k for k, by in CLOSED_BY.items() if tag in by] for tag in sorted(set().union(*CLOSED_BY.values()))}
#: Words of class, id and role that mark what surrounds an article, and those that mark an article.
OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion|ted)?|sidebar|side|rail|aside|nav|navbar|navigation|navlist|menu|topbar"
    r"|breadcrumbs?|pagination|pager|footer|foot|masthead|header|site-head|comments?|commentlist|replies|reply|disqus|discussion|respond|reactions|cookies?|consent|gdpr|notice|notification"
    r"|alert|popup|modal|overlay|lightbox|newsletter|subscribe|subscription|signup|sign-up|login|register|paywall|related|recommend(?:ed|ations)?|more-stories|trending|popular"
    r"|share|sharing|social|tools|toolbar|widgets?|skip-link|contentinfo|complementary|search|tags?|tagcloud|meta|byline-links|disclaimer|copyright|legal|outbrain|taboola)(?=$|[\s_-]|\d)",
    re.I,
)
INSIDE = re.compile(r"(?:^|[\s_-])(?:article|content|main|body|entry|post|story|text)(?=$|[\s_-]|\d)", re.I)
#: Names that mark surroundings beside an article, but not inside an article element.
BESIDE = re.compile(r"(?:side|tags?|tagcloud|meta|byline-links|disclaimer|copyright|legal|discussion|popular|tools|reactions|contentinfo)(?=$|[\s_-]|\d)", re.I)
#: A start tag as it usually is (no step is ever taken back), and the parts of any other.
START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:\s++[^\s=/>\"']++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>=<]++))?+)*+)\s*+(/?)>")
TAG, GAP, NAME, EQUALS, VALUE = (re.compile(x) for x in (r"</?([a-zA-Z][^\s/>]*+)", r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
COMMENT_END = re.compile(r"--!?>")
HUGE = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: First parts of a class that says something about an element instead of naming it (has-sidebar, tag-politics).
ABOUT = frozenset("has with without no is not tag tags category type format side".split())
#: Words that mark surroundings even on a page that has no other text.
SURE = re.compile(r"(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|cookies?|consent|gdpr)(?=$|[_-]|\d)", re.I)
#: Characters of a paragraph that earn one point, and the most it earns by length.
POINT_CHARS, MOST_POINTS = 100, 3
CONTAINERS = frozenset("div section article main body html".split())
#: Share of the best score that a sibling needs, and link density from which a list is a menu.
SIBLING_SHARE, MENU_DENSITY = 0.2, 0.6
#: Text of a paragraph of prose, at least.
PROSE_CHARS = 25


class Node:
    __slots__ = ("tag", "parent", "children", "pruned", "marked", "inside", "chars", "linked", "links", "score", "commas", "menu")

    def __init__(self, tag, parent, pruned=False, marked=False, inside=False):
        self.tag, self.parent, self.pruned, self.marked, self.inside = tag, parent, pruned, marked, inside
        self.children = []  # nodes and strings
        self.chars = self.linked = self.links = self.commas = 0
        self.score = 0.0
        self.menu = False


def _decoded(text: str) -> str:
    """``text`` without character references; numbers beyond any code point stand for none."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = HUGE.sub("\ufffd", re.sub(r"&#([xX]?)0++(?=[0-9a-fA-F])", r"&#\1", text))
    return html.unescape(text)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _decoded(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _names(attributes: dict[str, str]) -> list[str]:
    return [x for k in ("class", "id", "role", "itemprop") for x in attributes.get(k, "").split()]


def _marks_outside(name: str) -> bool:
    """Whether a class, id or role names surroundings: as a whole, or with its first or last part."""
    parts = re.split(r"[_-]+", name.strip("_-"))
    if len(parts) > 1 and parts[0].lower() in ABOUT or len(parts) > 1 and parts[-1].lower() == "header" and INSIDE.match(name):
        return False
    return bool(OUTSIDE.match(name) or OUTSIDE.fullmatch(parts[-1]))


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


def _is_outside(tag: str, attributes: dict[str, str], by_name: bool, inside: bool) -> bool:
    if tag in ("html", "body", "article", "main"):
        return False
    if _is_hidden(attributes):
        return True
    names = _names(attributes)
    if not by_name:
        return any(SURE.match(x) for x in names)
    outside = [x for x in names if _marks_outside(x) and not (inside and BESIDE.match(x))]
    return bool(outside) and not any(INSIDE.search(x) and x not in outside and x.split("-")[0].lower() not in ABOUT for x in names)


@lru_cache(maxsize=4096)
def _kind(tag: str, text: str, by_name: bool, inside: bool) -> tuple[bool, bool]:
    """Whether attributes mark an element as surroundings, and whether they mark it as an article."""
    attributes = _attributes(text)
    marked = INSIDE.search(" ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop")))
    return _is_outside(tag, attributes, by_name, inside), bool(marked)


def _tag_end(page: str, at: int) -> int:
    """The place after the ``>`` that ends a start tag whose name ends at ``at``; -1 where none does."""
    n = len(page)
    while True:
        at = GAP.match(page, at).end()
        if at >= n:
            return -1
        if page[at] == ">":
            return at + 1
        at = NAME.match(page, at).end()
        value = EQUALS.match(page, at)
        if value:
            at = value.end()
            quote = page[at : at + 1]
            if quote == '"' or quote == "'":
                at = page.find(quote, at + 1) + 1
                if not at:
                    return -1
            elif quote != ">":
                at = VALUE.match(page, at).end()


def tokens(page: str):
    """Yield (first, last, kind, tag, attributes) of all markup in order; kind is ``open``, ``empty``, ``close`` or ``none``
    (comments and the like). One pass: once a tag's quotes leave it without an end, quotes no longer count."""
    at, n, quotes = 0, len(page), True
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            return
        after = page[at + 1]
        if page.startswith("<!--", at):
            end = COMMENT_END.search(page, at + 2)
            last, kind, tag, attributes = end.end() if end else n, "none", "", ""
        elif after in "!?" or after == "/" and not page[at + 2 : at + 3].isalpha():
            last, kind, tag, attributes = page.find(">", at) + 1 or n, "none", "", ""
        elif after == "/" or after.isascii() and after.isalpha():
            usual = START.match(page, at) if quotes and after != "/" else None
            if usual:
                last, kind, tag, attributes = usual.end(), "empty" if usual[3] else "open", usual[1].lower(), usual[2]
            else:
                name = TAG.match(page, at)
                if not name:
                    at += 1
                    continue
                last = _tag_end(page, name.end()) if quotes and after != "/" else 0
                if last < 1:
                    quotes = quotes and not last
                    last = page.find(">", name.end()) + 1
                if not last:
                    yield at, n, "none", "", ""
                    return
                attributes = page[name.end() : last - 1]
                tag, kind = name[1].lower(), "close" if after == "/" else "empty" if attributes.endswith("/") else "open"
        else:
            at += 1
            continue
        if kind == "open" and tag in RAW:  # up to its end tag
            yield at, last, "none", "", ""
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, last)
            at, last, kind = last, page.find(">", end.end()) + 1 or n if end else n, "none"
            if tag == "xmp":  # shown as it is
                yield at, end.start() if end else n, "text", "", ""
                at = end.start() if end else n
        yield at, last, kind, tag, attributes
        at = last


class _Open:
    """The open elements: a path from the root, and the depths of those of each tag and of those that bound end tags."""

    def __init__(self, root: Node):
        self.path, self.where, self.scopes, self.hard = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.path.append(node)
        self.where.setdefault(node.tag, []).append(depth)
        if node.tag in SCOPE:
            self.scopes.append(depth)
            if node.tag not in ("td", "th"):
                self.hard.append(depth)

    def cut(self, depth: int) -> None:
        """Close all from ``depth`` on."""
        while len(self.path) > depth:
            self.where[self.path.pop().tag].pop()
        for kind in (self.scopes, self.hard):
            while kind[-1] >= depth:
                kind.pop()

    def last(self, tag: str) -> int:
        depths = self.where.get(tag)
        return depths[-1] if depths else 0


def tree(page: str, by_name: bool = True) -> Node:
    """The elements of a page; text of raw elements is left out. Without ``by_name``, only sure names prune."""
    root = Node("html", None)
    held, at = _Open(root), 0
    for first, last, kind, tag, attributes in tokens(page):
        node = held.path[-1]
        if first > at:
            node.children.append(_decoded(page[at:first]))
        at = last
        if kind == "text":
            node.children.append(page[first:last])
        elif kind == "close":
            depth = held.last(tag)
            if depth and (tag in SCOPE or depth > held.scopes[-1]):
                held.cut(depth)
        elif kind != "none" and not (tag in ("html", "body") and node is root):
            while depth := max(map(held.last, CLOSES.get(tag, ())), default=0):
                if depth <= held.hard[-1]:
                    break
                held.cut(depth)
            node = held.path[-1]
            inside = bool(held.last("article") or held.last("main"))
            outside, marked = (_kind if len(attributes) < 400 else _kind.__wrapped__)(tag, attributes, by_name, inside) if attributes else (False, False)
            # an article's own header has its title
            pruned = outside or tag in PRUNED or tag == "header" and not inside
            new = Node(tag, node, pruned, marked or tag in ("article", "main"), inside)
            node.children.append(new)
            if tag not in VOID and kind == "open":
                held.push(new)
    if at < len(page):
        held.path[-1].children.append(_decoded(page[at:]))
    return root


def _measured(root: Node) -> list[Node]:
    """Nodes that aren't pruned, parents before children, with text lengths and link densities."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.pruned)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                node.chars += len(words)
                node.commas += words.count(",") + words.count("،") + words.count("、") + words.count("，")
            elif not c.pruned:
                node.chars += c.chars
                node.linked += c.linked
                node.links += c.links
                node.commas += c.commas
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.tag in ("ul", "ol", "div", "section", "table", "dl", "p") and node.links >= 2 and node.linked > MENU_DENSITY * max(1, node.chars) and not (node.marked or node.inside):
            node.pruned = node.menu = True
            node.chars = node.linked = node.links = node.commas = 0
    return [n for n in order if not n.pruned]


def _restored(nodes: list[Node]) -> list[Node]:
    """Lists and paragraphs of links among the paragraphs of the article belong to it: those that stand beside a paragraph of
    prose and after one (straight in the page's body: between two) come back."""
    stack = list(nodes)
    while stack:
        node = stack.pop()
        inner = [c for c in node.children if isinstance(c, Node)]
        prose = [i for i, c in enumerate(inner) if not c.pruned and c.chars >= PROSE_CHARS and c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "dl") and _density(c) <= MENU_DENSITY]
        if prose:
            end = prose[-1] if node.tag in ("html", "body") else len(inner)
            for c in inner[prose[0] : end]:
                if c.menu:
                    c.pruned = False
        stack.extend(c for c in inner if not c.pruned)
    return nodes


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _is_paragraph(node: Node) -> bool:
    if node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption"):
        return True
    return node.tag in BLOCK and node.tag not in HEADING and any(isinstance(c, str) and c.strip() for c in node.children)


def main_nodes(root: Node) -> list[Node]:
    """The best container and its kept siblings, in page order."""
    nodes = _measured(root)
    for node in reversed(nodes):  # children before parents
        if node.chars and _is_paragraph(node):
            own = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in node.children if isinstance(c, str) or (not c.pruned and c.tag not in BLOCK))
            if own:
                points = (0.1 if own < 25 else 1) + min(own / POINT_CHARS, MOST_POINTS) + (node.commas if own * 2 > node.chars else 0)
                (node if node.tag in CONTAINERS or node.parent is None else node.parent).score += points
        if node.parent is not None:
            node.parent.score += node.score / 2
    for node in nodes:
        node.score *= 1 - _density(node)
        if node.marked:
            node.score *= 1.5
    if not root.chars:
        return []
    best = max(nodes, key=lambda n: n.score)  # the first of equal ones
    if not best.score:
        return [root]
    # an article or main element around the best container is the container
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main") and _density(up) < 0.5 and (up.tag == "article" or best.tag != "article"):
            best = up
        up = up.parent
    # while the best container stands among others of its score, the main text is in their parent
    while best.parent is not None and best.tag not in ("article", "main", "body"):
        beside = [s for s in best.parent.children if isinstance(s, Node) and not s.pruned and s is not best]
        if not any(s.score >= SIBLING_SHARE * best.score and s.tag in ("div", "section", "td", "blockquote", "article") for s in beside):
            break
        best = best.parent
    if best.parent is None:
        return [best]
    if best.tag in ("article", "main"):
        near = [s for s in best.parent.children if isinstance(s, Node) and not s.pruned]
        return [s for s in near if s is best or s.tag == best.tag == "article" and s.score >= SIBLING_SHARE * best.score]
    kept = []
    for s in best.parent.children:
        if not isinstance(s, Node) or s.pruned or not s.chars:
            continue
        paragraph = s.tag in ("p", "pre", "blockquote", "ul", "ol", "table") and _density(s) < 0.25 and (s.chars > 80 or s.commas > 0 or s.tag == "p" and s.chars > 25)
        if s is best or s.score >= max(2.0, SIBLING_SHARE * best.score) or paragraph or s.tag in HEADING:
            kept.append(s)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """The text of block elements in page order, white space turned into single spaces."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    for node in nodes:
        stack: list = [node]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif not x.pruned:
                if x.tag == "br" or x.tag == "hr":
                    now.append(" ")
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.children))
        flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = blocks(_restored(main_nodes(tree(page))))
    # names alone must not empty a page
    return "\n".join(found or blocks(_restored(main_nodes(tree(page, by_name=False)))))


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every row with the ``text`` of its page and ``n_chars``, its code points. Columns named like
    these two can't be kept."""

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"],
            )

    rows, schema = beside(pages, keep, html_col, "text string, n_chars long")
    return rows.mapInArrow(run, schema)
