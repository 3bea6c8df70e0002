"""Main text of web pages by scoring the element tree.

Paragraphs give points for their length and commas to the elements around them, fewer the further
away; an element's points are discounted by the share of its text that lies in links.  The best
element is kept with its headings and siblings that are not mostly links, without menus, page headers
and footers, sidebars, notices, adverts, forms and reader comments.
"""

from __future__ import annotations

import html
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from maskmix.llm.common import append, free_name, texts_of

# Fixed lists of element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset(
    "nav header footer aside form button select option input label fieldset dialog menu iframe object embed svg math "
    "canvas audio video map head search".split()
)
_PARAGRAPH = frozenset("p pre td blockquote dd li".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_WHOLE = frozenset("html body article main".split())
_ARTICLE = ("article", "main")
#: An element that opens closes an open one of these, up to the nearest of those.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role of what is not the article; the second pattern is for beginnings.
_BOILERPLATE = frozenset(
    "ad ads adv nav navbar navigation menu menubar header masthead footer sidebar aside notice alert banner cookie "
    "cookies consent gdpr comment comments commentlist disqus respond reply replies share sharing social related "
    "popup modal overlay toolbar breadcrumb breadcrumbs pagination pager widget skip complementary contentinfo search "
    "form signup login newsletter subscribe subscription sponsored paywall topbar toc".split()
)
_BOILERPLATE_START = re.compile(r"(?:advert|sponsor|promo|cookie|recommend|newsletter|subscri|breadcrumb)")

#: Words that make a name speak of a page's state, and names of headlines.
_STATE = frozenset("has no not with without is open closed enabled disabled on off".split())
_HEADLINE = re.compile(r"(?:entry|post|article|page|content|section)[-_]+header")
#: Elements with these words never hold the article, however long they are.
_NEVER = frozenset("comment comments commentlist disqus respond reply replies nav navbar navigation menu menubar".split())

#: Pieces of a tag's attributes, quoted or not, that are read as such; a longer tag ends at its first ``>``.
#: A page of unclosed quotes is so read in linear time.
ATTRIBUTE_PIECES = 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|xmp)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    rf"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'){{0,{ATTRIBUTE_PIECES}}}+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class _Node:
    __slots__ = (
        "tag", "parent", "dropped", "named", "never", "title", "link", "block", "depth", "marked", "gone", "points",
        "whole", "size", "linked", "prose", "kept",
    )

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, named: bool = False, never: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.named = named  # by its class, id or role not of the article
        self.never = never or (parent is not None and parent.never)  # surely so
        self.marked = tag in _ARTICLE or (parent is not None and parent.marked)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.title = False  # dropped only for an article's own header
        self.depth = parent.depth + 1 if parent is not None else 0
        self.block = self if parent is None or tag in _BLOCK else parent.block
        self.points = 0.0
        self.whole = self.size = self.linked = 0  # blocks of a marked article; characters, and those in links
        self.gone = self.prose = self.kept = False  # prose: holds a paragraph or heading


class _Open:
    """The open elements.  Every one is opened and closed once, and the nearest of a name is found at once."""

    def __init__(self):
        self.node = _Node("#page", None, False)
        self.made = [self.node]  # elements that can hold text, each behind its parent
        self.named: dict[str, list[_Node]] = {}

    def push(self, node: _Node) -> None:
        self.named.setdefault(node.tag, []).append(node)
        self.node = node
        if not node.dropped or node.title:
            self.made.append(node)

    def close(self, node: _Node | None) -> None:
        if node is None:
            return
        while self.node is not node.parent:
            self.named[self.node.tag].pop()
            self.node = self.node.parent

    def nearest(self, names, stops=()) -> _Node | None:
        """The innermost open element of ``names`` inside of all open ones of ``stops``."""
        found = max((self.named[n][-1] for n in names if self.named.get(n)), key=lambda n: n.depth, default=None)
        barrier = max((self.named[n][-1].depth for n in stops if self.named.get(n)), default=0)
        return found if found is not None and found.depth > barrier else None

    def ended(self, tag: str) -> _Node | None:
        """The element that an end tag closes; an inline one reaches no further than the block it stands in."""
        found = self.nearest((tag,))
        return found if tag in _BLOCK or found is None or found.depth > self.node.block.depth else None


def _listed(tag: str, attributes: str) -> list[str]:
    """Words on the list at the beginning or end of a class, id or role."""
    if tag in _WHOLE or tag in _HEADING or not attributes or "=" not in attributes:
        return []
    out = []
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            words = _WORD.findall(name)
            if words and not _STATE.intersection(words) and not _HEADLINE.fullmatch(name):
                ends = {words[0], words[-1]}
                out += [w for w in ends if w in _BOILERPLATE or _BOILERPLATE_START.match(w)]
    return out


class _Block:
    """A block of text, the element it stands in, and how many of its characters are in links."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: _Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, min(linked, len(text))

    def points(self) -> float:
        return 0.0 if self.node.tag in _HEADING else 1 + self.text.count(",") + min(len(self.text) / 100, 3.0)


def _blocks(page: str) -> tuple[list[_Block], list[_Node]]:
    """Blocks of text in page order, dropped elements left out, and the elements that can hold text."""
    opened = _Open()
    blocks: list[_Block] = []
    parts: list[str] = []
    holder, linked = opened.node, 0

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(_Block(holder, text, linked))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal holder, linked
        if not parts:
            holder = opened.node.block
        parts.append(raw)
        if opened.node.link:
            linked += len(raw)

    at, last = 0, page.rfind(">") + 1  # no tag ends behind it
    for token in _TOKEN.finditer(page, 0, last):
        start, end = token.span()
        node = opened.node
        if start > at and not node.dropped:
            add(page[at:start])
        at = end
        closing, name, attributes = token.group(2, 3, 4)
        if name is None:
            closing, name, attributes = token.group(5, 6, 7)
        if name is None:
            if end == last and _unclosed(token):
                at = len(page)
            continue
        tag = name.lower()
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in _BLOCK:
            close_block()
        if closing:
            opened.close(opened.ended(tag))
            continue
        if tag in _CLOSES:
            opened.close(opened.nearest(*_CLOSES[tag]))
        elif tag in _BLOCK:
            opened.close(opened.nearest(("p",), ("td", "th", "table", "button", "object")))
        if tag not in _VOID and not attributes.endswith("/"):
            opened.push(_element(tag, attributes, opened.node))
    if at < len(page) and not opened.node.dropped:
        add(page[at:].partition("<!--")[0])
    close_block()
    return _of_article(blocks, opened.made), opened.made


def _unclosed(token: re.Match) -> bool:
    """A comment or raw element that runs to the end of the page."""
    text = token.group()
    if text.startswith("<!--"):
        return not text.endswith("-->")
    raw = token.group(1)
    return raw is not None and re.search(rf"</{raw}\s*+>\Z", text[-len(raw) - 64 :], re.I) is None


def _element(tag: str, attributes: str, parent: _Node) -> _Node:
    listed = () if parent.dropped else _listed(tag, attributes)
    headline = parent.title and tag in _HEADING  # the headline in an article's own header
    dropped = not headline and (parent.dropped or tag in _DROPPED or bool(listed and tag not in _BLOCK))
    node = _Node(tag, parent, dropped, bool(listed), not _NEVER.isdisjoint(listed))
    node.title = not headline and (parent.title or (tag == "header" and parent.marked and not parent.dropped))
    return node


def _up(nodes: list[_Node], *fields: str) -> None:
    """Add what each element holds to its parent, the innermost first."""
    for node in reversed(nodes):
        if node.parent is not None:
            for field in fields:
                setattr(node.parent, field, getattr(node.parent, field) + getattr(node, field))


def _of_article(blocks: list[_Block], nodes: list[_Node]) -> list[_Block]:
    """``blocks`` without those in elements named as boilerplate, but for elements that hold most of the
    page's paragraph points when no article or main element has any outside of them."""
    total, whole = 0.0, 0
    for block in blocks:
        node = block.node
        if node.tag in _HEADING:
            continue
        if not node.never:
            points = block.points() * (1 - block.linked / len(block.text))
            node.points += points
            total += points
        node.whole += node.marked
        whole += node.marked
    _up(nodes, "points", "whole")
    for node in nodes:
        spared = 2 * node.points > total and node.whole == whole
        node.gone = (node.parent is not None and node.parent.gone) or (node.named and not spared)
    return [b for b in blocks if not b.node.gone]


def _score(blocks: list[_Block], nodes: list[_Node]) -> dict[_Node, float]:
    """Points of the elements that hold paragraphs, discounted by their links."""
    scored: dict[_Node, float] = {}
    for block in blocks:
        node = block.node
        node.size += len(block.text)
        node.linked += block.linked
        heading = node.tag in _HEADING
        node.prose = node.prose or heading or node.tag in _PARAGRAPH
        points = block.points()
        up, share = (node.parent if node.tag in _PARAGRAPH or heading else node), 1.0
        while up is not None and share > 0.1:
            scored[up] = scored.get(up, 0.0) + points * share
            up, share = up.parent, share / 2
    _up(nodes, "size", "linked", "prose")
    return {n: s * (1 - n.linked / n.size if n.size else 0.0) for n, s in scored.items()}


def main_text(page: str | None) -> str:
    """The kept blocks, joined by an empty line; empty if the page has no text of its own.

    Beside the best element its siblings stay unless most of their text is links, what holds paragraphs or
    headings beside the elements around it unless a quarter is, and every article element.  Beside an element
    that the page itself marks as its article only siblings with paragraphs, headings or many points stay.
    Time grows with the length of the page alone, however deep it is."""
    blocks, nodes = _blocks(page or "")
    if not blocks:
        return ""
    scores = _score(blocks, nodes)
    weight = {"article": 3.0, "main": 2.5, "#page": 0.5, "html": 0.5, "body": 0.8}
    best = max(scores, key=lambda n: (scores[n] + (n.tag in _ARTICLE)) * weight.get(n.tag, 1.0))
    around, beyond = best, set()
    while around is not None:  # a part of an article stands for the article
        if around.tag in _ARTICLE:
            best = around
        around = around.parent
    around = best.parent
    while around is not None:
        beyond.add(around)
        around = around.parent
    limit = max(10.0, 0.2 * scores.get(best, 0.0))

    def beside(node: _Node) -> bool:
        if node in beyond or not node.size:
            return False
        link = node.linked / node.size
        if node.tag == "article":
            return link < 0.5
        if node.parent is best.parent:
            return scores.get(node, 0.0) >= limit or (link < 0.5 and (bool(node.prose) or best.tag not in _ARTICLE))
        return node.parent in beyond and best.tag not in _ARTICLE and bool(node.prose) and link < 0.25

    for node in nodes:
        node.kept = node is best or (node.parent is not None and node.parent.kept) or beside(node)
    return "\n\n".join(b.text for b in blocks if b.node.kept)


def _extract(name: str):
    def run(batch: pa.RecordBatch):
        texts = [main_text(t) for t in texts_of(batch, name)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return run


def with_main_text(pages: DataFrame, html_col: str, text_name: str, size_name: str) -> DataFrame:
    """``pages`` with the main text of ``html_col`` and its code points, under names that ``pages`` does not have yet.

    Missing or empty html gives empty text and 0; repeated rows stay and get the same text each; an empty
    table gives an empty one."""
    added = [(free_name(pages, text_name), "string"), (free_name(pages, size_name), "long")]
    return append(pages, html_col, added, partial(_extract, html_col))
