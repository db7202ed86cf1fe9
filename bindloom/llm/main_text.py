"""Main text of web pages by composite text density.

The page becomes a tree (tags as browsers read them, with the implied ends of the head, paragraphs,
list items, cells and options). Elements that are no article by their tag or role are left out first, those
with the class or id of a notice, advert or the like unless they hold the article. For every node that is left

    density = C / T * log_b(C / LC * T / LT),   b = max(e, ln(C / (C - LC) * LC + LC_body / C_body * C + e))

with C characters and T tags in its subtree and LC, LT those inside links (zeros count as one):
characters per tag, lowered where the text is link text. The density sum of a node adds up the
densities of its children; a run of text directly in the node is a child of one tag. The node with
the largest sum, or the container around it if it is a paragraph, list or the like, holds the article. The
threshold is the least density on its path to the body, or to an article element on the path with most of the
text: a neighbour of the path stays if its density reaches it, or if it is a heading.
"""

from __future__ import annotations

import html as entities
import re
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from bindloom.llm.common import append_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
DROPPED_TAGS = frozenset(
    "script style noscript template nav footer aside form button select textarea input iframe object svg canvas audio video "
    "dialog menu head title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply "
    "replies sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification "
    "popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login widget toolbar "
    "pagination pager copyright".split()
)
ARTICLES = frozenset("article main".split())
KEPT_TAGS = ARTICLES | frozenset("html body".split())
HEAD_TAGS = frozenset("title meta link script style base noscript template".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content is no markup
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div td center".split())
CLOSED_BY = {  # an open element of the first kind ends where one of the second kind begins
    "p": frozenset(
        "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
        "main menu nav ol p pre section table ul li dt dd tr td th".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "thead": frozenset(["tbody", "tfoot"]),
    "tbody": frozenset(["tbody", "tfoot"]),
}
SCOPES = frozenset("table ul ol dl select body html article main section div".split())
_split_names = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])").split


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "suspect", "article", "closable", "block", "open", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag, parent, dropped, suspect=False):
        self.tag, self.parent, self.dropped, self.suspect = tag, parent, dropped, suspect
        self.children: list = []  # nodes and strings in page order
        # inside an article or one itself; the nearest element with an implied end in this scope; the nearest block
        self.article = tag in ARTICLES or (parent is not None and parent.article)
        self.closable = self if tag in CLOSED_BY else None if tag in SCOPES or parent is None else parent.closable
        self.block = parent.block if tag in INLINE and parent is not None else self
        self.open: dict[str, int] = {}  # of a block: inline elements open in it
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_hidden(tag: str, attrs, parent: Node) -> bool:
    """No part of the article by its tag, role or style."""
    if tag in DROPPED_TAGS or (tag == "header" and not parent.article):
        return True
    for name, value in attrs:
        if name == "role" and value.strip().lower() in DROPPED_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _is_suspect(attrs) -> bool:
    """Has the class or id of a menu, notice, advert or the like."""
    for name, value in attrs:
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _split_names(one)}
                if DROPPED_WORDS & words and not {"has", "with", "no", "without"} & words:
                    return True
    return False


def _unescape(text: str) -> str:
    """Character references decoded; a number of very many digits is no character."""
    if "&" not in text:
        return text
    return entities.unescape(_LONG_NUMBER.sub("\ufffd", text))


_LONG_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{9,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{9,});?|&#(?=[0-9]{1000})0*+;?")
_NAME = re.compile(r"[^\s/>]*+")
_SKIP = re.compile(r"[\s/]*+")
_KEY = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")


class _Tree:
    """The tree of a page, read once from left to right; the time is linear in its length whatever the markup."""

    def __init__(self, html: str):
        self.root = self.at = Node("html", None, False)
        self.nodes = [self.root]
        self.body = None
        self.html = html
        self.last = {mark: html.rfind(mark) for mark in ">\"'"}
        self.quotes = True  # until a tag with quotes turns out not to end
        self._read()

    def _read(self) -> None:
        html, at = self.html, 0
        while at < len(html):
            start = html.find("<", at)
            if start < 0 or start > self.last[">"]:  # no tag ends behind here
                if not html.startswith("<!--", max(start, 0)) or start < 0:
                    self._data(html[at:])
                else:
                    self._data(html[at:start])
                return
            if start > at:
                self._data(html[at:start])
            at = self._markup(start)

    def _markup(self, start: int) -> int:
        """Reads what begins with ``<`` at ``start``; returns where it ends."""
        html = self.html
        mark = html[start + 1 : start + 2]
        if html.startswith("<!--", start):
            if html.startswith((">", "->"), start + 4):
                return html.find(">", start) + 1
            end = html.find("-->", start + 4)
            return len(html) if end < 0 else end + 3
        if mark in ("!", "?") or (mark == "/" and not html[start + 2 : start + 3].isalpha()):
            return html.find(">", start) + 1
        if mark == "/":
            name = _NAME.match(html, start + 2)
            self._end(name.group().lower())
            return html.find(">", name.end()) + 1 or len(html)
        if not (mark.isascii() and mark.isalpha()):
            self._data("<")
            return start + 1
        name = _NAME.match(html, start + 1)
        attrs, end = self._attributes(name.end())
        if end < 0:
            self.quotes = False
            end = html.find(">", name.end()) + 1 or len(html)
            attrs = []
        tag = name.group().lower()
        self._start(tag, attrs)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, end)
            stop = close.start() if close else len(html)
            if tag in ("title", "textarea"):
                self._data(html[end:stop])
            return stop
        return end

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes from ``at`` on and where the tag ends, -1 if it does not."""
        html, out = self.html, []
        if not self.quotes:
            return [], html.find(">", at) + 1 or -1
        while True:
            at = _SKIP.match(html, at).end()
            if at >= len(html):
                return out, -1
            if html[at] == ">":
                return out, at + 1
            key = _KEY.match(html, at)
            at, value = key.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and at < self.last[quote]:
                    end = html.find(quote, at + 1)
                    value, at = html[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare.group(), bare.end()
            out.append((key.group().lower(), _unescape(value)))

    def _start(self, tag: str, attrs) -> None:
        if tag == "html":
            return
        if tag == "body":
            if self.body is None:
                self._leave(self.root)
                self.body = self._open("body", [])
            return
        if self.at.tag == "head" and tag not in HEAD_TAGS:  # the head ends where something else begins
            self._leave(self.at.parent)
        x = self.at.closable
        while x is not None:  # implied ends
            if tag in CLOSED_BY[x.tag]:
                self._leave(x.parent)
                x = self.at.closable
            else:
                x = x.parent.closable
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.at.children.append(" ")
                self.at.tags += 1
            return
        self._open(tag, attrs)

    def _open(self, tag: str, attrs) -> Node:
        hidden = self.at.dropped or _is_hidden(tag, attrs, self.at)
        node = Node(tag, self.at, hidden, tag not in KEPT_TAGS and _is_suspect(attrs))
        self.at.children.append(node)
        self.nodes.append(node)
        opened = node.block.open if tag in INLINE else self.root.open
        opened[tag] = opened.get(tag, 0) + 1
        self.at = node
        return node

    def _leave(self, node: Node) -> None:
        """Closes what is open inside ``node``."""
        while self.at is not node:
            opened = self.at.block.open if self.at.tag in INLINE else self.root.open
            opened[self.at.tag] -= 1
            self.at = self.at.parent

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        # the end of an inline element never closes a block
        opened = self.at.block.open if tag in INLINE else self.root.open
        if not opened.get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._leave(node.parent)

    def _data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self._leave(self.at.parent)
        if not self.at.dropped:
            self.at.children.append(_unescape(data))


def _size(text: str) -> int:
    return len(" ".join(text.split()))


def _sift(tree: _Tree, body: Node) -> None:
    """Leaves out the elements of suspicious class or id.

    None with an article in it goes and, on a page without an article, none with most of the plain text."""
    if not any(n.suspect for n in tree.nodes):
        return
    plain: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(tree.nodes):  # children come after their parents
        if node.dropped:
            continue
        own = 0 if node.tag == "a" else plain.get(id(node), 0) + sum(_size(c) for c in node.children if isinstance(c, str))
        plain[id(node)] = own
        if node.parent is not None:
            plain[id(node.parent)] = plain.get(id(node.parent), 0) + own
            if (node.tag in ARTICLES and own) or id(node) in holds:
                holds.add(id(node.parent))
    most = plain.get(id(body), 0) / 2
    for node in tree.nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.suspect and id(node) not in holds and (holds or plain.get(id(node), 0) <= most):
            node.dropped = True


def _measure(tree: _Tree, body: Node) -> None:
    for node in reversed(tree.nodes):  # children come after their parents
        if node.dropped:
            continue
        node.chars += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = body.link_chars / max(1, body.chars)
    for node in tree.nodes:
        if node.dropped or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        base = max(e, log(c / max(1, c - lc) * lc + share * c + e))
        node.density = c / t * max(0.0, log(c / max(1, lc) * t / max(1, lt), base))
        if node.parent is not None:
            node.parent.total += node.density
        node.total += sum(float(n) for n in (len(" ".join(x.split())) for x in node.children if isinstance(x, str)))


def _text(node: Node, chosen=None) -> str:
    """Text of a subtree, blocks separated by blanks; ``chosen`` filters the nodes that are entered."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.dropped or (chosen is not None and not chosen(x)):
            out.append(" ")
            continue
        if x.tag not in INLINE:
            out.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def main_text(html: str) -> str:
    """The article of a page as one line of text; empty if there is none."""
    if not html:
        return ""
    tree = _Tree(html)
    body = tree.body or tree.root
    _sift(tree, body)
    _measure(tree, body)
    if not body.chars:
        return ""
    within = [n for n in tree.nodes if not n.dropped and n.chars]
    best = max(within, key=lambda n: n.total)
    while best.tag not in CONTAINERS and best.parent is not None:  # a paragraph brings its neighbours
        best = best.parent
    path = [best]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    # an article with most of the plain text is the whole that the threshold sifts, otherwise the body is
    most = (body.chars - body.link_chars) / 2
    tops = [i for i, n in enumerate(path) if n.tag in ARTICLES and n.chars - n.link_chars >= most]
    path = path[: tops[-1] + 1] if tops else path
    inside, on_path = set(map(id, path)), set(map(id, path[1:]))

    def chosen(node: Node) -> bool:
        if node.parent is None or id(node.parent) not in on_path or id(node) in inside:
            return True
        return node.density >= threshold or node.tag in HEADINGS

    return _text(path[-1], chosen)


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (None: all), text and n_chars (code points) of the article in ``html``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
    are left out. Character references are decoded, white space within a block becomes one blank,
    blocks are joined in page order by one blank. Null and empty pages and pages without text give
    "" and 0. Pages of any length and depth are one row each; broken markup is read as far as it
    goes. Rows are independent, so ties, repeated rows and empty tables need no rule. An input
    column with the name of a new one gives way to it.
    """

    def start():
        def step(cols):
            texts = [main_text(v.as_py() or "") for v in cols[0]]
            return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

        return step

    return append_columns(df, [html], keep, "text string, n_chars long", start)
