"""The main text of web pages, by scoring the trees of their elements.

A page is read into a tree. Every text block (the text between two block-level tags) passes points
for its length and its commas to its element, and half of them to that element's parent, discounted by its
share of link text. The container with the most points is the article; its siblings are kept, whatever their length, unless they
are mostly links. Elements that never belong to an article (menus, footers, forms, adverts, comments, scripts)
are left out before the scores are made, by tag and by the words in their class, id and role.

Classes and ids also stand at whole layouts and articles. So a mark by them does not count in compounds with
no-, has- and with-, nor at an element that holds the article or main element of the page, nor at one
that holds more than half of the paragraph points (of its article, if there is one; at comments only if no
other paragraph is left).

Cases: a null, empty or text-less page gives an empty text; unclosed and stray tags are repaired as
browsers do for p, li, table parts and block elements; text without any tag is one block; the tree is walked without recursion, so depth has
no limit; equal pages give equal texts; an empty table gives an empty table; other columns pass.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
NEVER = frozenset(
    "head nav footer aside form script style noscript iframe button select option textarea input dialog"
    " template svg canvas object embed menu title label fieldset".split()
)
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|side-bar|footer"
    r"|comments?|disqus|reply|replies|respond|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup"
    r"|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|login|masthead|site-header"
    r"|page-header|skip-link|hidden)(?:$|[\s_-])",
    re.I,
)
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|reply|replies|respond)(?:$|[\s_-])", re.I)
#: Compounds that speak of furniture elsewhere.
NOT_ITSELF = re.compile(r"(?<!\S)(?:(?:no|non|has|have|with|without)[_-]\S*|comments?[_-](?:open|closed|enabled|disabled|on|off))(?!\S)", re.I)
ARTICLE_TAGS = frozenset(["article", "main"])
PARAGRAPHS = frozenset("p td pre blockquote li dd h1 h2 h3 h4 h5 h6".split())

SPECIAL = re.compile(r"[>\"']")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
WHITE = re.compile(r"\s+")


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    side: bool = False
    words: str = ""
    mark: Element | None = None
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0
    blocks: list[int] = field(default_factory=list)
    children: list[Element] = field(default_factory=list)


@dataclass(eq=False)
class Block:
    element: Element
    text: str
    link_chars: int

    @property
    def points(self) -> float:
        return (1 + self.text.count(",") + len(self.text) / 100) * (1 - min(1.0, self.link_chars / len(self.text)))


def _is_side(tag: str, markup: str) -> bool:
    if tag in NEVER:
        return True
    if tag in ARTICLE_TAGS or tag in ("html", "body"):
        return False
    for name, value in ATTRIBUTE.findall(markup):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in SIDE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _side_words(markup: str) -> str:
    """Classes and ids that speak of furniture."""
    values = (NOT_ITSELF.sub(" ", v.strip("\"'")) for name, v in ATTRIBUTE.findall(markup) if name.lower() in ("class", "id"))
    return " ".join(v for v in values if SIDE_WORDS.search(v))


class Tokens:
    """The tags, comments and declarations of a page, each place of which is looked at a bounded number of times.

    A tag ends at the first > outside of quotes; one that does not end is text. The places outside of
    quotes that a tag without an end has passed are remembered: a tag that begins or comes there has no end either.
    """

    def __init__(self, page: str):
        self.page = page
        self.endless: bytearray | None = None

    def after(self, at: int) -> tuple[int, int] | None:
        """Start and end of the next one from a place on."""
        page = self.page
        start = page.find("<", at)
        while start >= 0:
            end = self._end(start)
            if end:
                return start, end
            start = page.find("<", start + 1)
        return None

    def _end(self, start: int) -> int:
        page, first = self.page, self.page[start + 1 : start + 2]
        if first in LETTERS or first == "/" and page[start + 2 : start + 3] in LETTERS:
            end = self._tag_end(start + (2 if first != "/" else 3))
            if end or page.find("<", start + 1) >= 0 or page.find(">", start + 1) >= 0:
                return end
            return len(page)
        if first not in ("!", "?"):
            return 0
        close, skip = ">", 2
        if page.startswith("<!--", start):
            close, skip = "-->", 4
        elif page.startswith("<![CDATA[", start):
            close, skip = "]]>", 9
        end = page.find(close, start + skip)
        return end + len(close) if end >= 0 else len(page)

    def _tag_end(self, at: int) -> int:
        page, passed = self.page, []
        while at < len(page) and not (self.endless and self.endless[at]):
            found = SPECIAL.search(page, at)
            if not found:
                passed.append((at, len(page)))
                break
            if found[0] == ">":
                return found.end()
            passed.append((at, found.end()))
            close = page.find(found[0], found.end())
            if close < 0:
                break
            at = close + 1
        if self.endless is None:
            self.endless = bytearray(len(page))
        for a, b in passed:
            self.endless[a:b] = b"\x01" * (b - a)
        return 0


class Tree:
    """Elements and text blocks of a page, in page order."""

    def __init__(self, page: str):
        self.root = Element("#root", None)
        self.elements = [self.root]
        self.pieces: list[tuple[Element, list[tuple[Element, str, bool]]]] = []
        self.here = self.root
        self.pending: list[tuple[Element, str, bool]] = []
        self.links = 0
        self.open: Counter[str] = Counter()
        at, tokens = 0, Tokens(page)
        while at < len(page):
            found = tokens.after(at)
            self._text(page[at : found[0] if found else len(page)])
            if not found:
                break
            at = found[1]
            markup = page[found[0] : at]
            if markup[1] in "!?":
                continue
            tag = NAME.match(markup)[1].lower()
            if markup[1] == "/":
                self._close(tag)
            else:
                at = self._open(tag, markup, page, at)
        self._end_block()

    def _text(self, text: str) -> None:
        if text and not self.here.side:
            self.pending.append((self.here, text, self.links > 0))

    def _end_block(self) -> None:
        if self.pending:
            self.pieces.append((self.here, self.pending))
            self.pending = []

    def text_blocks(self) -> list[Block]:
        """The text blocks outside of elements that are left out."""
        out = []
        for element, pieces in self.pieces:
            pieces = [p for p in pieces if not p[0].side]
            text = WHITE.sub(" ", entities.unescape("".join(p[1] for p in pieces))).strip()
            if text:
                out.append(Block(element, text, sum(len(p[1].strip()) for p in pieces if p[2])))
        return out

    def _open(self, tag: str, markup: str, page: str, at: int) -> int:
        if tag in BLOCK:
            self._end_block()
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "button", "object", "article", "section", "div"})
        if tag in SAME_LEVEL:
            self._close_to(*SAME_LEVEL[tag])
        if tag in VOID or markup.endswith("/>") and tag not in BLOCK and tag not in RAW:
            return at
        element = Element(tag, self.here, self.here.side or _is_side(tag, markup))
        if not element.side and tag not in ("html", "body"):
            element.words = _side_words(markup)
        element.mark = element if element.words and tag not in ARTICLE_TAGS else self.here.mark
        self.elements.append(element)
        if element.side and not self.here.side:
            # What stands before and after an element that is left out is not one text.
            if tag in BLOCK:
                self._end_block()
        self.here.children.append(element)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, at)
            return end.end() if end else len(page)
        self.here = element
        self.open[tag] += 1
        self.links += tag == "a"
        return at

    def _leave(self) -> None:
        self.links -= self.here.tag == "a"
        self.open[self.here.tag] -= 1
        self.here = self.here.parent

    def _close_to(self, tags: set[str], fence: set[str]) -> None:
        """Closes the nearest open element of these tags, unless a fence stands before it."""
        if not any(self.open[tag] for tag in tags):
            return
        up = self.here
        while up is not self.root and up.tag not in tags and up.tag not in fence:
            up = up.parent
        if up.tag in tags:
            self._end_block()
            while self.here is not up:
                self._leave()
            self._leave()

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        if not self.open[tag]:
            return
        up = self.here
        while up is not self.root and up.tag != tag:
            # The end of an inline element does not end the block around it.
            if tag not in BLOCK and up.tag in BLOCK:
                return
            up = up.parent
        if up is not self.root:
            while self.here is not up:
                self._leave()
            self._leave()


def _container(element: Element) -> Element:
    """The nearest element that holds blocks: an inline element passes its text up."""
    while element.tag not in BLOCK and element.parent is not None:
        element = element.parent
    return element


def _marks(mark: Element | None) -> Iterator[Element]:
    """The elements with a mark around one, from inside out."""
    while mark is not None:
        yield mark
        mark = mark.parent.mark


def _settle_marks(tree: Tree) -> None:
    """Takes the mark from elements that hold the article, and leaves out those that keep it."""
    blocks = []
    for element, pieces in tree.pieces:
        text = WHITE.sub(" ", entities.unescape("".join(p[1] for p in pieces))).strip()
        if text:
            whole = sum(len(p[1]) for p in pieces)
            points = Block(element, text, sum(len(p[1].strip()) for p in pieces if p[2])).points
            paragraph = _container(element).tag in PARAGRAPHS
            blocks.extend((p[0], points * len(p[1]) / whole, paragraph) for p in pieces if p[1].strip())
    # An article around each text: that of comments or related texts does not count.
    inner: dict[int, Element | None] = {}
    for e in tree.elements:
        above = inner[id(e.parent)] if e.parent is not None else None
        inner[id(e)] = e if e.tag in ARTICLE_TAGS and not e.words and above is None else above
    free: set[int] = set()
    kept = lambda mark: [m for m in _marks(mark) if id(m) not in free]
    articles = {id(a): a for e, _, _ in blocks if (a := inner[id(e)]) is not None}
    if articles and all(kept(a.mark) for a in articles.values()):
        for a in articles.values():
            free.update(id(m) for m in _marks(a.mark))
    # Points of every element with a mark, and of its scope: its article, or the page where there is none.
    points: dict[int, float] = {}
    scopes: dict[int, float] = {}
    comments: dict[int, float] = {}
    plain: dict[int, float] = {}
    marked: dict[int, Element] = {}
    for e, of_piece, paragraph in blocks:
        scope = id(inner[id(e)]) if inner[id(e)] is not None else 0
        scopes[scope] = scopes.get(scope, 0.0) + of_piece
        around = kept(e.mark)
        if not around and paragraph:
            plain[scope] = plain.get(scope, 0.0) + of_piece
        for m in around:
            points[id(m)] = points.get(id(m), 0.0) + of_piece
            marked[id(m)] = m
    for key, m in marked.items():
        article = inner[key]
        if article is None and articles:
            continue
        scope = id(article) if article is not None else 0
        if 2 * points[key] > scopes.get(scope, 0.0) and not (COMMENT_WORDS.search(m.words) and plain.get(scope)):
            free.add(key)
    for e in tree.elements:
        own = e.mark is e and id(e) not in free
        e.side = e.side or own or e.parent is not None and e.parent.side


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    if any(e.mark is e for e in tree.elements):
        _settle_marks(tree)
    blocks = tree.text_blocks()
    if not blocks:
        return ""
    scored: dict[int, Element] = {}
    for number, block in enumerate(blocks):
        own = _container(block.element)
        own.blocks.append(number)
        points = block.points
        holder = own.parent if own.tag in PARAGRAPHS and own.parent is not None else own
        holder.score += points
        scored[id(holder)] = holder
        if holder.parent is not None:
            holder.parent.score += points / 2
            scored[id(holder.parent)] = holder.parent
    _gather(tree, blocks)
    density = lambda e: e.link_chars / e.chars if e.chars else 0.0
    # Page order decides between equal scores; the root stands for a page without any container.
    best = max(scored.values(), key=lambda e: e.score * (1 - min(1.0, density(e))))
    up = best
    while up is not None:
        if up.tag in ARTICLE_TAGS:
            best = up
        up = up.parent
    # An element with all text of the one around it stands for that one.
    while best.tag not in ARTICLE_TAGS and best.parent is not None and best.parent.chars == best.chars:
        best = best.parent
    kept = {id(best)}
    least = max(2.0, best.score / 5)
    if best.parent is not None and best.tag not in ARTICLE_TAGS:
        for sibling in best.parent.children:
            # The header of the page is furniture; one inside a container is the head of its text.
            of_page = sibling.tag == "header" and sibling.parent.tag in ("body", "html", "#root")
            plain = sibling.chars > 0 and density(sibling) < 0.25 and not of_page
            if sibling is not best and not sibling.side and (sibling.score * (1 - density(sibling)) >= least or plain):
                kept.add(id(sibling))
    inside: set[int] = set()
    for e in tree.elements:  # in page order, so after those around them
        if id(e) in kept or e.parent is not None and id(e.parent) in inside:
            inside.add(id(e))
    return "\n".join(block.text for block in blocks if id(block.element) in inside)


def _gather(tree: Tree, blocks: list[Block]) -> None:
    """Characters and link characters of every element with all inside it."""
    for block in blocks:
        block.element.chars += len(block.text)
        block.element.link_chars += min(block.link_chars, len(block.text))
    for e in reversed(tree.elements):  # what is inside an element comes after it
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.link_chars += e.link_chars


def extract(pages: DataFrame) -> DataFrame:
    """The pages with main_text in place of html (a column of that name is replaced)."""
    rest = [c for c in pages.columns if c not in ("html", "main_text")]
    narrow = pages.select(*rest, F.col("html").cast("string").alias("html"))
    kept = [f for f in narrow.schema if f.name != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], [*rest, "main_text"])

    return narrow.mapInArrow(run, T.StructType([*kept, T.StructField("main_text", T.StringType())]))
