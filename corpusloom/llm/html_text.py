"""Main text of web pages: flat text blocks, classified by a decision tree from their own and their neighbours' features."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import read_table

#: Elements whose content is raw text and never shown, elements that show none of their content, elements without an end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("head template svg select datalist button audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text, and those of them that end an item which is still open inside.
BLOCKS = frozenset(
    "html body head p h1 h2 h3 h4 h5 h6 ul ol menu li dl dt dd table thead tbody tfoot tr td th caption div section article main header "
    "footer nav aside form fieldset blockquote pre figure figcaption address details summary hr dialog center noscript".split()
)
SCOPES = frozenset("ul ol menu dl table section article main aside nav header footer form blockquote body html".split())
HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS, ITEMS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li td th dt dd".split())
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption".split())
AROUND = frozenset("nav aside form footer dialog menu noscript".split())
_WHAT = (
    r"ad|ads|advert[a-z]*|banner|sponsor[a-z]*|promo[a-z]*|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|menu|nav|navbar|"
    r"navigation|breadcrumbs?|sidebar|widgets?|share|sharing|social|related|recommend[a-z]*|trending|comments?|respond|replies|disqus|footer|"
    r"header|masthead|copyright|login|search|pagination|pager|toolbar|skip"
)
_PART = (
    r"area|bar|blocks?|body|bottom|box|btn|buttons?|container|content|cards?|desktop|form|group|head|icons?|inner|items?|left|links?|lists?|main|"
    r"media|menu|mobile|module|nav|notice|outer|overlay|pages?|panel|posts?|articles?|stories|right|row|section|slot|text|threads?|title|top|"
    r"widgets?|wrap|wrapper|unit|warning|message|banner|footer|header|\d+"
)
#: A class or id that names what isn't main text: one of these words, alone or with words for a part of the page around it.
HINT = re.compile(
    rf"(?:^|\s)(?!(?:with|has|no|not)[-_]|(?:article|post|entry|content|main)[-_]header)(?:[a-z]+[-_])?(?:{_WHAT})(?:[-_]+(?:{_PART}|{_WHAT}))*(?=\s|$)",
    re.I,
)
#: Names that a wrapper or a part of an article may have too: a container of such a name that holds most of the page isn't what it is
#: called, and inside an article those of ``PARTS`` say nothing. The other names always count.
WEAK = re.compile(r"sidebar|social|header|notice|widgets?|share|banner|search|masthead|login|skip", re.I)
WHAT = re.compile(_WHAT, re.I)
PARTS = re.compile(r"(?:social|notice|(?:[a-z]+[-_])?header|banner|search|skip)$", re.I)
EXCUSED_TAGS = frozenset("form noscript header".split())
ROLE = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|form|dialog|alert|alertdialog|menu|menubar)""", re.I)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HREF = re.compile(r"""(?:^|[\s"'/])href\s*=""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
SPACE = re.compile(r"\s+")
#: Numbers that no code point has, and zeros before a number, which have no limit in HTML but one in Python.
BEYOND, ZEROS = re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}|0*[1-9][0-9]{7,});?"), re.compile(r"&#([xX]?)0{9,}")


def decoded(text: str) -> str:
    """The text with its character references replaced."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = BEYOND.sub("�", ZEROS.sub(r"&#\g<1>0", text))
    return html.unescape(text)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    inside: int
    boiler: int
    hint: int
    heading: int
    item: int
    tag: str = ""
    suspect: int = -1


@dataclass(slots=True)
class Suspect:
    """A container that says that it isn't main text: its element (``boiler``) or its name (``hint``), and whether another reading is open."""

    parent: int
    boiler: bool
    hint: bool
    weak: bool
    words: int = 0
    article: bool = False


class Frame(NamedTuple):
    """An open element: what holds for the text in it, and which open element an item of a kind would end."""

    tag: str = ""
    inside: bool = False
    suspect: int = -1
    heading: bool = False
    item: bool = False
    silent: bool = False
    li: int = -1
    dd: int = -1
    tr: int = -1
    td: int = -1
    #: The open inline elements of a block that are named as what isn't main text (with those of the same tag inside), and how many of each.
    inline: list | None = None
    tags: dict | None = None


@dataclass
class _Parser:
    """All that a tag needs to know is carried by the innermost open block, so each takes constant time on average."""

    blocks: list[Block] = field(default_factory=list)
    suspects: list[Suspect] = field(default_factory=list)
    stack: list[Frame] = field(default_factory=lambda: [Frame(inline=[], tags={})])
    count: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: int = -1  # how many blocks were open when the link began

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, len(text.split()), self.linked, int(top.inside), 0, int(bool(top.inline)), int(top.heading), int(top.item), top.tag, top.suspect))
        self.parts, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.count[self.stack.pop().tag] -= 1
        if self.link > depth:
            self.link = -1

    def told(self, named: str, attributes: str) -> tuple[bool, bool]:
        """Whether names, role or style say that an element isn't main text, beyond doubt or only maybe."""
        found = [m[0].strip() for m in HINT.finditer(named)]
        if self.stack[-1].inside:
            found = [x for x in found if not PARTS.match(x)]
        role = ROLE.search(attributes)
        parts = [p for x in found for p in re.split("[-_]+", x) if WHAT.fullmatch(p)]
        strong = any(not WEAK.fullmatch(p) for p in parts) or bool(HIDDEN.search(attributes)) or bool(role and role[1].lower() != "form")
        return strong, bool(found or role)

    def settled(self) -> list[Block]:
        """The blocks, told what holds for them: a container that may be a mere wrapper is one if it holds the article, or, on a page
        without any, more than half of the words that are neither linked nor surely something else."""
        sure: list[bool] = []
        for s in self.suspects:
            sure.append(not s.weak or s.parent >= 0 and sure[s.parent])
        total, without = 0, not any(b.inside for b in self.blocks)
        for b in self.blocks:
            if b.suspect < 0 or not sure[b.suspect]:
                total += b.words - b.linked
                if b.suspect >= 0:
                    self.suspects[b.suspect].words += b.words - b.linked
        for s in reversed(self.suspects):
            if s.parent >= 0:
                self.suspects[s.parent].words += s.words
                self.suspects[s.parent].article |= s.article
        held: list[tuple[bool, bool]] = []
        for s in self.suspects:
            above = held[s.parent] if s.parent >= 0 else (False, False)
            excused = s.weak and (s.article or without and 2 * s.words > total)
            held.append((above[0] or s.boiler and not excused, above[1] or s.hint and not excused))
        for b in self.blocks:
            if b.suspect >= 0:
                b.boiler, b.hint = int(held[b.suspect][0]), int(b.hint or held[b.suspect][1])
        return self.blocks

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":  # it ends the one that is open, and is a link only if it leads somewhere
            self.link = len(self.stack) if HREF.search(attributes) else -1
        named = " ".join(x or y or z for x, y, z in NAMED.findall(attributes)) if attributes else ""
        strong, weak = self.told(named, attributes) if attributes else (False, False)
        hint = strong or weak
        if tag not in BLOCKS and tag not in SILENT:
            top = self.stack[-1]
            if tag not in VOID and (hint or top.tags.get(tag)):
                top.inline.append(tag)
                top.tags[tag] = top.tags.get(tag, 0) + 1
            return
        at = len(self.stack) - 1
        if tag in BLOCKS:
            self.flush()
            if self.stack[at].tag == "head" and tag not in HEAD:
                at -= 1
            if self.stack[at].tag == "p":  # it holds no blocks
                at -= 1
        top = self.stack[at]
        closes = {"li": top.li, "dt": top.dd, "dd": top.dd, "tr": top.tr, "td": top.td, "th": top.td}.get(tag, -1)
        self.pop_to(closes if closes >= 0 else at + 1)
        if tag in VOID:
            return
        top, at = self.stack[-1], len(self.stack)
        scope, table = tag in SCOPES, tag == "table"
        boiler = tag in AROUND and not (tag == "noscript" and top.inside) or tag == "header" and not top.inside
        hint, suspect = bool(top.inline) or hint and tag not in ("html", "body"), top.suspect
        if boiler or hint:
            weak = not top.inline and not strong and (not boiler or tag in EXCUSED_TAGS)
            self.suspects.append(Suspect(suspect, boiler, hint, weak))
            suspect = len(self.suspects) - 1
        if tag in ("article", "main") and suspect >= 0:
            self.suspects[suspect].article = True
        self.stack.append(
            Frame(
                tag,
                top.inside or tag in ("article", "main"),
                suspect,
                top.heading or tag in HEADINGS,
                top.item or tag in ITEMS,
                top.silent or tag in SILENT,
                at if tag == "li" else -1 if scope else top.li,
                at if tag in ("dt", "dd") else -1 if scope else top.dd,
                at if tag == "tr" else -1 if table else top.tr,
                at if tag in ("td", "th") else -1 if table or tag == "tr" else top.td,
                [],
                {},
            )
        )
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        if tag not in BLOCKS and tag not in SILENT:
            top = self.stack[-1]
            while top.tags.get(tag):  # what is nested deeper than the element was left open
                last = top.inline.pop()
                top.tags[last] -= 1
                if last == tag:
                    break
            return
        if tag in BLOCKS:
            self.flush()
        if self.count.get(tag):
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.pop_to(at)

    def add(self, text: str) -> None:
        if not text or self.stack[-1].silent:
            return
        text = decoded(text)
        self.parts.append(text)
        if self.link >= 0:
            self.linked += len(text.split())


def text_blocks(page: str) -> list[Block]:
    """Flat blocks in page order; markup, comments and silent elements are gone, references decoded. Linear in the page.

    Only elements of SVG and MathML and those without content end at a slash. A quote that is opened in a tag hides ``>``
    unless it is never closed: from there on no quote does. An unfinished tag or comment at the end is no text.
    """
    parser, at, end, tags = _Parser(), 0, len(page), TAG
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            parser.add(page[at:])
            break
        parser.add(page[at:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 2)
            at = close + 3 if close >= 0 else end
            continue
        after = page[lt + 1 : lt + 2]
        name = page[lt + 2 : lt + 3] if after == "/" else after
        if not (name.isascii() and name.isalpha()):
            if after in ("!", "?", "/") and after:  # a comment of another form
                close = page.find(">", lt)
                at = close + 1 if close >= 0 else end
            else:
                parser.add("<")
                at = lt + 1
            continue
        found = tags.match(page, lt)
        if not found:
            tags = PLAIN_TAG
            found = tags.match(page, lt)
            if not found:
                break
        at, tag, attributes = found.end(), found[2].lower(), found[3].strip()
        if found[1]:
            parser.close(tag)
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            gt = page.find(">", close.end()) if close else -1
            at = gt + 1 if gt >= 0 else end
        elif tag == "br":
            parser.add(" ")
        elif not (attributes.endswith("/") and (tag in ("svg", "math") or parser.stack[-1].tag == "svg")):
            parser.open(tag, attributes)
    parser.flush()
    return parser.settled()


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "boiler", "hint", "heading", "item", "article_page")
#: Word count and link density of a block and its neighbours; the rest says where it stands.
DENSITY = FEATURES[:6]


def features(blocks: list[Block]) -> np.ndarray:
    """A row per block: its word count and link density and those of its neighbours, and where it stands."""
    own = np.array([(b.words, b.linked / max(b.words, 1)) for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    place = np.array([(b.inside, b.boiler, b.hint, b.heading, b.item) for b in blocks], float).reshape(-1, 5)
    return np.hstack([own, before, after, place, np.full((len(blocks), 1), float(any(b.inside for b in blocks)))])


#: The labelled table: shapes of pages, most of them without any element or class that names the main text. ``{12}`` stands for
#: some 12 words, ``[4]`` for a link of some 4 words, ``+`` before an element says that its text is main text.
SHAPES = (
    # news, blogs and magazines built of divisions
    "<div><div>[1] [1] [2] [1]</div><div>{3}</div></div>+<h1>{9}</h1><div>[2]</div>+<p>{40}</p>+<p>{65}</p>+<p>{7}</p>+<p>{50}</p>+<p>{80}</p><div>[6]</div><div>[7]</div><div>[5]</div><div>[1] [1] [2]</div><div>{6}</div>",
    "<table><tr><td>[1]</td><td>[2]</td><td>[1]</td></tr></table><table><tr><td>+<h2>{8}</h2>+<p>{35}</p>+<p>{90}</p>+<blockquote>{22}</blockquote>+<p>{60}</p></td><td><div>[5]</div><div>[4]</div><div>[6]</div></td></tr></table><div>[1] [2] [1]</div>",
    "<ul><li>[1]</li><li>[1]</li><li>[2]</li></ul>+<h1>{7}</h1>+<p>{30}</p>+<ul>+<li>{9}</li>+<li>{6}</li>+<li>{12}</li></ul>+<p>{45} [3] {20}</p>+<p>{70}</p><ul><li>[4]</li><li>[6]</li><li>[5]</li></ul><p>{2} [1]</p>",
    "<div>[2] [1] [1] [3]</div>+<div>{55}</div>+<div>{12}</div>+<div>{38}</div>+<div>{95} [2] {11}</div><div>[3] [2]</div><div>{9}</div>",
    "<div>{2}</div><div>[1] [1] [1]</div>+<h2>{6}</h2>+<p>{28} [4] {15}</p>+<p>{5}</p>+<p>{33}</p>+<p>{47} [1] {9} [2]</p>+<p>{26}</p><h4>{2}</h4><ul><li>[8]</li><li>[9]</li><li>[7]</li></ul><div>{4} [2] [2]</div>",
    # documentation, reference, questions and recipes
    "<div><ul><li>[2]</li><li>[3]</li><li>[2]</li><li>[1]</li></ul></div><div>+<h1>{4}</h1>+<p>{25}</p>+<pre>{30}</pre>+<h2>{3}</h2>+<p>{18} [2] {12}</p>+<pre>{14}</pre>+<p>{40}</p></div><div>[2] [2]</div>",
    "<p>[2] [2]</p>+<h1>{5}</h1>+<p>{32}</p>+<h2>{2}</h2>+<ul>+<li>{4}</li>+<li>{3}</li>+<li>{5}</li></ul>+<h2>{1}</h2>+<ol>+<li>{21}</li>+<li>{17}</li>+<li>{26}</li></ol><p>[3] [4] [3]</p><p>{8} [1]</p>",
    "<div>[1] [1] [1] [1] [1]</div>+<h1>{11}</h1>+<p>{60}</p>+<p>{44} [2] {30}</p><div>[2] {1} [2]</div><div>[6]</div><div>[8]</div>",
    "<dl><dt>[1]</dt><dt>[1]</dt></dl>+<p>{120}</p>+<p>{150} [3] {40} [2]</p>+<p>{10}</p>+<p>{110}</p><div>[1]</div><div>{7}</div>",
    # plain pages
    "+<p>{30}</p>+<p>{90}</p>+<p>{30}</p>",
    "+<h1>{9}</h1>+<p>{30}</p>+<p>{2}</p>+<p>{90}</p>",
    "<div>[2] [1]</div>+<p>{90}</p>+<p>{9}</p>+<p>{30}</p><div>[9]</div>",
    "<div>[1]</div>+<p>{90}</p>+<p>{1}</p>+<p>{90}</p><div>[1]</div>",
    # pages that name what isn't main text
    "<div class=menu>[1] [3]</div><div>+<h1>{9}</h1>+<p>{90}</p>+<p>{30}</p>+<p>{9}</p>+<p>{90}</p></div><div class=footer>{30}</div>",
    "<div class=header>{9}</div>+<p>{30}</p>+<p>{4}</p>+<p>{30}</p><div class=comments>{90}</div><div class=comments>{12}</div>",
    "<div class=nav>{1}</div>+<p>{9}</p>+<p>{90}</p>+<p>{2}</p>+<p>{30}</p><div class=ad>{30}</div><div class=newsletter>{9}</div>",
    "<div>[1]</div><div class=sidebar><p>{90}</p><p>{20}</p></div>+<p>{30}</p>+<p>{45}</p>+<p>{90}</p><div class=related><h4>{9}</h4><p>{30}</p></div><div>{2}</div>",
    "<div class=cookie-notice><p>{30}</p></div>+<h2>{5}</h2>+<p>{70}</p><form><p>{30}</p><label>{2}</label></form>+<p>{52}</p><nav>[2] [2]</nav><footer>{30}</footer>",
    # pages with an article or main element: all of its own text counts, however short or linked
    "<nav><ul><li>[2]</li><li>[1]</li><li>[3]</li></ul></nav><div class=ad>{9}</div><article>+<h1>{9}</h1>+<p>{30}</p>+<p>{1}</p>+<p>{90}</p>+<p>{2}</p></article><footer>{9}</footer>",
    "<header><h1>{2}</h1><nav>[2] [1]</nav></header><main>+<h2>{9}</h2>+<p>{90}</p>+<ul>+<li>{9}</li>+<li>{1}</li></ul>+<p>{9}</p></main><aside><h3>{1}</h3><p>{30}</p><p>{90}</p></aside>",
    "<article>+<h1>{1}</h1>+<p>{30}</p><div class=ad>{30}</div>+<p>{9}</p><div class=share>[9]</div></article><section class=comments><h3>{1}</h3><p>{30}</p><p>{90}</p><p>{9}</p></section>",
    "<div class=cookie-notice><p>{30}</p></div><article>+<p>{90}[9]</p>+<blockquote>{30}</blockquote>+<p>[9]</p></article><form><p>{30}</p><label>{1}</label></form><footer><p>{30}</p></footer>",
    "<header><p>{30}</p></header><article>+<header>+<h1>{9}</h1></header>+<p>{90}</p>+<p>{3}</p><footer><p>{9}</p></footer><aside>{30}</aside>+<p>{30}</p></article><div class=related><h4>{9}</h4><p>{30}</p></div>",
    "<article>+<p>{1}</p>+<p>{2}</p>+<ul>+<li>{1}</li>+<li>[1]</li></ul>+<p>{9}</p></article><div>{30}</div><div>{9}</div><p>{90}</p><p>{1}</p>",
    "<article>+<p>{1}</p></article>",
    "<article>+<p>{1}</p>+<p>{1}</p>+<p>{2}</p></article>",
    "<nav>[2]</nav><article>+<p>{30}</p>+<p>{2}</p></article>",
    "<main>+<h1>{2}</h1>+<p>[3]</p>+<p>{1}</p></main><footer>{3}</footer>",
    "<article>+<p>[2]</p>+<p>[5]</p>+<p>{3} [9]</p></article><div>[2]</div>",
    "<div>[4]</div><article>+<p>[2]</p>+<p>{90}</p>+<p>[3]</p>+<p>{4}</p></article>",
    "<main>+<p>{5}</p>+<p>[1]</p>+<ul>+<li>[7]</li>+<li>[6] {1}</li></ul>+<p>{2}</p>+<p>{1}</p></main>",
    "<article>+<h1>{9}</h1>+<p>{30}</p></article>",
    "<article>+<p>[9]</p>+<p>{2}</p>+<p>[1]</p></article>",
    "<nav>[1]</nav><main>+<p>{30}</p>+<p>[30]</p></main>",
    "<article>+<p>{90}</p>+<ul>+<li>[1]</li>+<li>[2]</li></ul></article><div>{9}</div>",
)
#: How often each shape is drawn, with other lengths of its texts each time.
DRAWS, SEED = 6, 20_240_301
_SHAPE = re.compile(r"(\+)?(<[^>]*>)|\{(\d+)\}|\[(\d+)\]")


def drawn_page(shape: str, rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page of this shape, and the labels of its blocks in order: 1 for main text."""
    page, labels, stack, told = [], [], [0], False
    size = lambda n: max(1, int(round(int(n) * rng.uniform(0.6, 1.5))))
    for main, tag, words, linked in _SHAPE.findall(shape):
        if tag:
            if tag.startswith("</"):
                stack.pop()
            else:
                stack.append(int(bool(main)))
            told = False
            page.append(tag)
            continue
        if not told:
            labels.append(stack[-1])
            told = True
        page.append(f"<a href=#>{'word ' * size(linked)}</a> " if linked else "word " * size(words))
    return "".join(page), labels


def labelled_table(shapes: tuple[str, ...] = SHAPES, draws: int = DRAWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of all drawn pages; equal on every machine."""
    rng, x, y = np.random.default_rng(SEED), [], []
    for shape in shapes:
        for _ in range(draws):
            page, labels = drawn_page(shape, rng)
            blocks = text_blocks(page)
            if len(blocks) != len(labels):
                raise ValueError(f"{len(blocks)} blocks, {len(labels)} labels: {shape}")
            x.append(features(blocks))
            y += labels
    return np.vstack(x), np.array(y)


@dataclass
class Node:
    label: int
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A classification tree by Gini impurity; the first best cut is taken, so equal tables give equal trees."""
    node = Node(int(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = (2.0, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            impurity = sum(2 * part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low])) / len(y)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best[1] >= 0:
        node.feature, node.cut = best[1:]
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.low is None or tree.high is None:
        return np.full(len(x), tree.label)
    low, out = x[:, tree.feature] <= tree.cut, np.zeros(len(x), int)
    out[low], out[~low] = classify(tree.low, x[low]), classify(tree.high, x[~low])
    return out


def chosen(blocks: list[Block], tree: Node) -> np.ndarray:
    """Which blocks are main text. On a page without an article whose paragraphs are too short for the tree, so that it leaves most of
    their words out, all paragraphs, headings, items and cells count that are no links and not named as something else."""
    kept = classify(tree, features(blocks)).astype(bool)
    if any(b.inside for b in blocks):
        return kept
    plain = np.array([b.tag in TEXT_TAGS and not (b.boiler or b.hint) and 2 * b.linked < b.words for b in blocks])
    words = np.array([b.words for b in blocks])
    if any(p and b.tag == "p" for p, b in zip(plain, blocks, strict=True)) and 2 * words[kept].sum() < words[plain].sum():
        return kept | plain
    return kept


def main_text(page: str, tree: Node) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, k in zip(blocks, chosen(blocks, tree), strict=True) if k)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; ``text`` is empty where a page has no main text.

    A null or empty page has the empty text; broken markup is read as HTML parsers read it, as far as it goes; bytes
    that aren't UTF-8 are read as U+FFFD; repeated rows give repeated rows; an empty table gives none; other columns
    are not read. A page takes time in proportion to its length, however it is nested.
    """
    tree = grow(*labelled_table())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((page.as_py() or b"").decode("utf-8", "replace"), tree) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))
