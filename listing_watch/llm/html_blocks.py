"""Main text of web pages: flat blocks, classified by a decision tree.

A page is cut into blocks at block-level tags, in one pass whose time grows with the page's
length alone. A block is measured by its words and the share of them in links, by the same of the
blocks before and after it and of all blocks in its box (the nearest enclosing element that holds
others) beside the page's largest, and by where it stands: in a heading, among sectioning tags, before or after the first
h1, after a heading that opens reader comments, and what the class, id and role tokens around it
say. A token counts only if it is made of known words alone (`cookie-banner`, not `has-sidebar`),
and says nothing of an element that holds the article. A CART tree, grown from the small labelled
table `LABELLED`, tells main text from the rest; the text of the kept blocks, in page order, is
the result. Pages are judged alike at any size.

Scripts, styles, templates, comments and hidden elements are never text; character references
are decoded, white space inside a block becomes one space.

Defined results: a null or empty page, and one whose blocks are all rejected, has the empty text.
Unclosed and crossing tags end with the element that holds them; what follows an unclosed script,
comment or tag is not text. Rows are judged alone, so repeated rows give repeated results. An
empty table gives an empty result. Columns of the input are carried along, whatever their names;
those made here start with `hb_`, and an input column of the same name gives way.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, packed, unpacked

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
SPACE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none", re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those whose content is not shown.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
UNSEEN = frozenset("head noscript template svg math object select datalist canvas audio video".split())
HEAD = frozenset("meta link base title style script noscript template".split())
#: Tags that hold page furniture, those that hold the article, and those that hold no blocks.
FURNITURE = frozenset("nav aside footer form menu dialog button fieldset".split())
ARTICLE = frozenset("article main".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd tr tbody thead pre figcaption caption blockquote".split())
#: Words of class, id and role tokens that name page furniture, the article, or a box of any kind.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu sidebar aside footer breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay comment comments"
    " disqus discussion reply replies respond responses share sharing social related recommended newsletter subscribe signup login search widget widgets toolbar pagination pager copyright disclaimer masthead complementary contentinfo".split()
)
ARTICLE_WORDS = frozenset("article content main post story entry body text".split())
BOX_WORDS = frozenset("box wrap wrapper container block section area list link links item items top bottom left right site page global primary secondary inner outer bar panel unit slot row col column group inline thread form field".split())
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
REPLIES = re.compile(r"\W*(\d+\s+|leave a |post a |write a )?(comments?|responses?|repl(y|ies)|discussion|kommentare?|commentaires?|comentarios?|réactions?)\b", re.I)
RIGHTS = re.compile(r"\s*(©|\(c\)|copyright\b)|.*\b(all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\b", re.I)

MEASURES = (
    "words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "box_words", "box_link_density", "box_share",
    "heading", "place", "article", "any_article", "header", "furniture", "hint", "replies", "rights",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    box: int
    heading: int  # level, 0 for none
    place: int  # before (-1) or from (1) the first h1; 0 where there is none
    article: int
    header: int
    furniture: int  # enclosing furniture tags; those inside an article count double
    hints: tuple[int, ...]  # places of the elements whose tokens speak of furniture (positive) or article
    replies: int
    rights: int


@dataclass
class _Open:
    tag: str
    box: int
    article: int
    header: int
    furniture: int
    hints: tuple[int, ...]
    unseen: bool
    replies: bool = False  # a heading that opens comments has come in this element


def token_hint(value: str) -> int:
    """1 if a class, id or role names page furniture, -1 if it names the article, else 0."""
    good = False
    for token in value.split():
        parts = [p.lower() for p in PART.findall(CAMEL.sub(" ", token))]
        if not parts or not all(p in FURNITURE_WORDS or p in ARTICLE_WORDS or p in BOX_WORDS for p in parts):
            continue
        if any(p in FURNITURE_WORDS for p in parts):
            return 1
        good = good or any(p in ARTICLE_WORDS for p in parts)
    return -1 if good else 0


@dataclass
class _Parser:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, 0, 0, 0, (), False)])
    count: Counter = field(default_factory=Counter)
    void_hints: set[int] = field(default_factory=set)
    parts: list[str] = field(default_factory=list)
    link: bool = False
    linked: int = 0
    boxes: int = 0
    hinted: int = 0
    place: int = 0

    def text(self, raw: str) -> None:
        if not raw or self.stack[-1].unseen:
            return
        t = html.unescape(raw) if "&" in raw else raw
        self.parts.append(t)
        if self.link:
            self.linked += len(t.split())

    def end_block(self) -> None:
        if not self.parts:
            return
        t = SPACE.sub(" ", "".join(self.parts)).strip()
        linked, self.parts, self.linked = self.linked, [], 0
        if not t:
            return
        at = self.stack[-1]
        level = int(at.tag[1]) if len(at.tag) == 2 and at.tag[0] == "h" and at.tag[1].isdigit() else 0
        n = t.count(" ") + 1
        if level and n <= 8 and REPLIES.match(t) and len(self.stack) > 1:
            self.stack[-2].replies = True
        replies = any(s.replies for s in self.stack[-8:])
        self.blocks.append(Block(t, n, min(linked, n), at.box, level, self.place, at.article, at.header, at.furniture, at.hints, int(replies), int(n <= 40 and bool(RIGHTS.match(t)))))

    def push(self, tag: str, attributes: str) -> None:
        up = self.stack[-1]
        box, hints = up.box, up.hints
        if tag not in LEAVES:
            self.boxes += 1
            box = self.boxes
        article = tag in ARTICLE
        if article:  # what holds the article is no furniture
            self.void_hints.update(hints)
            hints = tuple(h for h in hints if h < 0)
        elif attributes and tag not in ("html", "body"):
            found = [token_hint(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)]
            if any(found):
                self.hinted += 1
                hints = (*hints[-15:], self.hinted if 1 in found else -self.hinted)
        furniture = up.furniture + (tag in FURNITURE) * (2 if up.article else 1)
        unseen = up.unseen or tag in UNSEEN or bool(attributes and HIDDEN.search(attributes) and "overflow" not in attributes)
        self.stack.append(_Open(tag, box, up.article or int(article), up.header or int(tag == "header"), min(furniture, 4), hints, unseen))
        self.count[tag] += 1

    def pop(self) -> None:
        self.end_block()
        self.count[self.stack.pop().tag] -= 1

    def open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        if tag == "br":
            self.text(" ")
        if tag in INLINE or tag == "br":
            return
        self.end_block()
        if self.stack[-1].tag == "head" and tag not in HEAD:
            self.pop()
        if tag in VOID:
            return
        if self.stack[-1].tag == "p":  # an open paragraph ends where the next block begins
            self.pop()
        while tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.stack[-1].tag in ("li", "td", "th", "dt", "dd", "p") and not (tag == "tr" and self.stack[-1].tag == "li"):
            self.pop()
        self.link = False
        if tag == "h1" and not self.stack[-1].unseen and self.place == 0:
            self.place = 1
            for b in self.blocks:
                b.place = -1
        self.push(tag, attributes)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in INLINE:
            return
        self.end_block()
        self.link = False
        if tag in VOID or self.count[tag] <= 0:
            return
        while self.stack[-1].tag != tag:
            self.pop()
        self.pop()


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page, in order."""
    p, page, at = _Parser(), page or "", 0
    no_more: set[str] = set()  # quotes that don't come again
    while (i := page.find("<", at)) >= 0:
        p.text(page[at:i])
        at = i
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        closing = page.startswith("</", i)
        m = NAME.match(page, i + 1 + closing)
        if not m:
            if closing or page.startswith(("<!", "<?"), i):
                end = page.find(">", i)
                at = end + 1 if end >= 0 else len(page)
            else:  # a lone sign
                p.text("<")
                at = i + 1
            continue
        tag, end = m[0].lower(), m.end()
        while (stop := STOP.search(page, end)) and stop[0] != ">":
            quote, after = stop[0], -1
            k = stop.start() - 1
            while k >= end and page[k].isspace():
                k -= 1
            if quote not in no_more and page[k] == "=":
                after = page.find(quote, stop.end())
                if after < 0:
                    no_more.add(quote)
            end = after + 1 if after >= 0 else stop.end()
        if not stop:
            at = len(page)
            break
        attributes, at = page[m.end() : stop.start()], stop.end()
        if closing:
            p.close(tag)
        elif tag in RAW:
            end = RAW[tag].search(page, at)
            if tag == "textarea" or not end:
                p.end_block()
            gone = page.find(">", end.end()) if end else -1
            at = gone + 1 if gone >= 0 else len(page)
        else:
            p.open(tag, attributes)
            if attributes.endswith("/") and tag not in VOID and tag not in INLINE and tag in UNSEEN:
                p.close(tag)
    p.text(page[at:])
    p.end_block()
    for b in p.blocks:
        b.hints = tuple(h for h in b.hints if h not in p.void_hints)
    return p.blocks


def measures(page: list[Block]) -> np.ndarray:
    """A row of MEASURES for each block."""
    if not page:
        return np.zeros((0, len(MEASURES)))
    words = np.array([b.words for b in page], float)
    linked = np.array([b.linked for b in page], float)
    box = np.array([b.box for b in page])
    box_words, box_linked = np.bincount(box, words)[box], np.bincount(box, linked)[box]
    density = linked / words
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    hint = [sum(1 if h > 0 else -0.25 for h in b.hints) for b in page]
    flags = np.array([[b.heading, b.place, b.article, 0, b.header, b.furniture, h, b.replies, b.rights] for b, h in zip(page, hint)], float)
    flags[:, 3] = float(flags[:, 2].any())
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), box_words, box_linked / box_words, box_words / box_words.max(), flags])


#: The labelled table: pages whose blocks begin with ① (main text) or ⓪ (the rest). %s, %m and %l
#: stand for a few words, a sentence and a paragraph; each page comes in LENGTHS lengths of them.
LABELLED = [
    "<nav><ul><li><a href=/a>⓪%s</a><li><a href=/b>⓪%s</a></ul></nav><article><h1>①%s</h1><p>①%l<p>①%m<p>①%s</article><footer>⓪%m</footer>",
    "<div class=top><a href=/a>⓪%s</a> <a href=/b>%s</a></div><div><h1>①%s</h1><p>①%l</p><p>①%s</p><p>①%l</p></div><div>⓪%s</div>",
    "<header>⓪%m</header><div class=ad>⓪%l</div><main><h1>①%s</h1><p>①%m</p><p>①%l</p></main><aside><h3>⓪%s</h3><p>⓪%l</p></aside><footer><p>⓪%m</p></footer>",
    "<div class=cookie-notice><p>⓪%l</p><button>⓪%s</button></div><article><header><h1>①%s</h1></header><p>①%l</p><ul><li>①%s</li><li>①%s</li></ul></article><div id=comments><h2>⓪Comments</h2><p>⓪%l</p><p>⓪%m</p></div>",
    "<ul><li><a href=/a>⓪%s</a><li><a href=/b>⓪%s</a><li><a href=/c>⓪%s</a></ul><div><p>①%l</p><p>①%l</p><p>①%m</p></div><div><a href=/c>⓪%s</a> <a href=/d>%s</a></div><div>⓪© 2020 %s</div>",
    "<article><h1>①%s</h1><div class=share>⓪%s</div><p>①%l</p><aside class=promo>⓪%l</aside><p>①%m</p><form>⓪%m</form><section class=comments><h3>⓪2 comments</h3><p>⓪%l</p></section></article>",
    "<div>⓪<a href=/1>%s</a> | <a href=/2>%s</a> | <a href=/3>%s</a></div><h1>①%s</h1><p>①%l <a href=/l>%s</a></p><p>①%l</p><p><a href=/r>⓪%m</a></p><p>⓪%s</p>",
    "<header class=site><nav><a href=/>⓪%s</a></nav><form>⓪%s</form></header><main><article><p>①%m</p><p>①%m <a href=/x>%s</a></p><blockquote>①%m</blockquote><table><tr><td>①%s</td><td>①%s</td></tr></table></article></main><div class=sidebar><p>⓪%l</p></div>",
    "<div class=banner><p>⓪%l</p></div><div class=content><h2>①%s</h2><p>①%l</p><h2>①%s</h2><p>①%m</p></div><div class=newsletter>⓪%m</div>",
    "<div class=page><h1>①%s</h1><p>①%m</p><p>①%l</p></div><div class=footer-links><a href=/q>⓪%s</a> <a href=/w>%s</a></div>",
    "<div>⓪%l</div><article><p>①%s</p><p>①%l</p></article><p>⓪%m</p>",
    "<header><h1>⓪%s</h1><p>⓪%m</p></header><article><header>①%s</header><p>①%l</p></article>",
    "<div><p>①%l</p><p>①%l</p></div><div><h3>⓪3 responses</h3><div>⓪%m</div><div>⓪%l</div><div>⓪%s</div></div>",
    "<h1>①%s</h1><p>①%l</p><p>①%l</p><div class=comments><p>⓪%l</p><p>⓪%m</p><p>⓪%l</p></div><aside><p>⓪%l</p></aside><footer><p>⓪%l</p></footer>",
    "<div class=cookies>⓪%l</div><p>①%l</p><p>①%m</p><ul><li><a href=/z>⓪%m</a></li><li><a href=/y>⓪%m</a></li></ul><form>⓪%l</form>",
    "<p>①%l</p>",
    "<div><p>①%s</p><p>①%l</p></div>",
    "<body><div><div><p>①%m</p><p>①%m</p><p>①%m</p><p>①%s</p></div></div></body>",
    "<table><tr><td><a href=/a>⓪%s</a><br><a href=/b>%s</a><br><a href=/c>%s</a></td><td><h2>①%s</h2><p>①%l</p><p>①%m</p></td></tr></table><p>⓪Copyright %s</p>",
    "<div><a href=/>⓪%s</a></div><div><h1>①%s</h1><h2>①%s</h2><p>①%l</p><h2>①%s</h2><ol><li>①%m</li><li>①%m</li></ol></div><div><h4>⓪%s</h4><ul><li><a href=/1>⓪%m</a></li><li><a href=/2>⓪%m</a></li></ul></div>",
    "<nav><a href=/>⓪%s</a></nav><div class=ad>⓪%m</div><article><h1>①%s</h1><p>①<b>%s</b><br><p>①%l</p><p>①%s</p></article><footer>⓪&copy; %s</footer>",
    "<nav><p>⓪%l</p></nav><article><h1>①%s</h1><p>①%s</p></article><aside>⓪%l</aside>",
    "<div role=navigation><a href=/1>⓪%s</a><a href=/2>%s</a></div><div role=main><p>①%l</p><div>①%m</div></div><div role=contentinfo>⓪%m</div>",
    "<section><h1>①%s</h1><p>①%l</p><p>①%l</p></section><section><h2>⓪%s</h2><p><a href=/1>⓪%m</a></p><p><a href=/2>⓪%m</a></p></section>",
    "<main><h1>①%s</h1><p>①%l</p><ul><li><a href=/1>①%m</a> ①%l</li></ul><h2>⓪Leave a reply</h2><form>⓪%s</form><p>⓪%m</p></main>",
    "<div><div>①%l</div><div>①%m</div><div>①%l</div><div>①%l</div><div>①%m</div></div><div><a href=/n>⓪%s</a></div>",
    "<h1>①%s</h1><section><h2>①%s</h2><p>①%l</p><p>①%s</p></section><section><h2>①%s</h2><p>①%m</p></section><section><h2>①%s</h2><p>①%l</p></section><div>⓪%s</div>",
    "<div class=header><a href=/>⓪%s</a> <a href=/b>%s</a></div><div class=post><p>①%l</p><p>①%s</p></div><div class=related-posts><p>⓪%m</p></div><div class=ad-slot><p>⓪%l</p></div>",
]
LENGTHS = 6
_SAY = "this is how a page goes on about things that people read in whole sentences when they look for news of towns and rivers or of what was said there before".split()
_MARK = re.compile("[①⓪]")


def _filled(page: str, size: int) -> str:
    k = 0

    def say(m: re.Match) -> str:
        nonlocal k
        k += 1
        n = {"s": 1 + (k + 2 * size) % 6, "m": 9 + (3 * k + 4 * size) % 12, "l": 20 + (7 * k + 13 * size) % 67}[m[1]]
        return " ".join(_SAY[(5 * k + i) % len(_SAY)] for i in range(n)) + ("." if m[1] != "s" or k % 2 else "")

    return re.sub("%([sml])", say, page)


def labelled_rows(pages: list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of the labelled table's blocks."""
    xs, ys = [], []
    for page in pages:
        for size in range(LENGTHS):
            cut = blocks(_filled(page, size))
            ys += ["①" in b.text for b in cut]
            xs.append(measures(blocks(_MARK.sub("", _filled(page, size)))))
    return np.concatenate(xs), np.array(ys, int)


@dataclass
class Tree:
    """A binary decision tree in arrays; a leaf has feature -1."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    main: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.main[node]
            go = x[inner, f[inner]] <= self.value[node[inner]]
            node[inner] = np.where(go, self.left[node[inner]], self.right[node[inner]])


def gini(y: np.ndarray) -> float:
    return len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0


def best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float]:
    """(measure, value) of the split that lowers Gini impurity most, (-1, 0) if none does; ties go to
    the earlier measure and the smaller value."""
    best, out = 1e-9, (-1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        total = left[-1]
        a, b = left[:-1], total - left[:-1]
        impurity = 2 * a * (n - a) / n + 2 * b * (len(y) - n - b) / (len(y) - n)
        gain = np.where((v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least), gini(y) - impurity, -1.0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best + 1e-9:
            best, out = float(gain[k]), (f, float(v[k] + v[k + 1]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 1) -> Tree:
    """CART by Gini impurity."""
    nodes: list[list] = []

    def add(rows: np.ndarray, left: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, bool(y[rows].mean() >= 0.5)])
        f, v = best_split(x[rows], y[rows], least) if left and gini(y[rows]) > 0 else (-1, 0.0)
        if f >= 0:
            nodes[at][:2] = [f, v]
            nodes[at][2] = add(rows[x[rows, f] <= v], left - 1)
            nodes[at][3] = add(rows[x[rows, f] > v], left - 1)
        return at

    add(np.arange(len(y)), depth)
    cols = list(zip(*nodes))
    return Tree(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]))


@lru_cache(maxsize=1)
def tree() -> Tree:
    return grow(*labelled_rows())


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    x = np.concatenate([measures(b) for b in cut]) if cut else np.zeros((0, len(MEASURES)))
    keep = tree().predict(x).tolist() if len(x) else []
    out, at = [], 0
    for b in cut:
        out.append(" ".join(k.text for k, good in zip(b, keep[at : at + len(b)]) if good))
        at += len(b)
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all but the html by default) with `hb_text`."""
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    src = packed(pages, keep, ["hb_text"], html=F.col(f"`{html_col}`"))
    schema = T.StructType([src.schema["row"], T.StructField("hb_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in groups(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(main_texts(b.column(1).to_pylist()), pa.string())], names=["row", "hb_text"])

    return unpacked(src.mapInArrow(run, schema), "hb_text")
