import html
import random
import re
import time

import numpy as np
import pytest

from listing_watch.llm import html_blocks

LONG = "A paragraph with a good number of words in it, which is what an article's paragraphs have, and no links at all."
PAGES = {
    f"<div class='post-comments-enabled'><p>{LONG}</p><p>{LONG}</p></div>": f"{LONG} {LONG}",
    f"<div id=page class='has-sidebar'><div class=content><p>{LONG}</p><p>{LONG}</p></div></div>": f"{LONG} {LONG}",
    f"<section id=copyright-law><h1>On law</h1><p>{LONG}</p><p>{LONG}</p></section>": f"On law {LONG} {LONG}",
    f"<div><p>Short.</p><p>{LONG}</p></div>": f"Short. {LONG}",
    f"<div><p>{LONG}</p><p>{LONG}</p></div><div><h3>3 responses</h3><div>I liked it.</div><div>Me too. {LONG}</div></div>": f"{LONG} {LONG}",
    f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div>© 2020 The owner</div>": f"{LONG} {LONG}",
    f"<div class='site sidebar'><article><p>{LONG}</p></article></div>": LONG,
    f"<p title=\"a > b\">{LONG}<p data-x='<p>'>{LONG}": f"{LONG} {LONG}",
    f"<article><p>a &lt; b &amp; {LONG}\n\n  and\tmore <b>bo</b>ld</p><!-- no --><template><p>{LONG}</p></template></article><script>'<p>{LONG}'": f"a < b & {LONG} and more bold",
    f"<div hidden><p>{LONG}</p></div><article><h1>T</h1><p style='display: none'>{LONG}</p><p>{LONG}</article>": f"T {LONG}",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_blocks.main_texts([page]) == [PAGES[page]]


@pytest.mark.parametrize("piece", ["<p ", "<svg>", "<a href='x", '<p a="', "</div>", "<!--", "<script>", "<div class=ad>", "<p>a", "<"])
def test_time_grows_with_length_alone(piece):
    start = time.time()
    html_blocks.main_texts([piece * (600_000 // len(piece))])
    assert time.time() - start < 10


def test_five_megabytes_of_an_open_tag():
    start = time.time()
    assert html_blocks.main_texts(["<p " * 1_700_000]) == [""]
    assert time.time() - start < 5


def test_blocks_against_plain_cutting():
    """Pages of properly nested blocks, against a cut of the page at every tag that isn't inline."""
    r = random.Random(4)

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return "".join(r.choice(["one ", "two\n", "<b>x</b>", "&amp;", " <a href='/q'>li nk</a> "]) for _ in range(r.randint(0, 5)))
        tag = r.choice(["div", "section", "ul", "blockquote"])
        return f"<{tag}>" + "".join(make(depth - 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(300):
        page = make(4)
        cut = re.split(r"</?(?:div|section|ul|blockquote)>", page)
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", c))).strip() for c in cut]
        got = html_blocks.blocks(page)
        assert [b.text for b in got] == [p for p in plain if p]
        assert all(0 <= b.linked <= b.words == len(b.text.split(" ")) for b in got)


def plain_split(x, y, least):
    best, out = 1e-9, (-1, 0.0)
    impurity = lambda part: len(part) * 2 * part.mean() * (1 - part.mean()) if len(part) else 0.0
    for f in range(x.shape[1]):
        vals = np.unique(x[:, f])
        for v in (vals[1:] + vals[:-1]) / 2:
            a, b = y[x[:, f] <= v], y[x[:, f] > v]
            gain = impurity(y) - impurity(a) - impurity(b)
            if min(len(a), len(b)) >= least and gain > best + 1e-9:
                best, out = gain, (f, float(v))
    return out


def test_tree_growing_against_every_split():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for least in (1, 3):
            x, y = r.integers(0, 6, (n, 4)).astype(float), r.integers(0, 2, n)
            assert html_blocks.best_split(x, y, least) == pytest.approx(plain_split(x, y, least))
    x, y = html_blocks.labelled_rows()
    assert html_blocks.best_split(x, y, 2) == pytest.approx(plain_split(x, y, 2))
    assert (html_blocks.tree().predict(x) == y).mean() >= 0.98


def test_given_pages(spark):
    """Their articles are marked up as such, so plain cutting tells what is to be found."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    inline = lambda m: "" if m[1] in ("b", "i", "a", "em") else " "
    for p, got in zip(pages["html"], html_blocks.main_texts(list(pages["html"]))):
        article = re.search("<article>(.*?)</article>", p, re.S)[1]
        assert got == re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(\w+)[^>]*>", inline, article))).strip()


def test_clashing_columns(spark):
    names = ["page_id", "row", "html", "HB_TEXT", "hb_html", "none"]
    d = spark.createDataFrame([(1, "r", f"<article><p>{LONG}</article>", "old", "h", "n"), (2, "r", None, "old", "h", None)], ", ".join(f"{n} {'int' if n == 'page_id' else 'string'}" for n in names))
    got = html_blocks.extract(d).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "r", "h", "n", LONG), (2, "r", "h", None, "")] and got[0].__fields__ == ["page_id", "row", "hb_html", "none", "hb_text"]
    assert html_blocks.extract(d, keep=[]).columns == ["hb_text"] and html_blocks.extract(d, keep=[]).count() == 2
