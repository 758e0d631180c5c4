import random
import re

import pytest

from listing_watch.llm import html_blocks, lang_crf, pii_crf

LONG = "A paragraph with a good number of words in it, which is what an article's paragraphs have, and no links at all."
PAGES = {
    f"<article><h1>T &amp; U</h1><p>One&nbsp;two<p>{LONG}<br>three</article><footer>x y z</footer>": f"T & U One two {LONG} three",
    f"<nav><a href=/>Home</a></nav><main><p>{LONG}</p><aside>{LONG}</aside><div class='ad-box'>{LONG}</div></main>": LONG,
    f"<script>var a='<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><article><p>{LONG}</p><div id=comments><p>{LONG}</p></div></article>": LONG,
    f"<body class='page'><div class='cookie-banner'>{LONG}</div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><form><label>{LONG}</label></form></body>": f"Head {LONG} {LONG}",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_blocks.main_texts([page]) == [PAGES[page]]


def test_tree_knows_its_table():
    x, y = html_blocks.labelled_rows()
    assert (html_blocks.tree().predict(x) == y).all()


def test_broken_pages_and_rows(spark):
    odd = [None, "", "<", "<p", "text only", "<article><p>a<p>b", "</div></div><article>a</article></p>", "<a href='x>y</a>" * 50, "<div>" * 3000 + "x"]
    assert len(html_blocks.main_texts(odd)) == len(odd)
    d = spark.createDataFrame([(i, "u", p) for i, p in enumerate(odd)], "page_id int, url string, html string")
    assert html_blocks.extract(d).count() == len(odd) and html_blocks.extract(d.limit(0)).count() == 0


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii_crf.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii_crf.KINDS.index(s[0])))


@pytest.mark.parametrize("letters", ["1234.. -+@ab.()\n%", "12.256.0. ", "a@b.c+x@", "4111 1111-"])
def test_base_spans(letters):
    r = random.Random(letters)
    for _ in range(1500):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert pii_crf.base_spans(t) == plain_base(t)


def test_base_is_linear():
    assert pii_crf.base_spans("a" * 300_000) == [] and pii_crf.base_spans("1" * 300_000) == []
    assert pii_crf.base_spans("x" * 200_000 + "@b.c")[0][2] == 200_004


@pytest.mark.parametrize(
    "text, spans",
    [
        ("Mail tom@x.org or +1 (555) 555-0100 now", ["tom@x.org", "+1 (555) 555-0100"]),
        ("please call 415-555-0199 today", ["415-555-0199"]),
        ("write to anna (at) firma (dot) de.", ["anna (at) firma (dot) de"]),
        ("it was in 2019 that 300 of them left", []),
        ('token = "0641917ea4e9feb9cda83477b57ac265"', []),
        ("", []),
    ],
)
def test_spans(text, spans):
    assert [text[a:e] for _, a, e in pii_crf.find([text])[0][1]] == spans


def test_plain_words_are_outside():
    words = "the cat sat on the mat and she was at home with a dot of ink".split()
    assert set(pii_crf.model().tags([words])[0]) == {"O"}


@pytest.mark.parametrize(
    "text, spans",
    [
        ("reach Maria at maria dot lopez at gmail dot com", [("email", "maria dot lopez at gmail dot com")]),
        ("john_doe(at)mail.com", [("email", "john_doe(at)mail.com")]),
        ("my cell is 4155552671", [("phone", "4155552671")]),
        ("order number 415-555-2671", []),
        ("his card 4929.1234.5678.9012 expired", [("card", "4929.1234.5678.9012")]),
        ("ping 10[.]1[.]2[.]3", [("ip", "10[.]1[.]2[.]3")]),
        ("de de de de de at at at it it it", []),
        ("Of%%% the&&& erntwh.%%% at*** dot $$$ and### it", []),
    ],
)
def test_spans_of_all_kinds(text, spans):
    assert [(k, text[a:e]) for k, a, e in pii_crf.find([text])[0][1]] == spans


#: Lines in the manner of the labelled table, of other wording, with other names and numbers.
HELD_OUT = """
you may write %X under [email %x at %h dot %t] whenever
questions go to [email %x dot %x at %h dot %t] first
send the file to [email %x (at) %h (dot) %t] , not to me
his new address : [email %x[at]%h.%t]
[email %x_%x(at)%h.%t] is the one for complaints
she used [email %x.%x(at)%h.%t] then
call %X at [phone %3-%3-%4] tonight
the office phone is [phone (%3) %3-%4]
tel. [phone 0%2 %7] or fax [phone 0%2 %7]
her mobile [phone 0%3-%7] was off
text [phone %9%1] for the code
server [ip %o dot %o dot %o dot %o] is slow
we saw [ip %o[.]%o[.]%o[.]%o] in the log
the host [ip %o[.]%o[.]%o[.]%o] again
my visa [card %4.%4.%4.%4] was stolen
card [card %4 / %4 / %4 / %4] , valid until june
the mastercard [card %4_%4_%4_%4] of %X
order number %3-%3-%4 came late
your ticket number %3-%3-%4 is open
tracking number %9%1 says so
%X stayed at home and looked at a dot
version %1 dot %1 of the tool
in 19%2 they sold %4 cars and %3 boats
page %2 , table %1 , item %3
the parcel weighs %2.%1 kilos
from %1:%2 to %2:%2 on mondays
isbn 978-%1-%3-%5-%1 is out of print
key = "%5b%4f%6a%3" for now
the score was %2-%2 after %1 rounds
see %h.%t/%x for more of it
"""


def test_precision_and_recall_of_added_spans():
    lines = pii_crf.labelled_chains(pii_crf.filled(HELD_OUT, copies=5, seed=99))
    hit = found = due = 0
    for words, tags in lines:
        text, at, want = " ".join(words), 0, []
        for w, t in zip(words, tags):
            if t[0] == "B":
                want.append([t[2:], at, at + len(w)])
            elif t[0] == "I":
                want[-1][2] = at + len(w)
            at += len(w) + 1
        base, spans = pii_crf.find([text])[0]
        got = {s for s in spans if s not in base}
        due, found, hit = due + len(want), found + len(got), hit + len(got & set(map(tuple, want)))
    assert hit >= 0.95 * found and hit >= 0.9 * due and due > 80


def test_windows_decode_as_whole_texts():
    """Decoding within reach of words that are not plain gives the tags of whole chains."""
    m = pii_crf.model()
    r = random.Random(6)
    some = [w for line in pii_crf.filled(copies=1) for w in line.replace("[email", "").split()]
    for _ in range(150):
        words = [r.choice(some) if r.random() < 0.15 else r.choice(["Word", "and", "with,", "Things.", "goes"]) for _ in range(r.randint(1, 90))]
        tags = ["O"] * len(words)
        codes = m.code(words)
        windows = pii_crf._windows(codes, m.reach)
        for (lo, hi), got in zip(windows, m.decode([(m.pad(codes), lo, hi) for lo, hi in windows])):
            tags[lo:hi] = got
        assert tags == m.tags([words])[0]
        assert all(codes[i] <= len(pii_crf.PLAIN) for i, w in enumerate(words) if w in ("Word", "and", "with,", "Things.", "goes"))


def test_redaction_and_rows(spark):
    assert pii_crf.redact("a@b.cc x +1 555 555 0100", pii_crf.base_spans("a@b.cc x +1 555 555 0100")) == "<EMAIL> x <PHONE>"
    d = spark.createDataFrame([(1, "a@b.cc", "k"), (2, None, None), (2, "", "k")], "doc_id int, text string, pi_in string")
    got = pii_crf.scan(d, redacted=True).collect()
    assert [r["pi_text"] for r in got] == ["<EMAIL>", None, ""] and got[0]["pi_spans"][0]["end"] == 6
    assert pii_crf.scan(d.limit(0)).count() == 0
    assert [r["pi_in"] for r in got] == ["k", None, "k"]
    names = ["row", "text", "pi_base", "PI_TEXT", "none", "email"]
    odd = spark.createDataFrame([("r", "a@b.cc", "x", "y", "z", "w")], ", ".join(f"{n} string" for n in names))
    row = pii_crf.scan(odd, redacted=True).first()
    assert row.__fields__ == ["row", "none", "email", "pi_base", "pi_spans", "pi_text"] and tuple(row)[:3] == ("r", "z", "w") and row["pi_text"] == "<EMAIL>"


WORDS = {"en": "the and of with house water thing ing".split(), "de": "der und nicht mit haus wasser ding ung".split(), "es": "los y de con casa agua cosa ción".split()}


def lines(seed, n=300):
    r = random.Random(seed)
    return [(g, " ".join(r.choice(WORDS[g]) + r.choice(["", "", "er" if g == "de" else "s"]) for _ in range(r.randint(5, 20)))) for g in r.choices(list(WORDS), k=n)]


def test_language_of_texts_and_words():
    m = lang_crf.fit(lines(1))
    test = lines(2)
    got = m.predict([t for _, t in test])
    assert sum(g == p for (g, _), (p, _) in zip(test, got)) >= 0.97 * len(test)
    assert all(0 <= s <= 1 for _, s in got)
    mixed = m.label_words("the house and water der nicht wasser und 123")
    assert [k for _, k in mixed] == ["en"] * 4 + ["de"] * 4 + ["und"]
    assert m.predict(["", "123 !?", "the house"])[:2] == [("und", 0.0)] * 2
    assert lang_crf.fit([]) is None


def test_marginals_against_all_paths():
    import itertools

    import numpy as np

    from listing_watch.llm import crf

    rng = np.random.default_rng(1)
    emit, start, trans = rng.normal(size=(7, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = [4, 1, 2]
    m, log_z, _ = crf.marginals(emit, np.array(lengths), start, trans)
    best = crf.viterbi(emit, np.array(lengths), start, trans)
    at, total = 0, 0.0
    for n in lengths:
        p = {path: start[path[0]] + sum(emit[at + i, k] for i, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])) for path in itertools.product(range(3), repeat=n)}
        z = np.log(sum(np.exp(v) for v in p.values()))
        total += z
        for i in range(n):
            for k in range(3):
                assert abs(m[at + i, k] - sum(np.exp(v - z) for path, v in p.items() if path[i] == k)) < 1e-9
        assert tuple(best[at : at + n]) == max(p, key=p.get)
        at += n
    assert abs(log_z - total) < 1e-9


def test_learn_and_predict_rows(spark):
    rows = [(i, t, g, "x") for i, (g, t) in enumerate(lines(3))] + [(1000, None, "en", "x"), (1001, "42", None, "x"), (None, "the house", "en", "x")]
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string, lc_id string")
    got = lang_crf.learn_and_predict(d)
    by = {r["doc_id"]: r["lc_lang"] for r in got.collect()}
    assert by[1000] == by[1001] == "und" and by[None] == "en"
    assert sum(by[i] == g for i, (g, _) in enumerate(lines(3))) > 290
    assert lang_crf.learn_and_predict(d.limit(0)).count() == 0
    assert {r["lc_lang"] for r in lang_crf.learn_and_predict(d.withColumn("lang", d.lang.substr(9, 1)).filter("lang is null")).collect()} <= {"und"}


def test_long_words_are_read_whole():
    a, b = "的一是在不了有和人这中大为上个国我以要他", "のはをにがでとれさあいうえおかきくけこす"
    r = random.Random(8)
    text = lambda s, n: "".join(r.choice(s) for _ in range(n))
    m = lang_crf.fit([("zh", text(a, 200)) for _ in range(40)] + [("ja", text(b, 200)) for _ in range(40)])
    assert [x for x, _ in m.predict([text(b, 40) + text(a, 400), text(a, 40) + text(b, 400), "7" * 50 + text(a, 30), "7" * 90])] == ["zh", "ja", "zh", "und"]
    got = m.label_words("7" * 50 + text(b, 30) + " 55 " + text(a, 100))
    assert [k for _, k in got] == ["ja", "und", "zh"] and len(got[2][0]) == 100


def test_long_and_short_lines_are_learned(spark):
    r = random.Random(9)
    words = {"aa": ["lopa", "mirat", "sodel"], "bb": ["quexi", "zwov", "kjuh"], "cc": ["的一是", "在不了", "有和人"], "dd": ["þæð", "ðøþ"]}
    line = {"aa": lambda: " ".join(r.choices(words["aa"], k=900)), "bb": lambda: " ".join(r.choices(words["bb"], k=900)), "cc": lambda: "".join(r.choices(words["cc"], k=1500)), "dd": lambda: " ".join(r.choices(words["dd"], k=2)) + "\n" + "7" * 30}
    rows = [(i, line[k](), k) for i, k in enumerate(["aa", "bb", "cc", "dd"] * 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_crf.sample_lines(d, "text", "lang", "doc_id")
    assert {a for a, _ in got} == set(words) and all(0 < len(x) <= lang_crf.LINE_CHARS for _, x in got)
    assert all(w in words[a] for a, x in got if a in ("aa", "bb") for w in x.split())
    by = {x["doc_id"]: x["lc_lang"] for x in lang_crf.learn_and_predict(d).collect()}
    assert all(by[i] == k for i, _, k in rows)
