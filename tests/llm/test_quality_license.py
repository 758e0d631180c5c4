import re
from collections import Counter

import pytest

from listing_watch.llm import license_scan, weak_quality

TEXTS = [
    None,
    "",
    " \n\t",
    "one two three",
    "a b c a b c a b c",
    "x y\nx y\n\nz\nx y",
    "a b a b a b a c\x0bd # * | <>&%$",
    ("The quick fox ran. It was late.\n" * 3) + "And more words of this kind follow here.",
    "w " * 200,
    "é ü ñ\né ü ñ",
]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    inside = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_counts(spark):
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id int, text string, wq_x int")
    names = ["wq_n_words", "wq_word_chars", "wq_n_symbols", "wq_n_dup_lines", "wq_n_repeat_words"]
    rows = weak_quality.measures(d).collect()
    assert all(r["wq_x"] == r["doc_id"] for r in rows)
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in rows}
    assert got == {i: counts(t) for i, t in enumerate(TEXTS)}


def corpus(spark):
    good = [" ".join(f"word{(i * 7 + k * k) % 997}" + ("." if k % 9 == 8 else "") for k in range(90)) + "." for i in range(60)]
    bad = [" ".join(f"sign{(i * 5 + k * k) % 991}" + "###"[: 1 + k % 3] for k in range(90)) for i in range(12)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + TEXTS)], "doc_id int, text string")


def test_verdicts_and_native_plan(spark):
    d = weak_quality.judge(corpus(spark))
    kept = {r["doc_id"] for r in d.filter("wq_kept").collect()}
    assert kept == set(range(60))
    assert "Python" not in d._jdf.queryExecution().toString() and "Arrow" not in d._jdf.queryExecution().toString()
    assert weak_quality.keep_good(corpus(spark)).columns == ["doc_id", "text"]
    assert weak_quality.keep_good(corpus(spark).limit(0)).count() == 0


def plain_em(rows, rules, rounds, tolerance):
    """The same EM in plain Python over {pattern: count}."""
    import math

    wq = weak_quality
    post = lambda p: 1 / (1 + math.exp(wq.START * len(rules) - sum(p)))
    model = {}
    for _ in range(rounds):
        n, g = sum(rows.values()), sum(c * post(p) for p, c in rows.items())
        last, model = model, {"prior": (g + wq.PRIOR_GOOD * wq.PRIOR_DOCS) / (n + wq.PRIOR_DOCS), "good": {}, "poor": {}}
        for j, r in enumerate(rules):
            for side, size in (("good", g), ("poor", n - g)):
                model[side][r] = {}
                for v in (-1, 0, 1):
                    s = sum(c * (post(p) if side == "good" else 1 - post(p)) for p, c in rows.items() if p[j] == v)
                    model[side][r][v] = (s + wq.PRIOR_DOCS * wq.BELIEF[side][v]) / (size + wq.PRIOR_DOCS)
        m = model
        post = lambda p, m=m: 1 / (1 + math.exp(-math.log(m["prior"] / (1 - m["prior"])) - sum(math.log(m["good"][r][v] / m["poor"][r][v]) for r, v in zip(rules, p))))
        if last and max([abs(m["prior"] - last["prior"])] + [abs(m[s][r][v] - last[s][r][v]) for s in ("good", "poor") for r in rules for v in (-1, 0, 1)]) <= tolerance:
            break
    return model


@pytest.mark.parametrize("rounds, tolerance", [(5, 0.0), (100, 1e-4)])
def test_em_against_plain_python(spark, rounds, tolerance):
    rules = ["a", "b", "c"]
    rows = {(0, 0, 1): 50, (0, 0, 0): 9, (-1, 0, 0): 6, (-1, -1, 1): 3, (0, -1, 1): 2}
    d = spark.createDataFrame([p for p, c in rows.items() for _ in range(c)], "v_a int, v_b int, v_c int")
    got, want = weak_quality.fit(d, rules, rounds, tolerance), plain_em(rows, rules, rounds, tolerance)
    assert got["prior"] == pytest.approx(want["prior"])
    for side in ("good", "poor"):
        for r in rules:
            assert got[side][r] == pytest.approx(want[side][r])


def test_a_rule_is_believed_as_far_as_it_is_borne_out(spark):
    """A rule that agrees with the others gains weight with the corpus; one that votes at random
    has none, whatever was believed of either before."""
    import random

    r = random.Random(2)
    rows = []
    for i in range(3000):
        poor = i % 10 == 0
        true = [(-1 if poor else 1) if r.random() < 0.95 else 0 for _ in range(3)]
        rows.append((*true, r.choice([-1, 0, 1])))
    d = spark.createDataFrame(rows, "v_a int, v_b int, v_c int, v_coin int")
    m = weak_quality.fit(d, ["a", "b", "c", "coin"])
    gain = lambda rule, v: m["good"][rule][v] / m["poor"][rule][v]
    assert all(gain(x, -1) < 0.02 and gain(x, 1) > 20 for x in "abc")
    assert all(0.7 < gain("coin", v) < 1.4 for v in (-1, 0, 1))
    assert m["prior"] == pytest.approx(0.9, abs=0.02)


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id", "left")
    rows = weak_quality.judge(d).filter("quality is not null and not wq_base_failed").collect()
    poor, good = ([r["wq_kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    assert sum(poor) <= 0.1 * len(poor) and sum(good) >= 0.98 * len(good) and len(poor) > 20


def test_clashing_columns(spark):
    """An extra column of every inner or made name comes back as it was, or gives way to what is made."""
    made = [f"wq_{m}" for m in [*weak_quality.MEASURES, "base_failed", "posterior", "kept"]]
    inner = [*weak_quality.MEASURES, "row", "t", "w", "x", "h", "s", "p", "lines", "wq_x", "doc", "none", "bigrams", "found", "ls_found", "ls_bigrams", "v_symbols", "q", "k"]
    d = spark.createDataFrame([(TEXTS[7], *[f"{n}!" for n in inner + made + ["LS_DICE"]])], ", ".join(f"`{n}` string" for n in ["text", *inner, *made, "LS_DICE"]))
    r = weak_quality.judge(d).first()
    assert all(r[n] == f"{n}!" for n in inner + ["LS_DICE"]) and r["wq_n_words"] == counts(TEXTS[7])[0] and r["wq_kept"] is False
    assert len(set(r.__fields__)) == len(r.__fields__)
    assert weak_quality.keep_good(d).columns == d.columns
    got = license_scan.scan(d).first()
    assert all(got[n] == f"{n}!" for n in inner + made) and got["ls_dice"] is None and len(set(got.__fields__)) == len(got.__fields__)


def plain_scan(text):
    t = license_scan.TEMPLATES
    units = (text or "").split("\n") + [b for b in re.split(r"\n[ \t\r]*\n", text or "") if "\n" in b]
    best, n = None, 0
    for u in units:
        w = license_scan._words(u)
        b = {f"{x} {y}" for x, y in zip(w, w[1:])}
        found = []
        for name, own in license_scan.template_bigrams(t).items():
            both = len(b & set(own))
            if b and 200 * both >= license_scan.THRESHOLD * (len(b) + len(own)):
                found.append((-2 * both / (len(b) + len(own)), name))
        if found:
            n += 1
            best = min([*found, best] if best else found)
    return (best[1], pytest.approx(-best[0]), n) if best else (None, None, 0)


def test_license_scan_loses_nothing(spark):
    t = list(license_scan.TEMPLATES.values())
    texts = [*TEXTS, *t, *[x.upper().replace(" ", "\n", 2) for x in t], *[" ".join(x.split()[:-1]) for x in t], "Licensed under nothing", "some text\n" + t[0] + "\nmore\n\n" + t[-1], t[3] + "\n" + t[3]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = license_scan.scan(d)
    got = {r["doc_id"]: (r["ls_license"], r["ls_dice"], r["ls_matches"]) for r in out.collect()}
    for i, x in enumerate(texts):
        assert got[i] == plain_scan(x), x
    assert license_scan.scan(d.limit(0)).count() == 0
