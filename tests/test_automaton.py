"""Many terms in many texts: the automaton against the gram join and against plain tests."""

import random

import pytest
from pyspark.sql import functions as F

from listing_watch.operators import automaton, hits, learn, refine

WORDS = ["ab", "ab12", "x1", "abcabcab", "かな", "かなかな", "字ab", "らんぷ", "1", "か", "lamp", "zzz", "caféau"]


def listings(spark, n=120):
    r = random.Random(7)
    piece = lambda: r.choice(["ab", "AB-12", "x1", "abcabcab", "カナ", "かな", "字", "ﾗﾝﾌﾟ", " ", "-", "1", "café", "lamp"])
    text = lambda k: "".join(piece() for _ in range(r.randint(0, k)))
    rows = [(f"m{i % 90}", text(6), None if i % 11 == 0 else text(20), str(i % 4) if i % 13 else None) for i in range(n)]
    return hits.prepared(spark.createDataFrame(rows, "id string, name string, description string, label_id string"))


def rows_of(d):
    return sorted(repr(tuple(r)) for r in d.collect())


@pytest.mark.parametrize("keys", [[], ["label_id"]])
def test_both_ways_are_equal(spark, keys):
    p = listings(spark)
    terms = spark.createDataFrame([(str(i % 4) if i % 5 else None, w) for i, w in enumerate(WORDS * 4)] + [("1", ""), ("2", None)], "label_id string, term_t string")
    one, two = hits.hits_within(p, terms, keys), hits.hits_within(p, terms, keys, most=3)
    assert automaton.few_enough(terms, keys, 3) is None and automaton.few_enough(terms, keys) is not None
    assert rows_of(one) == rows_of(two) and one.count() > 50
    if not keys:
        assert rows_of(one) == rows_of(hits.term_hits(p, terms.filter("term_t is not null")))


def test_bounds(spark):
    terms = spark.createDataFrame([("abc",), ("abc",), ("defgh",)], "term_t string")
    assert automaton.few_enough(terms, []) == [("abc",), ("defgh",)]
    assert automaton.few_enough(terms, [], most=1) is None and automaton.few_enough(terms, [], chars=7) is None
    assert automaton.few_enough(terms.limit(0), []) == []
    assert hits.hits_within(listings(spark, 5), terms.limit(0), []).count() == 0


def test_substrings_without_the_guard():
    f = automaton.Finder([("a", "ab"), ("a", "b12"), ("b", "ab")], guard=False)
    assert f.terms(("a",), "xab12", "") == {"ab", "b12"} and f.terms(("b",), "xab12", "") == {"ab"} and f.terms(("c",), "xab12", "") == set()
    g = automaton.Finder([("ab",), ("b12",)], guard=True)
    assert g.terms((), "xab12", " xab12 ") == set() and g.terms((), "xab", " x ab ") == {"ab"} and g.terms((), "字b12", " 字b12 ") == {"b12"}


def test_cards_by_both_ways(spark):
    r = random.Random(9)
    word = lambda: r.choice(["red", "blue", "lamp", "la", "amp", "x1", "セット"])
    rows = [(str(i % 3), str(i), r.choice(["confirmed", "rejected", None]), [word() for _ in range(5)]) for i in range(60)]
    d = spark.createDataFrame(rows + rows[:4], "alert string, id string, mark string, terms array<string>")
    d = d.withColumns({"tterms": F.col("terms"), "tt": F.array_join("terms", "")})
    vocab = refine.card_vocab(d)
    assert rows_of(refine._spread(d, vocab)) == rows_of(refine._spread(d, vocab, most=2))


def plain_picks(rows, k=3):
    out = []
    for r in sorted(rows, key=lambda r: (-r["df_title"], -r["rank"], -len(r["term_t"]), r["first_seen"], r["surface"], r["term_t"])):
        if len(out) < k and not any(r["term_t"] in x or x in r["term_t"] for x in out):
            out.append(r["term_t"])
    return out


def test_required_terms_are_the_greedy_ones(spark):
    r = random.Random(3)
    rows = []
    for label in ("one", "two", "nested"):
        for i in range(2000 if label == "nested" else 60):
            t = "q" * (i % 23 + 1) if label == "nested" else "".join(r.choice("abc") for _ in range(r.randint(2, 6)))
            rows.append({"label_id": label, "term_t": t, "surface": t.upper(), "df_all": 3, "df_title": r.randint(0, 3), "n": 3 if i % 9 else 4, "generic": i % 17 == 0, "rank": r.random(), "first_seen": i})
    d = spark.createDataFrame(rows, "label_id string, term_t string, surface string, df_all long, df_title long, n long, generic boolean, rank double, first_seen long")
    got = {x["label_id"]: [t.lower() for t in x["terms"]] for x in learn.learn_require(d).collect()}
    fine = [x for x in rows if x["n"] == 3 and not x["generic"]]
    assert got == {label: plain_picks([x for x in fine if x["label_id"] == label]) for label in ("one", "two", "nested")}
    assert learn.learn_require(d.limit(0)).count() == 0
