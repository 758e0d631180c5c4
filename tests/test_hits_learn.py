"""Terms in listings by both ways, and rules learned from examples."""

import random

import pytest
from pyspark.sql import functions as F

from listing_watch.functions.text import contains_literal, contains_term, prep
from listing_watch.operators import hits, learn, match, refine

LISTING = "id string, name string, description string"


def plain_contains(term, t, s):
    if not term or term not in t:
        return False
    if len(term) > 6 or not all(c.isascii() and c.isalnum() for c in term):
        return True
    edge = lambda x, i: not (0 <= i < len(x)) or not (x[i].isascii() and x[i].isalnum())
    return any(x.startswith(term, i) and edge(x, i - 1) and edge(x, i + len(term)) for x in (t, s) for i in range(len(x)))


def test_containment_against_plain_python(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["ab", "c", "1", " ", "か", "カ", "字", "e", "-"]) for _ in range(r.randint(0, 14))) for _ in range(60)]
    terms = ["", "a", "ab", "c1", "abc1", "か", "字ab", "abcabcab", "1"]
    d = spark.createDataFrame([(x,) for x in texts], "x string").select(prep(F.col("x")).alias("p"))
    cols = [f(F.lit(w) if f is contains_term else w, F.col("p.t"), F.col("p.s")).alias(f"{f.__name__}_{k}") for k, w in enumerate(terms) for f in (contains_term, contains_literal)]
    for row in d.select("p.t", "p.s", *cols).collect():
        for k, w in enumerate(terms):
            want = plain_contains(w, row["t"], row["s"])
            assert row[f"contains_term_{k}"] == row[f"contains_literal_{k}"] == want, (w, row["t"], row["s"])


@pytest.fixture(scope="module")
def listings(spark):
    rows = [("a", "Red lamp C2", "a lamp of 1970"), ("a", "Red lamp C2", "a lamp of 1970"), ("b", "Blue chair", None), ("c", None, "red chairs, C2 and more"), ("b", "ランプ C2", ""), (None, "lamp", "x")]
    return hits.prepared(spark.createDataFrame(rows, LISTING))


def test_both_ways_give_one_row_for_each_id_and_term(spark, listings):
    terms = spark.createDataFrame([(t,) for t in ["lamp", "c2", "chair", "らんぷ", "red", "r", "", "1970", "none"] * 2], "term_t string")
    rows = lambda d: sorted((str(r["id"]), r["term_t"], r["in_title"], r["in_desc"]) for r in d.collect())
    few, many = hits.term_hits(listings, terms), hits.term_hits(listings, terms, few=2)
    assert rows(few) == rows(many)
    assert ("a", "lamp", True, True) in rows(few) and ("b", "らんぷ", True, False) in rows(few) and len(rows(few)) == len(set(x[:2] for x in rows(few)))
    counts = {r["term_t"]: r["listings"] for r in hits.term_counts(listings, terms).collect()}
    assert counts["c2"] == 3 and counts["none"] == 0 and counts["lamp"] == 2
    assert hits.term_hits(listings.limit(0), terms).count() == hits.term_hits(listings, terms.limit(0)).count() == 0


def test_a_repeated_listing_scores_as_its_equal(spark, listings):
    rules = spark.createDataFrame([("x", "signal", None, 0, "lamp", "lamp", 5.0)], "alert string, kind string, grp int, ord int, term string, term_t string, weight double")
    params = spark.createDataFrame([("x", 6.0, 0.55, "full")], "alert string, min_score double, borderline_ratio double, scope string")
    judged = match.verdicts(spark.createDataFrame([("x", "a")], "alert string, id string"), hits.term_hits(listings, rules), rules, params)
    assert [(r["score"], r["hits"]) for r in judged.collect()] == [(6.25, ["lamp"])]


def test_terms_within_groups(spark, listings):
    p = listings.withColumn("label_id", F.when(F.col("id") == "a", "one").otherwise("two"))
    terms = spark.createDataFrame([("one", "lamp"), ("two", "c2"), ("three", "lamp")], "label_id string, term_t string")
    got = sorted((r["label_id"], r["id"], r["term_t"]) for r in hits.hits_within(p, terms, ["label_id"]).collect())
    assert got == [("one", "a", "lamp"), ("two", "b", "c2"), ("two", "c", "c2")]


EXAMPLES = [
    # an item under four wordings, and three listings that are not it
    ("k", 0, 1, "m000001", "星空ランプ ブルー XR7 展示品", "星空ランプのXR7です。動きます。"),
    ("k", 1, 1, "m000002", "【レア】XR-7 星空ランプ", "青い星空ランプ、箱あり。"),
    ("k", 2, 1, "m000003", "星空ランプ XR7 ブルー", "昔の星空ランプです。XR7。"),
    ("k", 3, 1, "m000004", "照明 星空ランプ (XR7)", "部屋用の星空ランプ。"),
    ("k", 4, 0, "m000005", "月夜ランプ XR8 ブルー", "XR7ではありません。複製品。"),
    ("k", 5, 0, "m000006", "ランプの傘 複製品", "傘だけの複製品です。"),
    ("k", 6, 0, "m000007", "星空ポスター", "紙の複製品。"),
]


@pytest.fixture(scope="module")
def learned(spark):
    e = spark.createDataFrame(EXAMPLES, "label_id string, ex_ord int, polarity int, item_id string, name string, description string")
    corpus = hits.prepared(spark.createDataFrame([(str(i), f"ランプ {i}", "星空" if i % 5 == 0 else "棚") for i in range(60)], LISTING))
    return e, learn.learn_alerts(e, corpus)


def test_learned_rules_tell_the_examples_apart(learned):
    e, parts = learned
    judged = {r["ex_ord"]: (r["score"], r["excluded_by"]) for r in parts["judged"].collect()}
    least = parts["threshold"].first()["min_score"]
    assert all(judged[i][0] >= least for i in range(4)) and least >= 3.0
    assert all(judged[i][0] < least or judged[i][1] for i in judged if i > 3)
    weights = {r["term_t"]: r["weight"] for r in parts["signals"].collect()}
    assert "星空らんぷ" in weights
    assert {r["term_t"] for r in parts["excludes"].collect()} == {"複製品"}
    # a code ranks above a word that as many titles have
    assert [r["terms"] for r in parts["require"].collect()][0][:2] == ["XR7", "星空ランプ"]


def test_learned_queries_reach_every_example(learned):
    _, parts = learned
    q = parts["queries"].orderBy("ord").collect()
    assert [r["ord"] for r in q] == list(range(len(q))) and 1 <= len(q) <= learn.MAX_QUERIES
    assert [(r["query"], r["origin"]) for r in q[:2]] == [("XR7", "rare"), ("星空ランプ", "rare")]
    steps = ["rare", "title", "pair", "code"]
    assert [steps.index(r["origin"]) for r in q] == sorted(steps.index(r["origin"]) for r in q)
    assert {r["ex_ord"]: r["reach"] for r in parts["coverage"].collect()} == dict.fromkeys(range(4), "title")


def test_learned_alert_row(learned):
    e, parts = learned
    row = learn.learned_alert(parts, e).first()
    assert row["name"] == "k" and row["learned_from"] == ["m000001", "m000002", "m000003", "m000004"] and len(row["queries"]) >= 1
    assert row["match"]["min_score"] == parts["threshold"].first()["min_score"]


def test_build_queries_order_and_nesting(spark):
    first = lambda i: (0, 0, i)
    cols = "label_id string, term_t string, surface string, rank double, df_all int, df_title int, n int, idf double, generic boolean, listings long, first_seen struct<ex_ord:int,p:int,i:int>"
    rows = [("k", t, t.upper(), rank, 2, 1, 2, idf, g, n, first(i)) for i, (t, rank, idf, g, n) in enumerate([("alpha", 9.0, 2.0, False, 9000), ("beta", 8.0, 1.0, False, 100), ("alp", 7.0, 3.0, False, 9000), ("x9y", 6.0, 2.5, False, 9000), ("wide", 5.0, 0.3, True, 5)])]
    c = spark.createDataFrame(rows, cols)
    e = spark.createDataFrame([("k", 0, "alpha beta")], "label_id string, ex_ord int, name string")
    got = [(r["query"], r["origin"]) for r in learn.build_queries(c, c, e).orderBy("ord").collect()]
    # the title's own pair comes before the equal pair of shared terms; alpha and alp are nested
    assert got == [("BETA", "rare"), ("ALPHA BETA", "title"), ("ALPHA X9Y", "pair"), ("BETA ALP", "pair"), ("BETA X9Y", "pair"), ("ALP X9Y", "pair")]


def test_rule_tights(spark):
    rows = [("a", "require", 0, 0, "x", "x1", None), ("a", "require", 0, 1, "y", "y1", None), ("a", "require", 1, 0, "z", "z1", None), ("a", "signal", None, 0, "s", "s1", 1.0), ("a", "signal", None, 1, "t", "t1", 2.0), ("a", "signal", None, 2, "S", "s1", 3.0), ("b", "exclude", None, 0, "e", "e1", None)]
    rules = spark.createDataFrame(rows, "alert string, kind string, grp int, ord int, term string, term_t string, weight double")
    got = {r["alert"]: (r["require"], r["signals"], r["exclude"]) for r in refine.rule_tights(rules).collect()}
    assert got == {"a": ([["x1", "y1"], ["z1"]], {"t1": 2.0, "s1": 3.0}, []), "b": ([], {}, ["e1"])}


def test_examples_meet_the_rules_of_their_own_label(spark, monkeypatch):
    e = spark.createDataFrame([(f"l{i}", j, 1, str(j), "red lamp", "") for i in range(8) for j in range(2)], "label_id string, ex_ord int, polarity int, item_id string, name string, description string")
    rules = spark.createDataFrame([(f"l{i}", "signal", None, 0, "lamp", "lamp", 4.0 + i) for i in range(8)], "alert string, kind string, grp int, ord int, term string, term_t string, weight double")
    params = rules.select("alert", F.lit(4.0).alias("min_score"), F.lit(0.55).alias("borderline_ratio"), F.lit("full").alias("scope"))
    made, join = [], match.rule_hits
    monkeypatch.setattr(match, "rule_hits", lambda *a: made.append(join(*a)) or made[-1])
    got = {(r["label_id"], r["ex_ord"]): r["score"] for r in learn.judge_examples(hits.prepared(e), rules, params).collect()}
    assert got == {(f"l{i}", j): 1.25 * (4 + i) for i in range(8) for j in range(2)}
    # a row for each hit, not one for each label that has the term
    assert [d.count() for d in made] == [16]
