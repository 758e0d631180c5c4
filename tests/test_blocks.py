from pyspark.sql import functions as F

from listing_watch.operators import blocks, hits, learn, refine, reports


def _texts(spark):
    rows = [("a", 1, "red robot", "big robot x1"), ("a", 2, "blue", "robots and x12"), ("a", 2, "robot", "red"), ("b", 3, "robot", None), (None, 4, "robot", "robot")]
    return hits.prepared(spark.createDataFrame(rows, "label_id string, id long, name string, description string"))


def test_counts_by_blocks_are_those_of_hits(spark, monkeypatch):
    terms = spark.createDataFrame([("a", x) for x in ("robot", "red", "x1", "bot", "none", "", "robots")] + [("b", "robot"), ("c", "red"), (None, "robot")], "label_id string, term_t string")
    p = _texts(spark)
    want = sorted(hits.hits_on_grams(p, terms, ["label_id"]).groupBy("label_id", "term_t").agg(F.count("*").alias("n"), F.count_if("in_title").alias("k")).collect())
    assert want and sorted(hits.hit_counts(p, terms, ["label_id"]).collect()) == want
    assert sorted(hits.hit_counts(p, terms, ["label_id"], most=1).collect()) == want  # large keys
    monkeypatch.setattr(blocks, "BLOCK", 20)  # several blocks of a key
    assert sorted(hits.hit_counts(p, terms, ["label_id"]).collect()) == want
    named = p.withColumn("id", F.col("id").cast("string"))
    rows = lambda d: sorted(tuple(r) for r in d.select("label_id", "id", "term_t", "in_title", "in_desc").collect())
    assert rows(hits.hits_within(named, terms, ["label_id"], most=1)) == rows(hits.hits_within(named, terms, ["label_id"]))


def test_nested_terms_by_automaton_and_by_substrings(spark):
    c = spark.createDataFrame([("a", x) for x in ("robot", "bot", "ro", "robots", "x")] + [("b", "bot"), ("b", "bots")], "label_id string, term_t string")
    want = sorted(learn._nested_by_substrings(c).collect())
    assert len(want) == 6 and sorted(learn.nested_terms(c).collect()) == want == sorted(learn.nested_terms(c, most=2).collect())


def test_corpus_counts_take_each_id_once(spark, monkeypatch):
    monkeypatch.setattr(hits, "FEW", 1)
    terms = spark.createDataFrame([("robot",), ("red",), ("x1",), ("none",)], "term_t string")
    want = {"robot": 4, "red": 2, "x1": 1, "none": 0}
    for most in (1, 100):
        assert {r["term_t"]: r["listings"] for r in hits.term_counts(_texts(spark), terms, most=most).collect()} == want


def test_redundant_terms_are_told_without_their_pairs(spark, monkeypatch):
    rows = [("a", x, n, g) for x, n, g in (("robot", 3, False), ("bot", 3, False), ("ro", 5, True), ("robots", 2, False), ("obo", 4, False), ("x", 9, False), ("zobo", 1, None))]
    rows += [("b", "bot", 2, False), ("b", "bots", 1, False), ("b", "otsb", 1, None), ("b", None, 1, False), ("b", "", 1, False), (None, "bot", 1, False), (None, "robot", 1, False)]
    c = spark.createDataFrame(rows, "label_id string, term_t string, df_all long, generic boolean")
    by_pairs = sorted(map(str, learn.drop_redundant(c, most=1).collect()))
    written, store = [], learn.stored
    monkeypatch.setattr(learn, "stored", lambda d, name: written.append(name) or store(d, name))
    assert sorted(map(str, learn.drop_redundant(c).collect())) == by_pairs and not written
    kept = {(r[0], r[1]) for r in learn.drop_redundant(c).collect()}
    assert ("a", "obo") in kept and ("a", "bot") not in kept and ("a", "robots") not in kept and (None, "bot") in kept and ("b", "otsb") in kept


def _cards(spark):
    rows = [("a", str(i), m, t) for i, (m, t) in enumerate([("confirmed", "redrobot"), ("confirmed", "redbot"), ("rejected", "bluerobots"), ("rejected", "robots"), (None, "bot"), ("other", "zzz"), (None, None)])]
    rows += [("b", "8", "rejected", "robot"), (None, "9", "rejected", "robot")]
    return spark.createDataFrame(rows, "alert string, id string, mark string, tt string")


def test_card_counts_in_blocks_are_those_of_the_automaton(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", x, x) for x in ("robot", "red", "bot", "zzz", "none", "o")] + [("b", "robot", "Robot"), ("c", "red", "red"), (None, "robot", "robot")], "alert string, tterm string, term string")
    c = _cards(spark)
    want = sorted(map(tuple, refine._spread(c, vocab).collect()))
    assert ("a", "robot", "robot", 1, 2, 0) in want and ("a", "zzz", "zzz", 0, 0, 0) in want
    assert sorted(map(tuple, refine._spread(c, vocab, 1, 1).collect())) == want  # alerts of many terms
    monkeypatch.setattr(refine, "_on_grams", None)
    assert sorted(map(tuple, refine._spread(c, vocab, 1).collect())) == want
    monkeypatch.setattr(blocks, "BLOCK", 10)  # several blocks of an alert
    assert sorted(map(tuple, refine._spread(c, vocab, 1).collect())) == want


def test_redundant_rows_by_automaton_and_by_substrings(spark):
    rows = [("a", x, n) for x, n in (("robot", 3), ("bot", 3), ("ro", 5), ("robots", 2), ("b", 1), ("zrobot", 4))] + [("b", "bot", 1), ("b", "bots", 1), (None, "bot", 1), (None, "bots", 1)]
    d = spark.createDataFrame(rows, "alert string, tterm string, count long")
    for shorter in (True, False):
        want = sorted(map(str, refine._less_redundant_by_substrings(d, shorter).collect()))
        assert sorted(map(str, refine.drop_redundant_rows(d, shorter).collect())) == want == sorted(map(str, refine.drop_redundant_rows(d, shorter, most=1).collect()))


def test_a_preview_drops_rows_before_its_shuffle(spark):
    d = spark.createDataFrame([("a", str(i), "match" if i % 2 else "borderline", float(i % 7), i, "red lamp", "a lamp") for i in range(80)], "alert string, id string, status string, score double, pos long, name string, description string")
    out = reports.preview_sample(d)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["status"], r["place"]) for r in out.collect()) == [("borderline", i) for i in range(1, 9)] + [("match", i) for i in range(1, 25)]
