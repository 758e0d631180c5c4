from pyspark.sql import functions as F

from listing_watch.operators import learn, refine, state
from listing_watch.operators.hits import prepared
from listing_watch.streaming import stream


def cards(spark):
    rows = [
        ("a", "1", "confirmed", 9.0, ["赤い城", "勇者"], ["赤い城", "勇者"], ["限定"], "赤い城勇者限定"),
        ("a", "2", "confirmed", 8.0, ["赤い城"], ["赤い城"], [], "赤い城"),
        ("a", "3", "rejected", 3.0, ["青い海", "勇者", "青い海岸"], ["青い海", "勇者", "青い海岸"], [], "青い海岸勇者"),
        ("a", "4", "rejected", 2.0, ["青い海"], ["青い海"], [], "青い海"),
        ("a", "5", None, 5.0, ["青い海"], ["青い海"], [], "青い海"),
        ("b", "6", "rejected", 4.0, ["words"], ["words"], [], "words"),
    ]
    return spark.createDataFrame(rows, "alert string, id string, mark string, score double, terms array<string>, tterms array<string>, generic array<string>, tt string")


def no_rules(spark):
    return spark.createDataFrame([("a", "signal", "勇者")], "alert string, kind string, term_t string")


def test_refine(spark):
    c, r = cards(spark), no_rules(spark)
    ex = refine.suggest_excludes(c, r)
    got = {(x["alert"], x["tterm"]): x for x in ex.collect()}
    assert set(got) == {("a", "青い海"), ("b", "words")}
    assert got["a", "青い海"]["count"] == 2 and got["a", "青い海"]["collateral"] == 1 and got["a", "青い海"]["all"]
    rq = refine.suggest_requires(c, r)
    assert [(x["alert"], x["tterm"]) for x in rq.collect()] == [("a", "赤い城")]
    p = spark.createDataFrame([("a", 4.0)], "alert string, min_score double")
    th = refine.suggest_threshold(c, p)
    assert [tuple(x) for x in th.collect()] == [("a", 5.5, 8.0, 3.0)]
    w = {x["alert"]: x for x in refine.suggest_warnings(c, ex, rq, th).collect()}
    assert w["b"]["nothing_kept"] and not w["a"]["nothing_found"]


def test_own_compound(spark):
    d = spark.createDataFrame([("城勇者",), ("勇者の",), ("夜勇者",), ("大夜勇者",)], "t string")
    got = [r[0] for r in d.select(refine.own_compound(F.col("t"), F.array(F.lit("勇者"), F.lit("城")))).collect()]
    assert got == [True, True, False, False]


def examples(spark):
    rows = [
        ("x", 0, 1, "i0", "勇者ロボ GX-01 赤い城", "光の勇者です"),
        ("x", 1, 1, "i1", "勇者ロボ GX-01", "赤い城もあります"),
        ("x", 2, 1, "i2", "GX-01 限定", "勇者ロボ"),
        ("x", 0, 0, "n0", "勇者ロボ 青い海", "なし"),
        ("x", 1, 0, "n1", "青い海", "勇者ロボ"),
    ]
    return spark.createDataFrame(rows, "label_id string, ex_ord long, polarity int, item_id string, name string, description string")


def test_learn_excludes(spark):
    p = prepared(examples(spark)).persist()
    got = learn.learn_excludes(p.filter("polarity = 1"), p.filter("polarity = 0")).collect()
    assert [r["surface"] for r in got] == ["青い海"]


def test_redundant_terms(spark):
    rows = [("x", t, df, False) for t, df in (("abc", 2), ("ab", 2), ("bc", 3), ("xabcx", 1), ("qq", 1))]
    d = spark.createDataFrame(rows, "label_id string, term_t string, df_all int, generic boolean")
    assert sorted(r["term_t"] for r in learn.drop_redundant(d).collect()) == ["bc", "qq"]


def test_seen_and_prices_are_capped(spark):
    seen = spark.createDataFrame([("a", str(i), i) for i in range(5)], "alert string, id string, pos long").withColumn("run_ts", F.to_timestamp(F.lit("2024-01-01")))
    new = spark.createDataFrame([("a", "3", 0), ("a", "9", 1)], "alert string, id string, pos int")
    got = state.record_seen(seen, new, F.to_timestamp(F.lit("2024-01-02")), keep=4)
    assert sorted(r["id"] for r in got.collect()) == ["0", "1", "3", "9"]
