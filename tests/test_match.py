from pyspark.sql import functions as F

from listing_watch.operators import feed, match, retrieve, state
from listing_watch.operators.hits import prepared, term_hits
from listing_watch.sources import alerts as al

ROWS = [
    ("m000001", "勇者ロボ カード GX-01", "光の勇者です", 1000.0),
    ("m000002", "勇者ロボ まとめ売り", "GX-01 ほか", 4000.0),
    ("m000003", "別の品", "勇者ロボの GX-01 付き。複製です", 900.0),
    ("m000004", "何か", "勇者ロボ", 800.0),
    ("m000005", "GX-011 勇者", "", None),
]


def listings(spark):
    d = spark.createDataFrame(ROWS, "id string, name string, description string, price double")
    return d.withColumns({"status": F.lit("on_sale"), "created": F.concat(F.lit("2024-01-0"), F.substring("id", 7, 1), F.lit("T00:00:00")), "category_id": F.lit(1), "seller_id": F.lit("s"), "thumbnail": F.lit(None).cast("string"), "condition_id": F.lit(2)})


def an_alert(spark, **more):
    a = {"name": "robo", "queries": ["勇者ロボ", "GX-01"], "match": {"require": [["勇者ロボ"]], "signals": {"GX-01": 3.0, "光の勇者": 1.0}, "exclude": [], "min_score": 3.0}} | more
    return al.alert_defaults(spark.createDataFrame([al._row(a, "t", "search_exclude")], al.ALERT))


def judged(spark, alerts, two_phase=True):
    p, rules, params = prepared(listings(spark)), al.flatten_rules(alerts), al.rule_params(alerts)
    c = p.select(F.lit("robo").alias("alert"), "id")
    f = match.two_phase_verdicts if two_phase else match.verdicts
    return {r["id"]: r for r in f(c, term_hits(p, rules), rules, params).collect()}


def test_two_phases(spark):
    got = judged(spark, an_alert(spark))
    assert got["m000001"]["status"] == "match" and got["m000001"]["score"] == 3.75 and got["m000001"]["hits"] == ["GX-01"]
    assert got["m000002"]["status"] == "match" and got["m000002"]["score"] == 3.0
    assert got["m000003"]["status"] == "reject" and got["m000003"]["excluded_by"] == "複製" and got["m000003"]["score"] == 0
    assert got["m000004"]["status"] == "reject" and got["m000004"]["n_missing"] == 0
    assert got["m000005"]["n_missing"] == 1 and got["m000005"]["hits"] == []


def test_one_phase_reads_all(spark):
    got = judged(spark, an_alert(spark), two_phase=False)
    assert got["m000001"]["score"] == 4.75 and got["m000001"]["hits"] == ["GX-01", "光の勇者"]


def test_rules_are_flattened(spark):
    a = an_alert(spark, presets=["no_graded", "no_repro"])
    rows = al.flatten_rules(a).collect()
    ex = [r["term_t"] for r in rows if r["kind"] == "exclude"]
    assert len(ex) == len(set(ex)) and "psa" in ex and "複製" in ex
    bare = an_alert(spark, match=None, queries=["good robot"])
    kinds = {(r["kind"], r["term_t"], r["weight"]) for r in al.flatten_rules(bare).collect() if r["kind"] != "exclude"}
    assert kinds == {("require", "goodrobot", None), ("signal", "goodrobot", 5.0)}
    p = al.rule_params(bare).first()
    assert (p["min_score"], p["scope"]) == (3.0, "title")


def test_files_are_loaded_and_checked(spark, tmp_path):
    import pytest

    (tmp_path / "a.json").write_text('{"alerts": [{"name": "x", "keyword": "robo", "match": {"require": ["one", ["a", "b"]], "signals": ["s"]}}]}')
    (tmp_path / "a.yaml").write_text("alerts:\n- name: y\n  queries: [q]\n  match: {signals: {k: 2}}\n")
    got = al.load_alerts(spark, str(tmp_path / "a.json"), str(tmp_path / "a.yaml"))
    rows = {r["name"]: r for r in al.alert_defaults(al.validate_alerts(got)).collect()}
    assert rows["x"]["queries"] == ["robo"] and rows["x"]["match"]["require"] == [["one"], ["a", "b"]] and rows["y"]["source"] == "yaml"
    assert al.load_alerts(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        al.validate_alerts(got.union(got))


def test_retrieval(spark):
    a = an_alert(spark, per_query_limit=2, price_max=5000, rejected_ids=["m000002"])
    m = retrieve.query_matches(prepared(listings(spark)), a)
    found = retrieve.search_listings(m, a)
    got = {(r["query_ord"], r["id"]): r["rank"] for r in found.collect()}
    assert got == {(0, "m000004"): 1, (0, "m000003"): 2, (1, "m000003"): 1, (1, "m000002"): 2}
    totals = {r["query_ord"]: r["total"] for r in retrieve.query_totals(m, a).collect()}
    assert totals == {0: 4, 1: 3}
    b = {r["query_ord"]: r for r in retrieve.query_breakdown(found, m, a).collect()}
    assert (b[0]["new_here"], b[1]["new_here"], b[1]["dismissed"]) == (2, 0, 1)
    assert [r["id"] for r in retrieve.pool_candidates(retrieve.drop_rejected(found, a)).orderBy("pos").collect()] == ["m000004", "m000003"]


def test_relists_and_deals(spark):
    m = spark.createDataFrame([("a", 0, "f1", 70.0), ("a", 1, "f1", 200.0), ("b", 0, "f2", 10.0)], "alert string, pos int, fp string, price double").withColumn("first_run", F.lit(False))
    known = spark.createDataFrame([("f2", "x")], "fp string, id string")
    got = {(r["alert"], r["pos"]): r["relist"] for r in state.flag_relists(m, known, ["alert", "pos"]).collect()}
    assert got == {("a", 0): False, ("a", 1): True, ("b", 0): True}
    prices = spark.createDataFrame([("a", p) for p in (100, 100, 100, 90)] + [("b", 1)], "alert string, price long")
    deals = {(r["alert"], r["pos"]): r["deal"] for r in state.flag_deals(m, state.price_median(prices)).collect()}
    assert deals == {("a", 0): True, ("a", 1): False, ("b", 0): None}


def test_feed_keeps_what_it_has(spark):
    f = spark.createDataFrame([("1", "match")], "id string, status string")
    e = spark.createDataFrame([("1", "new"), ("2", "new"), ("2", "new")], "id string, status string")
    assert sorted(tuple(r) for r in feed.merge_feed(f, e).collect()) == [("1", "match"), ("2", "new"), ("2", "new")]
