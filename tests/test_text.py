import random
import re

import pytest
from pyspark.sql import functions as F

from listing_watch.functions import scalars, terms, text

CODES = ["AB-C1", "ABC1", "A-BC1", "ＡＢ－Ｃ１"]


def one(spark, col, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return d.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("code", CODES)
def test_spellings_of_a_code_are_one(spark, code):
    assert one(spark, text.tight(F.col("a")), a=code) == "abc1"


def test_normal_forms(spark):
    assert one(spark, text.tight(F.col("a")), a="スーパー・ロボット café!") == "すーぱーろぼっとcaf"
    assert one(spark, text.spaced(F.col("a")), a="  ONE--PIECE カード  ") == "one piece かーど"
    assert one(spark, text.tight(F.col("a")), a=None) == ""


@pytest.mark.parametrize(
    "term, title, there",
    [
        ("ab12", "xab123", False),
        ("ab12", "x ab12 y", True),
        ("ab12", "ロボab12です", True),
        ("one", "one piece", True),
        ("abc1", "one piece ab-c1", False),
        ("robotics", "xroboticsy", True),
        ("", "anything", False),
    ],
)
def test_containment(spark, term, title, there):
    d = spark.createDataFrame([(term, title)], "term string, title string").withColumn("p", text.prep(F.col("title")))
    assert d.select(text.contains_term(text.tight(F.col("term")), F.col("p.t"), F.col("p.s")).alias("x")).first()["x"] is there


def test_terms_of_runs_compounds_and_phrases():
    got = terms.terms_of("光の勇者ロボ号 X-99 限定カード 商品 2024")
    assert "X-99" in got and "光の勇者" in got and "ロボ号" in got and "限定カード" in got
    assert "商品" not in got and "2024" not in got and "号" not in got
    assert "勇者ロボ" in got


def test_phrase_limits():
    assert not any("ましたので" in t for t in terms.terms_of("開始ましたので終了"))
    assert "城を求めて" in terms.terms_of("城を求めて")
    assert all(not t.endswith("を") for t in terms.terms_of("光の城を"))
    assert len(terms.terms_of("赤い車と青い空の下で" * 400)) <= 400


def test_trailing_hyphen_breaks_adjacency():
    assert "AB" in terms.terms_of("AB-ロボ") and "ABロボ" not in terms.terms_of("AB-ロボ")


def test_scalars(spark):
    ids = {"https://shop.example.com/item/m123?x=1": "m123", " m9 ": "m9", "": None, "https://shop.example.com/item/m7/": "m7"}
    for k, v in ids.items():
        assert one(spark, scalars.parse_item_id(F.col("a")), a=k) == v
    at = lambda x: one(spark, F.unix_timestamp(scalars.parse_listed_at(F.col("a"))), a=x)
    assert at("2024-01-01T09:00:00") == at("2024-01-01T00:00:00+00:00") == 1704067200
    assert at("soon") is None and at(None) is None


def test_fingerprint_ignores_small_price_changes(spark):
    d = spark.createDataFrame([("Card A", 1010.0, "s"), ("card-a", 1400.0, "s"), ("card a", 1600.0, "s"), ("card a", None, None)], "n string, p double, s string")
    fps = [r[0] for r in d.select(text.fingerprint(text.tight(F.col("n")), F.col("p"), F.col("s"))).collect()]
    assert fps[0] == fps[1] != fps[2] and len(set(fps)) == 3 and all(len(f) == 16 for f in fps)


def test_card_terms_are_in_the_text(spark):
    d = spark.createDataFrame([("超合金ロボ GX-01 限定", "光の勇者の新品です。カード付き")], "t string, d string")
    c = d.select(terms.card_terms(F.col("t"), F.col("d")).alias("c")).first()["c"]
    assert c["terms"] and len(c["terms"]) == len(c["tterms"]) and all(t in c["tt"] for t in c["tterms"])
    assert c["tterms"][0] == "gx01" and set(c["generic"]) <= set(c["tterms"])


def test_texts_are_taken_few_at_once(spark):
    import pyarrow as pa

    texts = pa.array(["ab", None, "c" * 30, "d", "", "e" * 9, "f"])
    parts = list(text.few_at_once(texts, 10))
    assert pa.concat_arrays(parts).equals(texts) and [len(p) for p in parts] == [2, 1, 3, 1]
    assert [len(p) for p in text.few_at_once(pa.array([], pa.string()), 10)] == [0]
    # results keep their rows where a batch comes in several slices
    d = spark.range(0, 9, 1, 1).select("id", F.concat(F.lit("ﾛﾎﾞ "), F.repeat(F.lit("word "), 60_000), F.col("id").cast("string"), F.lit("x")).alias("t"))
    got = d.select("id", F.element_at(terms.script_runs(F.col("t")), -1)["surface"].alias("last"), F.size(terms.extract_terms(F.col("t"))).alias("n"), F.substring(text.nfkc(F.col("t")), 1, 2).alias("k")).collect()
    assert [(r["last"], r["n"], r["k"]) for r in got] == [(f"{r['id']}x", 3, "ロボ") for r in got] and len(got) == 9


def test_stable_characters_are_never_changed_by_nfkc():
    import re
    import sys
    import unicodedata

    stable = [c for c in map(chr, range(sys.maxunicode + 1)) if re.match(f"[{text.STABLE}]", c)]
    # a character can join the one before it only where it is not the first of a decomposition
    later = {x for c in map(chr, range(sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and d[0] != "<" for x in d.split()[1:]}
    assert all(unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 and f"{ord(c):04X}" not in later for c in stable)
    assert "é" in stable and "ｶ" not in stable and "゙" not in stable


def test_short_classes_give_the_forms_of_the_whole_ones(spark):
    chars = [chr(c) for c in (*range(0x500), *range(0x2000, 0x2100), *range(0x2FF0, 0x3200), 0x4DFF, 0x4E00, 0x9FFF, 0xA000, 0xFF21, 0xFF71, 0x10400, 0x1F600)]
    rows = [(f"a{x}B {x}",) for x in chars] + [("",), (None,), ("Über–Straße ½ カード",)]
    d = spark.createDataFrame(rows, "x string")
    t = F.coalesce("x", F.lit(""))
    whole = [F.regexp_replace(t, f"[^{text.KEPT}]+", ""), F.trim(F.regexp_replace(t, f"[^{text.KEPT}]+", " ")), t.rlike(f"[^{text.STABLE}]")]
    each = text.nfkc_each([F.col("x"), F.lit("ｶﾞ")])
    for r in d.select(F.array(text.tight_of(t), text.spaced_of(t), text.is_odd(t).cast("string")).alias("a"), F.array(whole[0], whole[1], whole[2].cast("string")).alias("b"), F.array(*each).alias("c"), F.array(text.nfkc(F.col("x")), F.lit("ガ")).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]


def test_terms_of_one_script_are_the_runs(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(["ab", "C1", " ", "-", "_a", "é", "–x", "12", "Ａ", "½", ".", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(400)]
    fast = [terms.tight_terms(x) for x in texts]
    monkeypatch.setattr(terms, "_OTHER_RUN", re.compile(""))  # every text by the walk over runs
    assert [list(x.items()) for x in fast] == [list(terms.tight_terms(x).items()) for x in texts]


def test_lists_of_texts_go_through_python_some_at_a_time():
    import pyarrow as pa

    rows = [["ﬁ" * 200_000, None], None, ["x", "ﬁ" * 200_000], [], [None, "Ａ"], ["ﬁ" * 900_000, ""]] * 3
    for b in (pa.array(rows, pa.list_(pa.string())), pa.array([["y"], *rows], pa.list_(pa.string())).slice(1)):
        parts = list(text._nfkc_each.func(iter([b])))
        assert [y for x in parts for y in x.to_pylist()] == [x and [y and y.replace("ﬁ", "fi").replace("Ａ", "A") for y in x] for x in rows]
        assert len(parts) > 5
    assert [x.to_pylist() for x in text._nfkc_each.func(iter([pa.array([], pa.list_(pa.string()))]))] == [[]]
