import duckdb

from listing_watch.plans import registry
from listing_watch.sources import alerts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_texts_stay_as_sql_has_them(spark, tmp_path):
    texts = ["a\nb", "", "\n", "\nx", "plain"]
    rows = [(i, t, "en", "s" if i % 2 else "", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["normalize_listings"])
    cols, want = want.columns, sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.QUERIES["normalize_listings"](spark, str(tmp_path)).select(*cols).collect()) == want


def test_aliases(spark):
    raw = spark.createDataFrame([("", "m1234567", "", "s1"), ("x", None, "s2", "s3"), (None, None, None, None), ("y", None, None, "")], "id string, ref string, seller_id string, sellerId string")
    got = [(r["id"], r["seller_id"], r["description"], r["name"]) for r in alerts.normalize_listings(raw).collect()]
    assert sorted(got, key=repr) == sorted([("m1234567", "s1", None, ""), ("x", "s2", None, ""), (None, None, None, ""), ("y", "", None, "")], key=repr)
