import duckdb
import pytest

import __spark_entry__ as entry
from listing_watch.plans import registry, views

SF = "/root/testdata/sf0.001"


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns == ["alert", "id", "status", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_what_is_not_there_is_left_out(monkeypatch):
    monkeypatch.setattr(entry, "_there", lambda module: False)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
    assert entry.find_spec("listing_watch.nowhere") is None


@pytest.mark.parametrize("name", ["parse_item_id", "term_hits", "two_phase_verdict", "flag_relists", "rolling_price_median", "suggest_excludes", "suggest_requires_single", "card_terms_japanese", "flatten_rules", "sql_functions", "watch_state", "learn_alert"])
def test_against_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(registry.ORACLE_SQL[name])
    cols, rows = want.columns, want.fetchall()
    got = [tuple(r) for r in registry.QUERIES[name](spark, SF).select(*cols).collect()]
    plain = lambda rs: sorted(repr([round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r]) for r in rs)
    assert plain(got) == plain(rows)


def test_plans(spark):
    plan = views.hits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    top = registry.QUERIES["search_listings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top
