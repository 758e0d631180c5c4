"""The rolling median over time-range parts, and the order of feeds."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from listing_watch.operators import feed, state

KIND = "alert string, id long, ts timestamp, price double, name string"
T0 = dt.datetime(2024, 1, 1)


def plain(rows, last, least):
    out, held = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0] or ""), r[2], r[1])):
        w = held.setdefault(r[0], [])
        seen = [p for p in w[-last:] if p is not None]
        out[r[1]] = statistics.median(seen) if len(seen) >= least else None
        w.append(r[3])
    return out


@pytest.mark.parametrize("parts, last", [(1, 60), (7, 60), (50, 5), (200, 3), (40, 60)])
def test_parts_change_nothing(spark, parts, last):
    r = random.Random(parts)
    name = lambda: r.choice(["hot"] * 8 + ["b", "c", None])
    rows = [(name(), i, T0 + dt.timedelta(minutes=r.randint(0, 300)), None if r.random() < 0.1 else float(r.randint(1, 99)), f"n{i}") for i in range(700)]
    d = spark.createDataFrame(rows, KIND).repartition(3)
    got = state.rolling_price_median(d, last=last, parts=parts)
    assert got.columns == ["alert", "id", "ts", "price", "name", "median"]
    found = got.collect()
    assert {x["id"]: x["median"] for x in found} == plain(rows, last, state.MIN_PRICES)
    assert {x["id"]: x["name"] for x in found} == {x[1]: x[4] for x in rows}


def test_no_task_sees_a_whole_alert(spark):
    d = spark.range(20_000).select(F.lit("hot").alias("alert"), "id", F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 97).cast("double").alias("price"))
    got = state.rolling_price_median(d, parts=16)
    # the shuffle before the last window is by part and alert
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan and "hashpartitioning(alert" in plan
    assert got.filter("median is null").count() == 4


def test_empty(spark):
    assert state.rolling_price_median(spark.createDataFrame([], KIND)).count() == 0


def test_feed_order_and_one_entry_an_id(spark):
    rows = [("x", "a", "borderline", 0, 2), ("x", "a", "match", 5, 2), ("y", "b", "match", 1, 2), ("y", "a", "borderline", 9, 2), ("z", "b", "match", 0, 2), ("old", "a", "match", 0, 1)]
    d = spark.createDataFrame(rows, "id string, alert string, status string, pos long, add_seq long")
    one = feed.first_entries(d)
    assert sorted((r["id"], r["alert"], r["status"]) for r in one.collect()) == [("old", "a", "match"), ("x", "a", "match"), ("y", "a", "borderline"), ("z", "b", "match")]
    assert [r["id"] for r in one.orderBy(*feed.feed_order()).collect()] == ["z", "y", "x", "old"]
