import datetime as dt
import statistics
import time

import pytest
from pyspark.sql import functions as F

from listing_watch.plans import views, watch
from listing_watch.streaming import stream

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_parts(spark):
    """Each part of a stream's state costs files and a commit in every batch."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def rows_of(spark, out, name, at, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(at / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def files(spark, at, schema, *batches):
    """A stream that gets each of the batches, as one file, in turn."""
    d = [spark.createDataFrame(b, schema).coalesce(1) for b in batches]
    for x in d:
        x.write.mode("append").parquet(str(at))
        time.sleep(0.05)  # files are taken in order of their time
    return spark.readStream.schema(d[0].schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def plain(df, *drop):
    return sorted(repr(tuple(sorted(r.asDict().items()))) for r in df.drop(*drop).collect())


@pytest.fixture(scope="module")
def arrivals(spark):
    """The given documents as listings that arrive in two lots, some of the first again in the second."""
    d = views.listings(spark, SF)
    n = F.substring("id", 2, 8).cast("long")
    first = d.filter(n % 3 != 2).withColumn("arrived_at", F.to_timestamp(F.lit("2024-03-01 00:00:00")))
    second = d.filter((n % 3 == 2) | (n % 10 == 0)).withColumn("arrived_at", F.to_timestamp(F.lit("2024-03-01 12:00:00")))
    return first, second


def test_stream_of_two_batches_is_two_runs(spark, tmp_path, arrivals):
    first, second = arrivals
    alerts = views.alerts(spark)
    state, want = watch.empty_state(spark), []
    for number, lot in enumerate((first, second)):
        now = F.to_timestamp(F.lit(f"2024-03-01 {12 * number:02d}:00:00"))
        state = watch.watch_step(lot.drop("arrived_at"), alerts, state, now, number, views.PREFIX, "shop")
        want.append(state)
    assert want[0]["entries"].count() > 20 and want[1]["entries"].count() > 5
    assert {r["status"] for r in want[0]["entries"].collect()} == {"baseline"}  # a first run announces nothing
    assert "match" in {r["status"] for r in want[1]["entries"].collect()}

    for lot in (first, second):
        lot.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.stream_watch(source, alerts, out, str(tmp_path / "cp"), views.PREFIX, "shop").awaitTermination()
    assert [n for n, _ in stream.committed(spark, out)] == [0, 1]
    got = {name: plain(d) for name, d in stream.read_state(spark, out, 1).items()}
    assert got == {name: plain(want[1][name]) for name in watch.STATE}
    entries = plain(stream.read_entries(spark, out))
    assert entries == sorted(plain(want[0]["entries"]) + plain(want[1]["entries"]))
    assert plain(spark.read.parquet(f"{out}/status/batch=1")) == plain(want[1]["status"])

    # played again: nothing is done; played again after a stop before its commit: the same
    args = (alerts, out, views.PREFIX, "shop", "arrived_at")
    assert stream.watch_batch(second, 1, *args) is False
    spark.createDataFrame([], "batch long, now timestamp").write.mode("overwrite").json(f"{out}/commits/1")
    assert [n for n, _ in stream.committed(spark, out)] == [0]
    assert stream.watch_batch(second, 1, *args) is True
    assert {name: plain(d) for name, d in stream.read_state(spark, out, 1).items()} == got
    assert plain(stream.read_entries(spark, out)) == entries
    # a batch without rows or times is no run
    assert stream.watch_batch(first.limit(0).withColumn("arrived_at", F.lit(None).cast("timestamp")), 0, alerts, str(tmp_path / "none"), views.PREFIX, "shop", "arrived_at") is False


PRICED = "alert string, id string, fp string, price double, ts timestamp"


def priced():
    rows = [("a", str(i), f"f{i % 3}", 100.0 + i, T0 + dt.timedelta(hours=i)) for i in range(8)]
    rows += [("a", "20", "f9", 1.0, T0 + dt.timedelta(hours=9)), ("a", "21", "f0", None, T0 + dt.timedelta(days=80)), ("b", "22", "f0", -5.0, T0 + dt.timedelta(days=81))]
    return rows


def test_dedupe_and_relists(spark, tmp_path):
    stream.use_rocksdb(spark)
    rows = priced()
    source = lambda name: files(spark, tmp_path / name, PRICED, rows[:5], [*rows[5:], rows[2]])
    assert len(rows_of(spark, stream.stream_dedupe(source("d")), "dedupe", tmp_path)) == len(rows)
    stream.no_idle_batches(spark)
    flags = {(r["id"], r["ts"]): r["relist"] for r in rows_of(spark, stream.stream_relists(source("r")), "relists", tmp_path)}
    last, want = {}, {}
    for _, i, fp, _, ts in rows[:5] + sorted([*rows[5:], rows[2]], key=lambda r: (r[4], r[1])):
        want[(i, ts)] = fp in last and ts - last[fp] <= dt.timedelta(days=45)
        last[fp] = max(ts, last.get(fp, ts))
    assert flags == want and want[("21", rows[9][4])] is False and want[("3", rows[3][4])] is True


def test_a_fingerprint_is_forgotten(spark, tmp_path):
    stream.use_rocksdb(spark)
    stream.no_idle_batches(spark)
    source = files(spark, tmp_path / "in", PRICED, [("a", "1", "f", 1.0, T0)], [("a", "2", "f", 1.0, T0)])  # two batches
    for name, ttl, want in (("kept", None, True), ("gone", 1, False)):
        got = {r["id"]: r["relist"] for r in rows_of(spark, stream.stream_relists(source, ttl_ms=ttl), name, tmp_path)}
        assert got == {"1": False, "2": want}


def test_medians_equal_the_batch_form(spark, tmp_path):
    stream.use_rocksdb(spark)
    rows = priced()
    got = {r["id"]: (r["median"], r["deal"]) for r in rows_of(spark, stream.stream_price_median(files(spark, tmp_path / "in", PRICED, rows[:6], rows[6:])), "medians", tmp_path)}
    prices: dict = {}
    for alert, i, _, p, _ in rows:
        held = prices.setdefault(alert, [])
        m = statistics.median(held[-60:]) if len(held) >= 4 else None
        deal = m is not None and p is not None and p <= 0.75 * m
        assert got[i] == (m, deal), i
        if p is not None and p > 0:
            held.append(p)


def test_counts_past_the_watermark(spark, tmp_path):
    kind = "alert string, status string, detected_at timestamp"
    hour = lambda h: T0 + dt.timedelta(hours=h)
    first = [("a", "match", hour(h)) for h in (1, 2, 2, 30)] + [("a", "borderline", hour(2)), ("b", "match", hour(29))]
    second = [("a", "match", hour(29.5)), ("b", "match", hour(200))]
    third = [("b", "match", hour(400)), ("a", "match", hour(3))]  # the last when all its windows are long given out
    source = files(spark, tmp_path / "in", kind, first, second, third)
    rows = rows_of(spark, stream.stream_match_counts(source), "counts", tmp_path)
    got = {(r["alert"], r["start"]): r["matches"] for r in rows}
    want: dict = {}
    for alert, status, at in first + second + third[:1]:
        if status == "match":
            start = at.replace(minute=0)
            for k in range(24):
                w = (alert, start - dt.timedelta(hours=k))
                want[w] = want.get(w, 0) + 1
    # given out is what the watermark, an hour behind the latest time, has passed
    assert got == {w: n for w, n in want.items() if w[1] + dt.timedelta(hours=24) <= hour(399)}
