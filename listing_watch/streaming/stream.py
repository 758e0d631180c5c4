"""Structured Streaming forms of the watch job and its state.

The batch operators keep ids by number and fingerprints by age; the streaming forms of single
operators keep both by age, as state without a time limit would grow for ever. Stateful queries use
RocksDB. The whole job runs over a stream by `stream_watch`, whose state is that of the batch job."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.state import DEAL, FINGERPRINT_DAYS, MAX_PRICES, MIN_PRICES
from ..plans.watch import STATE, empty_state, watch_step
from ..sources.store import stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State is written to this many places in turn, so that the last one is whole while the next is made.
SLOTS = 3
_DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def no_idle_batches(spark: SparkSession) -> None:
    """For queries whose state has a time to live: Spark runs a batch without data after every batch of
    such a query, as state may have run out, so that a run over what is available would never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


# the watch job ---------------------------------------------------------------------------------


def committed(spark: SparkSession, out: str) -> list[tuple[int, Any]]:
    """(batch, now) of the batches whose tables are whole, in order."""
    try:
        rows = spark.read.schema("batch long, now timestamp").json(f"{out}/commits/*").select("batch", "now").collect()
    except AnalysisException as e:  # nothing was committed yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return sorted((r["batch"], r["now"]) for r in rows)


def read_state(spark: SparkSession, out: str, batch: int) -> dict[str, DataFrame]:
    """The state tables that a committed batch left; those of the last SLOTS - 1 batches are there."""
    return {name: spark.read.schema(schema).parquet(f"{out}/state/{name}/slot={batch % SLOTS}") for name, schema in STATE.items()}


def read_entries(spark: SparkSession, out: str) -> DataFrame:
    """The entries of all committed batches, with the batch's number as add_seq."""
    paths = [f"{out}/entries/batch={n}" for n, _ in committed(spark, out)]
    d = spark.read.schema(STATE["feed"])
    return d.parquet(*paths) if paths else spark.createDataFrame([], STATE["feed"])


def watch_batch(listings: DataFrame, number: int, alerts: DataFrame, out: str, url_prefix: str, marketplace: str, ts: str, start: dict[str, DataFrame] | None = None, budget: int | None = None) -> bool:
    """Batch `number` of a watch stream; False if it was committed before, and nothing is done.

    State is read as the last batch committed before this one left it (`start`, or nothing, before the
    first), and all tables are written before the batch is committed. The run's time is the latest
    `ts` of the batch, or of the batch before where that is later: a batch that is played again has
    the same time, reads the same state and so gives the same tables."""
    spark = listings.sparkSession
    done = committed(spark, out)
    if number in [n for n, _ in done]:
        return False
    earlier = [(n, t) for n, t in done if n < number]
    rows = stored(listings, "batch")
    latest = [t for t in (rows.agg(F.max(F.col(ts).cast("timestamp"))).first()[0], earlier[-1][1] if earlier else None) if t is not None]
    if not latest:
        return False
    now = max(latest)
    state = read_state(spark, out, earlier[-1][0]) if earlier else {**empty_state(spark), **(start or {})}
    made = watch_step(rows.drop(ts) if ts not in _LISTING else rows, alerts, state, F.lit(now).cast("timestamp"), number, url_prefix, marketplace, budget)
    for name in STATE:
        made[name].write.mode("overwrite").parquet(f"{out}/state/{name}/slot={number % SLOTS}")
    for name in ("entries", "status"):
        made[name].write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    spark.createDataFrame([(number, now)], "batch long, now timestamp").coalesce(1).write.mode("overwrite").json(f"{out}/commits/{number}")
    return True


_LISTING = ("id", "name", "description", "price", "thumbnail", "seller_id", "status", "created", "condition_id", "category_id")


def stream_watch(listings: DataFrame, alerts: DataFrame, out: str, checkpoint: str, url_prefix: str, marketplace: str, ts: str = "arrived_at", start: dict[str, DataFrame] | None = None, budget: int | None = None, once: bool = True) -> StreamingQuery:
    """The watch job over a stream of listings with a column of arrival times: each micro-batch is one
    run, which starts from the state that the last one left and writes its entries, its status and the
    next state under `out`. `start` gives tables of STATE to begin with."""

    def each(batch: DataFrame, number: int) -> None:
        watch_batch(batch, number, alerts, out, url_prefix, marketplace, ts, start, budget)

    w = listings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


# single operators --------------------------------------------------------------------------------


def stream_dedupe(candidates: DataFrame, ts: str = "ts", days: int = FINGERPRINT_DAYS) -> DataFrame:
    """An (alert, id) is let through once; repeats within `days` are dropped."""
    return candidates.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["alert", "id"])


def stream_match_counts(matches: DataFrame, ts: str = "detected_at", span: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(alert, start, end, matches) in sliding windows: the last day's, or with span='7 days' the
    last week's, matches of each alert."""
    d = matches.filter("status = 'match'").withWatermark(ts, late).groupBy("alert", F.window(ts, span, step)).agg(F.count("*").alias("matches"))
    return d.select("alert", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "matches")


def _ordered(pages: Iterator[pd.DataFrame], ts: str) -> pd.DataFrame:
    """The rows of a key in a micro-batch, by time and id."""
    return pd.concat(list(pages)).sort_values([ts, "id"], kind="stable")


class _Relists(StatefulProcessor):
    """Of each fingerprint the time it was last seen, kept for `ttl_ms` after it was written."""

    def __init__(self, ts: str, days: int, ttl_ms: int) -> None:
        self.ts, self.span, self.ttl_ms = ts, days * _DAY_MS, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        d = _ordered(rows, self.ts)
        last = self.last.get()[0] if self.last.exists() else None
        flags = []
        for t in d[self.ts]:
            at = int(t.timestamp() * 1000)
            flags.append(last is not None and at - last <= self.span)
            last = at if last is None else max(last, at)
        self.last.update((last,))
        yield pd.DataFrame({"fp": key[0], "id": d["id"], "ts": d[self.ts], "relist": flags})

    def close(self) -> None:
        pass


def stream_relists(matches: DataFrame, ts: str = "ts", days: int = FINGERPRINT_DAYS, ttl_ms: int | None = None) -> DataFrame:
    """(fp, id, ts, relist): was the fingerprint seen in the `days` before. The state store drops a
    fingerprint `days` (or `ttl_ms` milliseconds) after it was last written. Where the query is to end
    with the data there is, call `no_idle_batches` before it starts."""
    d = matches.select("fp", "id", ts).groupBy("fp")
    job = _Relists(ts, days, days * _DAY_MS if ttl_ms is None else ttl_ms)
    return d.transformWithStateInPandas(job, "fp string, id string, ts timestamp, relist boolean", "Append", "ProcessingTime")


class _Medians(StatefulProcessor):
    """Of each alert its last prices, as a list."""

    def __init__(self, ts: str, keep: int, least: int, deal: float, ttl_ms: int | None) -> None:
        self.ts, self.keep, self.least, self.deal, self.ttl_ms = ts, keep, least, deal, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getListState("prices", "price double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        d = _ordered(rows, self.ts)
        prices = [p[0] for p in self.prices.get()] if self.prices.exists() else []
        medians: list[float | None] = []
        for p in d["price"]:
            kept, n = sorted(prices), len(prices)
            medians.append((kept[(n - 1) // 2] + kept[n // 2]) / 2 if n >= self.least else None)
            if not pd.isna(p) and p > 0:
                prices = [*prices[-(self.keep - 1) :], float(p)]
        if prices:
            self.prices.put([(p,) for p in prices])
        m = pd.Series(medians, index=d.index, dtype=float)
        yield pd.DataFrame({"alert": key[0], "id": d["id"], "ts": d[self.ts], "price": d["price"], "median": m, "deal": (d["price"] <= m * self.deal) & m.notna()})

    def close(self) -> None:
        pass


def stream_price_median(matches: DataFrame, ts: str = "ts", keep: int = MAX_PRICES, least: int = MIN_PRICES, deal: float = DEAL, ttl_ms: int | None = None) -> DataFrame:
    """(alert, id, ts, price, median, deal): the median of the alert's last `keep` prices before this
    one, null below `least`. State is those prices; with `ttl_ms` each goes so long after it was written,
    and `no_idle_batches` holds as for `stream_relists`."""
    d = matches.select("alert", "id", ts, F.col("price").cast("double").alias("price")).groupBy("alert")
    job = _Medians(ts, keep, least, deal, ttl_ms)
    return d.transformWithStateInPandas(job, "alert string, id string, ts timestamp, price double, median double, deal boolean", "Append", "None" if ttl_ms is None else "ProcessingTime")
