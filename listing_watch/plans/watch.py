"""The watch job: one run over a table of listings, from queries to feed entries and new state, and
a run with its feed and status, as one step from a state to the next.

A state is the tables of STATE. Feeds keep the number of the run that added an entry (add_seq) and its
place in that run (pos), which give their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators import feed as fd
from ..operators import match as mt
from ..operators import retrieve as rt
from ..operators import state as st
from ..operators.hits import prepared, term_hits
from ..sources.alerts import flatten_rules, rule_params
from ..sources.store import stored


def watch_run(
    listings: DataFrame, alerts: DataFrame, runs: DataFrame, seen: DataFrame, fingerprints: DataFrame, prices: DataFrame, now: Column, url_prefix: str, marketplace: str, dry_run: bool = False, budget: int | None = None
) -> dict[str, DataFrame]:
    """entries, seen, fingerprints, prices, runs and judged after one run. A dry run judges every
    candidate and returns the state as it was."""
    prepped = stored(prepared(listings), "prepared")  # read by retrieval, scoring and the feed
    due = alerts.filter(~F.col("paused")) if dry_run else rt.active_alerts(alerts, runs, now)
    due = stored(due, "due-alerts")
    rules, params = stored(flatten_rules(due), "rules"), stored(rule_params(due), "params")
    hits = stored(term_hits(prepped, rules.select("term_t").union(rt.query_terms(due))), "hits")
    found = rt.drop_rejected(rt.search_listings(rt.query_matches(prepped, due, hits), due), due)
    pooled = st.baseline_first_run(rt.pool_candidates(found), runs)
    known = seen.select("alert", "id", F.lit(True).alias("known")).dropDuplicates(["alert", "id"])
    fresh = pooled.join(known, ["alert", "id"], "left").filter(F.lit(dry_run) | F.col("first_run") | F.col("known").isNull()).drop("known")
    judged = mt.two_phase_verdicts(fresh, hits, rules, params, budget, ["alert", "pos"])
    wide = prepped.select("id", "name", "price", "thumbnail", "seller_id", "condition_id", "created", "t_title")
    judged = judged.join(wide, "id").withColumn("fp", fingerprint(F.col("t_title"), F.col("price"), F.col("seller_id")))
    match = st.flag_relists(judged.filter("status = 'match'"), fingerprints, ["alert", "pos"], within_run=not dry_run)
    quiet = due.select(F.col("name").alias("alert"), "suppress_relists")
    kept = match.join(quiet, "alert").filter(~(F.col("relist") & F.col("suppress_relists"))).drop("suppress_relists")
    kept = st.flag_deals(kept, st.price_median(prices)).withColumn("deal", F.col("deal") & ~F.col("first_run")).drop("median")
    near = judged.filter("status = 'borderline' and not first_run")
    order = fd.Window.partitionBy("alert").orderBy("pos")
    near = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= fd.SHOWN_BORDERLINE).drop("k").withColumns({"relist": F.lit(False), "deal": F.lit(False)})
    rows = kept.withColumn("status", F.when(F.col("first_run"), "baseline").otherwise("match")).unionByName(near)
    entries = fd.make_entries(rows, due, F.col("status"), now, url_prefix, marketplace, keep=("pos",))
    if dry_run:
        return {"entries": entries, "judged": judged, "seen": seen, "fingerprints": fingerprints, "prices": prices, "runs": runs}
    new_fp = kept.select("fp", "id", now.alias("t"))
    new_prices = kept.select("alert", "price", now.alias("run_ts"), "pos")
    done = due.select(F.col("name").alias("alert"), F.lit(True).alias("initialized"), now.alias("last_checked"))
    return {
        "entries": entries,
        "judged": judged,
        "seen": st.record_seen(seen, pooled, now),
        "fingerprints": st.prune_fingerprints(fingerprints.select("fp", "id", "t").join(new_fp.select("fp").distinct(), "fp", "left_anti").unionByName(new_fp), now),
        "prices": st.record_prices(prices, new_prices),
        "runs": runs.join(done.select("alert"), "alert", "left_anti").unionByName(done),
    }


_FEED = "id string, url string, marketplace string, alert string, alert_label string, name string, price double, thumbnail string, seller_id string, condition string, listed_at timestamp, detected_at timestamp, lag_seconds bigint, score double, hits array<string>, status string, deal boolean, relist boolean, target_hit boolean, pos bigint, add_seq bigint"
STATE = {
    "seen": "alert string, id string, run_ts timestamp, pos bigint",
    "fingerprints": "fp string, id string, t timestamp",
    "prices": "alert string, price bigint, run_ts timestamp, pos bigint",
    "runs": "alert string, initialized boolean, last_checked timestamp",
    "feed": _FEED,
}


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}


def as_table(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a schema, cast to its types."""
    fields = [part.strip().split(" ", 1) for part in schema.split(", ")]
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields])


def watch_step(listings: DataFrame, alerts: DataFrame, state: dict[str, DataFrame], now: Column, number: int, url_prefix: str, marketplace: str, budget: int | None = None) -> dict[str, DataFrame]:
    """The run `number` over listings: the tables of the next state, `entries` (what the run found, an
    id once) and `status` (a row for each alert). Entries whose id the feed has are not added again."""
    out = watch_run(listings, alerts, state["runs"], state["seen"], state["fingerprints"], state["prices"], now, url_prefix, marketplace, budget=budget)
    new = fd.first_entries(out["entries"]).withColumn("add_seq", F.lit(number).cast("bigint"))
    new = stored(as_table(new, _FEED), "new-entries")
    feed = fd.prune_feed(fd.merge_feed(as_table(state["feed"], _FEED), new), now, fd.feed_order())
    made = {name: stored(as_table(df, STATE[name]), name) for name, df in (("seen", out["seen"]), ("fingerprints", out["fingerprints"]), ("prices", out["prices"]), ("runs", out["runs"]), ("feed", feed))}
    status = fd.alert_status(alerts, made["runs"], made["seen"], st.price_median(made["prices"]), made["feed"], now)
    return {**made, "entries": new, "status": status}
