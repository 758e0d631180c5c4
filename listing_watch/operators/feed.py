"""Feed entries, the status of each alert, and the digest of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import condition_label, item_url, lag_seconds, parse_listed_at, target_hit

MAX_ENTRIES = 400
MAX_DAYS = 45
SHOWN_HITS = 8
SHOWN_BORDERLINE = 8


def make_entries(matches: DataFrame, alerts: DataFrame, status: Column, detected: Column, url_prefix: str, marketplace: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feed entries of matches (alert, id, name, price, thumbnail, seller_id, condition_id, created,
    score, hits, deal, relist), with the columns `keep` of those behind."""
    a = alerts.select(F.col("name").alias("alert"), F.col("label").alias("alert_label"), "target_price")
    listed = parse_listed_at(F.col("created"))
    return matches.join(a, "alert").select(
        "id",
        item_url(F.col("id"), url_prefix).alias("url"),
        F.lit(marketplace).alias("marketplace"),
        "alert",
        "alert_label",
        F.coalesce("name", F.lit("")).alias("name"),
        "price",
        "thumbnail",
        "seller_id",
        condition_label(F.col("condition_id")).alias("condition"),
        listed.alias("listed_at"),
        detected.alias("detected_at"),
        lag_seconds(listed, detected).alias("lag_seconds"),
        "score",
        F.slice("hits", 1, SHOWN_HITS).alias("hits"),
        status.alias("status"),
        F.coalesce("deal", F.lit(False)).alias("deal"),
        F.coalesce("relist", F.lit(False)).alias("relist"),
        target_hit(F.col("price"), F.col("target_price")).alias("target_hit"),
        *keep,
    )


def merge_feed(feed: DataFrame, entries: DataFrame) -> DataFrame:
    """feed with the entries whose id it does not have. Order is by add_seq, newest first, then pos:
    entries carry the sequence number of their addition."""
    return feed.unionByName(entries.join(feed.select("id").distinct(), "id", "left_anti"))


def feed_order() -> list[Column]:
    """What was added last comes first, an alert's borderline rows before its matches."""
    return [F.desc("add_seq"), F.desc("alert"), F.asc(F.col("status") != "borderline"), F.asc("pos"), F.asc("id")]


def first_entries(entries: DataFrame) -> DataFrame:
    """entries of one run, each id once: that of the first alert by name, its match before its
    borderline row, the earlier place."""
    w = Window.partitionBy("id").orderBy("alert", F.col("status") == "borderline", "pos")
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prune_feed(feed: DataFrame, now: Column, order: list, days: int = MAX_DAYS, keep: int = MAX_ENTRIES) -> DataFrame:
    """Entries of the last `days` or without a time, the first `keep` in feed order."""
    fresh = F.col("detected_at").isNull() | (F.col("detected_at") >= now - F.make_dt_interval(days=F.lit(days)))
    return feed.filter(fresh).orderBy(*order).limit(keep)


def matches_since(feed: DataFrame, now: Column, hours: tuple[int, ...] = (24, 168)) -> DataFrame:
    """(alert, matches_<h>h): entries with status match in the last h hours."""
    late = lambda h: F.count_if((F.col("status") == "match") & (F.col("detected_at") >= now - F.make_dt_interval(hours=F.lit(h))))
    return feed.groupBy("alert").agg(*[late(h).alias(f"matches_{h}h") for h in hours])


def alert_status(alerts: DataFrame, runs: DataFrame, seen: DataFrame, medians: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """One row for each alert: label, paused, queries, last check, known listings, median price and
    matches of the last day and week."""
    known = seen.groupBy("alert").agg(F.count_distinct("id").alias("known_listings"))
    d = alerts.select(F.col("name").alias("alert"), "label", "paused", F.size("queries").alias("queries"))
    for x in (runs.select("alert", "last_checked"), known, medians.select("alert", F.col("median").alias("median_price")), matches_since(feed, now)):
        d = d.join(x, "alert", "left")
    zero = lambda c, to: F.coalesce(c, F.lit(0)).alias(to)
    return d.select("alert", "label", "paused", "queries", "last_checked", zero("known_listings", "known_listings"), "median_price", zero("matches_24h", "matches_24h"), zero("matches_168h", "matches_7d"))


def digest(matches: DataFrame, borderline: DataFrame, url_prefix: str) -> DataFrame:
    """(alert, label, section, n, pos, id, line): matches, and the first borderline rows by pos, a row
    for each line of text with the number of lines of its section; the inputs have alert, label, pos,
    id, name, price, score. Lines are in order of pos and id."""
    w = Window.partitionBy("alert").orderBy("pos", "id")
    few = borderline.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SHOWN_BORDERLINE).drop("k")
    d = matches.withColumn("section", F.lit("match")).unionByName(few.withColumn("section", F.lit("borderline")))
    price = F.coalesce(F.format_number("price", 0), F.lit("?"))
    line = F.concat_ws(" | ", F.when(F.col("section") == "borderline", F.format_string("[%.2f] %s", "score", "name")).otherwise(F.col("name")), price, item_url(F.col("id"), url_prefix))
    n = digest_counts(d)
    return d.join(n.select("alert", "section", "n"), ["alert", "section"]).select("alert", "label", "section", "n", "pos", "id", line.alias("line"))


def digest_counts(lines: DataFrame) -> DataFrame:
    """(alert, label, section, n): how many lines each section has."""
    return lines.groupBy("alert", "section").agg(F.max("label").alias("label"), F.count("*").alias("n"))


def digest_subject(sections: DataFrame) -> DataFrame:
    """(subject): the counts and labels of a digest, at most 150 characters."""
    g = sections.agg(F.sum(F.when(F.col("section") == "match", F.col("n")).otherwise(0)).alias("m"), F.sum(F.when(F.col("section") == "borderline", F.col("n")).otherwise(0)).alias("b"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("section") == "match", F.col("label")))), ", ").alias("names"))
    text = F.when(F.col("m") > 0, F.concat(F.col("m").cast("string"), F.when(F.col("m") == 1, " new listing: ").otherwise(" new listings: "), "names")).otherwise(F.concat(F.col("b").cast("string"), F.when(F.col("b") == 1, " possible match").otherwise(" possible matches")))
    return g.select(F.when(F.length(text) > 150, F.concat(F.substring(text, 1, 147), F.lit("..."))).otherwise(text).alias("subject"))
