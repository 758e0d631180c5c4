"""Finding candidates: queries over all listings, pooling, dropping what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tight
from .hits import term_hits


def active_alerts(alerts: DataFrame, runs: DataFrame, now, only: str | None = None) -> DataFrame:
    """Alerts that are not paused and are due: last checked min_interval_minutes ago or more."""
    last = runs.select(F.col("alert").alias("name"), "last_checked")
    due = F.coalesce("min_interval_minutes", F.lit(0.0))
    d = alerts.join(last, "name", "left").filter(~F.col("paused"))
    if only is not None:
        d = d.filter(F.col("name") == only)
    waited = (F.unix_micros(now) - F.unix_micros("last_checked")) / 60e6
    return d.filter((due == 0) | F.col("last_checked").isNull() | (waited >= due)).drop("last_checked")


def _queries(alerts: DataFrame) -> DataFrame:
    """(alert, query_ord, query, token_t): the words of every query."""
    q = alerts.select(F.col("name").alias("alert"), F.posexplode("queries").alias("query_ord", "query"))
    words = q.withColumn("token", F.explode(F.array_distinct(F.filter(F.split("query", r"\s+"), lambda x: x != ""))))
    return words.select("alert", "query_ord", "query", tight(F.col("token")).alias("term_t"))


def _without(alerts: DataFrame) -> DataFrame:
    """(alert, term_t): the words that an alert's searches leave out."""
    without = alerts.select(F.col("name").alias("alert"), F.explode(F.filter(F.split(F.coalesce("search_exclude", F.lit("")), r"\s+"), lambda x: x != "")).alias("word"))
    return without.select("alert", tight(F.col("word")).alias("term_t"))


def query_terms(alerts: DataFrame) -> DataFrame:
    """(term_t): the words that searches ask for or leave out."""
    return _queries(alerts).select("term_t").union(_without(alerts).select("term_t")).distinct()


def query_matches(prepped: DataFrame, alerts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(alert, query_ord, query, id, created): listings that have every word of a query, within the
    alert's status, prices and categories and without the words it leaves out. hits: those of
    `query_terms` among others, where they are known already."""
    tokens, without = _queries(alerts).distinct(), _without(alerts)
    hits = (term_hits(prepped, query_terms(alerts)) if hits is None else hits).select("id", "term_t")
    need = tokens.groupBy("alert", "query_ord", "query").agg(F.count_distinct("term_t").alias("need"), F.bool_or(F.col("term_t") == "").alias("empty")).filter(~F.col("empty"))
    # the hit table is skewed by term: it meets the few queries by broadcast and is grouped by id
    full = hits.join(tokens, "term_t").groupBy("alert", "query_ord", "id").agg(F.count("*").alias("n"))
    full = full.join(need, ["alert", "query_ord"]).filter("n = need").select("alert", "query_ord", "query", "id")
    limits = alerts.select(F.col("name").alias("alert"), "price_min", "price_max", "categories")
    d = full.join(prepped.select("id", "created", "price", "status", "category_id"), "id").join(limits, "alert")
    fine = F.col("status").isin("on_sale", "sold")
    fine &= F.coalesce(F.col("price") >= F.col("price_min"), F.col("price_min").isNull()) & F.coalesce(F.col("price") <= F.col("price_max"), F.col("price_max").isNull())
    fine &= (F.size(F.coalesce("categories", F.array().cast("array<bigint>"))) == 0) | F.coalesce(F.array_contains("categories", F.col("category_id").cast("long")), F.lit(False))
    d = d.filter(fine)
    bad = hits.join(without, "term_t")
    return d.select("alert", "query_ord", "query", "id", "created").join(bad.select("alert", "id").distinct(), ["alert", "id"], "left_anti")


def search_listings(matches: DataFrame, alerts: DataFrame) -> DataFrame:
    """The newest per_query_limit listings of each query, with their rank."""
    w = Window.partitionBy("alert", "query_ord").orderBy(F.desc("created"), "id")
    limits = alerts.select(F.col("name").alias("alert"), "per_query_limit")
    d = matches.withColumn("rank", F.row_number().over(w))
    # alerts are few; a limit that is known lets the window drop rows before the shuffle
    most = limits.agg(F.max("per_query_limit")).first()[0] or 0
    return d.filter(F.col("rank") <= F.lit(most)).join(limits, "alert").filter("rank <= per_query_limit").drop("per_query_limit")


def query_totals(matches: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert, query_ord, query, total) before any limit; 0 where a query finds nothing."""
    every = alerts.select(F.col("name").alias("alert"), F.posexplode("queries").alias("query_ord", "query"))
    n = matches.groupBy("alert", "query_ord").agg(F.count("*").alias("total"))
    return every.join(n, ["alert", "query_ord"], "left").select("alert", "query_ord", "query", F.coalesce("total", F.lit(0)).alias("total"))


def drop_rejected(found: DataFrame, alerts: DataFrame) -> DataFrame:
    """Without the listings dismissed by hand."""
    gone = alerts.select(F.col("name").alias("alert"), F.explode("rejected_ids").alias("id"))
    return found.join(gone, ["alert", "id"], "left_anti")


def pool_candidates(found: DataFrame) -> DataFrame:
    """(alert, id, query_ord, rank, pos): one row for each listing of an alert, from the first query
    that found it; pos is its place in the alert's candidate order."""
    w = Window.partitionBy("alert", "id").orderBy("query_ord", "rank")
    d = found.filter("id is not null").withColumn("n", F.row_number().over(w)).filter("n = 1")
    order = Window.partitionBy("alert").orderBy("query_ord", "rank", "id")
    return d.select("alert", "id", "query_ord", "rank", (F.row_number().over(order) - 1).alias("pos"))


def query_breakdown(found: DataFrame, matches: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert, query_ord, query, total, returned, new_here, dismissed) for each query."""
    new = pool_candidates(drop_rejected(found, alerts)).groupBy("alert", "query_ord").agg(F.count("*").alias("new_here"))
    gone = alerts.select(F.col("name").alias("alert"), F.explode("rejected_ids").alias("id"), F.lit(1).alias("gone"))
    n = found.join(gone, ["alert", "id"], "left").groupBy("alert", "query_ord").agg(F.count("*").alias("returned"), F.count("gone").alias("dismissed"))
    d = query_totals(matches, alerts).join(n, ["alert", "query_ord"], "left").join(new, ["alert", "query_ord"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return d.select("alert", "query_ord", "query", "total", zero("returned"), zero("new_here"), zero("dismissed"))


def drop_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates that their alert has not met before."""
    return candidates.join(seen.select("alert", "id"), ["alert", "id"], "left_anti")
