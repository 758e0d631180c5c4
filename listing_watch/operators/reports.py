"""Comps of sold listings, and the preview of a draft alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_listed_at
from ..functions.terms import card_terms

CAP = 1.15
SAMPLE, NEAR = 24, 8
RECENT = 12


def comps(sold: DataFrame) -> DataFrame:
    """(alert, n, min_price, median_price, mean_price, max_price, suggested_cap) of matched sold
    listings with a price; figures truncated to whole numbers."""
    p = F.col("price")
    g = sold.filter(p.isNotNull()).groupBy("alert").agg(F.count("*").alias("n"), F.min(p).alias("lo"), F.median(p).alias("m"), F.avg(p).alias("a"), F.max(p).alias("hi"))
    return g.select("alert", "n", F.col("lo").alias("min_price"), F.col("m").cast("bigint").alias("median_price"), F.col("a").cast("bigint").alias("mean_price"), F.col("hi").alias("max_price"), (F.col("m") * CAP).cast("bigint").alias("suggested_cap"))


def recent_sold(sold: DataFrame, keep: int = RECENT) -> DataFrame:
    """The first `keep` matched sold listings of each alert in candidate order, then by id."""
    w = Window.partitionBy("alert").orderBy("pos", "id")
    return sold.filter("price is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)


def preview_summary(judged: DataFrame, params: DataFrame, alerts: DataFrame, now: Column) -> DataFrame:
    """(alert, candidates, matched, matched_24h, borderline, min_score, hidden_rejected)."""
    match = F.col("status") == "match"
    late = F.coalesce(parse_listed_at(F.col("created")) >= now - F.make_dt_interval(hours=F.lit(24)), F.lit(False))
    g = judged.groupBy("alert").agg(F.count("*").alias("candidates"), F.count_if(match).alias("matched"), F.count_if(match & late).alias("matched_24h"), F.count_if(F.col("status") == "borderline").alias("borderline"))
    hidden = alerts.select(F.col("name").alias("alert"), F.size("rejected_ids").alias("hidden_rejected"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "matched", "matched_24h", "borderline")]
    return hidden.join(g, "alert", "left").join(params, "alert").select("alert", *zero, "min_score", "hidden_rejected")


def preview_sample(judged: DataFrame, sample: int = SAMPLE, near: int = NEAR) -> DataFrame:
    """The best matches and near misses of each alert by score, candidate order and id, each with its
    filterable terms (terms, tterms, generic, tt). judged has name and description."""
    w = Window.partitionBy("alert", "status").orderBy(F.desc("score"), "pos", "id")
    d = judged.filter("status != 'reject'").withColumn("place", F.row_number().over(w))
    # a bound that is known lets the window drop rows, which hold whole texts, before the shuffle
    d = d.filter(F.col("place") <= max(sample, near))
    d = d.filter(F.col("place") <= F.when(F.col("status") == "match", sample).otherwise(near))
    return d.withColumn("_c", card_terms(F.col("name"), F.col("description"))).select("*", "_c.*").drop("_c")
