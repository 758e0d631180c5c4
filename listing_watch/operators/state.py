"""What runs remember: seen ids, fingerprints, prices; reposts, medians and deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

MAX_SEEN = 600
MAX_PRICES = 60
MIN_PRICES = 4
FINGERPRINT_DAYS = 45
MAX_FINGERPRINTS = 4000
DEAL = 0.75


def record_seen(seen: DataFrame, candidates: DataFrame, run_ts: Column, keep: int = MAX_SEEN) -> DataFrame:
    """seen (alert, id, run_ts, pos) with this run's candidates (alert, id, pos) in front, each id
    once, the newest `keep` of each alert."""
    new = candidates.select("alert", "id", run_ts.alias("run_ts"), F.col("pos").cast("long").alias("pos"))
    newest = [F.desc("run_ts"), "pos", "id"]
    d = seen.select("alert", "id", "run_ts", "pos").unionByName(new)
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("alert", "id").orderBy(*newest))).filter("n = 1")
    return d.withColumn("n", F.row_number().over(Window.partitionBy("alert").orderBy(*newest))).filter(F.col("n") <= keep).drop("n")


def baseline_first_run(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """candidates with first_run: their alert has never been run."""
    done = runs.filter("initialized").select("alert", F.lit(True).alias("done"))
    return candidates.join(done, "alert", "left").withColumn("first_run", F.col("done").isNull()).drop("done")


def flag_relists(matches: DataFrame, fingerprints: DataFrame, order: list[str], within_run: bool = True) -> DataFrame:
    """matches (with fp, first_run) with relist: the fingerprint is recorded, or an earlier match of
    this run has it. First runs record theirs but flag nothing."""
    known = fingerprints.select("fp", F.lit(True).alias("known")).dropDuplicates(["fp"])
    d = matches.join(known, "fp", "left")
    again = F.col("known").isNotNull()
    if within_run:
        # the first place of a fingerprint, not its neighbours: a common one is one partial minimum
        first = d.groupBy("fp").agg(F.min(F.struct(*order)).alias("first"))
        d = d.join(first, "fp")
        again |= F.struct(*order) > F.col("first")
    return d.withColumn("relist", again & ~F.coalesce("first_run", F.lit(False))).drop("known", "first")


def prune_fingerprints(fingerprints: DataFrame, now: Column, days: int = FINGERPRINT_DAYS, keep: int = MAX_FINGERPRINTS) -> DataFrame:
    """Recorded within `days`, then the newest `keep`."""
    return fingerprints.filter(F.col("t") >= now - F.make_dt_interval(days=F.lit(days))).orderBy(F.desc("t"), "fp").limit(keep)


def record_prices(prices: DataFrame, new: DataFrame, keep: int = MAX_PRICES) -> DataFrame:
    """prices (alert, price, run_ts, pos) with new rows of the same columns: positive whole prices,
    the newest `keep` of each alert; in a run later places are newer, and of one place
    the higher price."""
    d = prices.unionByName(new.select("alert", F.col("price").cast("long").alias("price"), "run_ts", "pos")).filter("price > 0")
    w = Window.partitionBy("alert").orderBy(F.desc("run_ts"), F.desc("pos"), F.desc("price"))
    return d.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).drop("n")


def price_median(prices: DataFrame, least: int = MIN_PRICES) -> DataFrame:
    """(alert, median): exact, null below `least` prices. Prices are capped before, so groups are
    small."""
    return prices.groupBy("alert").agg(F.when(F.count("price") >= least, F.median("price")).alias("median"))


def rolling_price_median(listings: DataFrame, key: str = "alert", ts: str = "ts", tie: str = "id", price: str = "price", last: int = MAX_PRICES, least: int = MIN_PRICES, parts: int | None = None) -> DataFrame:
    """listings with median: that of the `last` prices before each in order of ts, tie and price, null
    below `least`. A null price holds a place among the `last` and is not counted.

    The rows are cut by range of (key, ts, tie, price) into `parts` (the session's shuffle partitions),
    so that a key of any size lies in many parts in order of time. Each part takes over the last rows
    of its first key from the parts before it, at most `last` of them, and is then complete in itself.
    Columns named `_part` and `_carried` are made on the way."""
    spark = listings.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = [key, ts, tie, price]
    rows = stored(listings.repartitionByRange(n, *line).withColumn("_part", F.spark_partition_id()), "ranges")
    narrow = rows.select(*line, "_part")
    # the end of each part: of its last key, whose rows the next part may go on with
    ends = narrow.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*[F.desc_nulls_last(c) for c in line]))).filter(F.col("_k") <= last)
    begins = narrow.groupBy("_part").agg(F.min(F.struct(*line)).alias("_f")).select(F.col(f"_f.{key}").alias(key), "_part", F.lit(True).alias("_begin"))
    # a begin stands before the rows of its own part and behind those of all earlier ones of its key
    ends = ends.drop("_k").withColumn("_begin", F.lit(False)).unionByName(begins, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("_part", F.desc("_begin"), ts, tie, price)
    taken = F.collect_list(F.when(~F.col("_begin"), F.struct(ts, tie, price))).over(before.rowsBetween(-2 * last, -1))
    carried = ends.withColumn("_rows", taken).filter("_begin").select(key, "_part", F.explode(F.slice(F.reverse("_rows"), 1, last)).alias("_r"))
    carried = carried.select(key, "_part", "_r.*", F.lit(True).alias("_carried"))
    w = Window.partitionBy("_part", key).orderBy(ts, tie, price).rowsBetween(-last, -1)
    p = F.col(price)
    d = rows.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    d = d.withColumn("median", F.when(F.count(p).over(w) >= least, F.percentile(p, 0.5).over(w)))
    return d.filter("not _carried").drop("_part", "_carried")


def flag_deals(matches: DataFrame, medians: DataFrame, share: float = DEAL) -> DataFrame:
    """matches with median and deal: the price is at most `share` of the median; null without one."""
    d = matches.join(medians, "alert", "left")
    return d.withColumn("deal", F.when(F.col("median").isNotNull() & (F.col("median") != 0), F.col("price") <= F.col("median") * share))
