"""Feed, status and result documents: writing and reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
CARD = T.StructType(
    [
        *[T.StructField(c, _S) for c in ("id", "url", "alert", "alert_label", "name", "thumbnail", "seller_id", "condition", "listed_at", "detected_at", "status", "tt")],
        *[T.StructField(c, _D) for c in ("price", "score")],
        T.StructField("lag_seconds", _L),
        *[T.StructField(c, _B) for c in ("deal", "relist", "target_hit")],
        *[T.StructField(c, T.ArrayType(_S)) for c in ("hits", "terms", "tterms", "generic")],
    ]
)
#: Documents of different age lack some of these; they read as null.
RESULT = T.StructType(
    [
        *[T.StructField(c, _S) for c in ("request_id", "kind", "status", "alert_name")],
        *[T.StructField(c, _L) for c in ("candidates", "matched", "matched_24h", "borderline", "hidden_rejected")],
        T.StructField("min_score", _D),
        T.StructField("sample", T.ArrayType(CARD)),
        T.StructField("near_misses", T.ArrayType(CARD)),
    ]
)


def write_feed(feed: DataFrame, path: str) -> None:
    feed.write.mode("overwrite").partitionBy("alert").parquet(path)


def write_status(status: DataFrame, path: str) -> None:
    status.write.mode("overwrite").json(path)


def write_result(summary: DataFrame, sample: DataFrame, path: str) -> None:
    """One JSON document for each alert: the preview's figures, its sample and its near misses."""
    cards = sample.groupBy("alert").agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "match", F.struct("place", "id", "name", "score", "status", "terms", "tterms", "generic", "tt")))).alias("sample"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "borderline", F.struct("place", "id", "name", "score", "status", "terms", "tterms", "generic", "tt")))).alias("near_misses"),
    )
    d = summary.join(cards, "alert", "left").withColumnRenamed("alert", "alert_name").withColumns({"kind": F.lit("preview"), "status": F.lit("ok")})
    d.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(alert_name, part sample/near_misses, ord, card.*) of stored result documents."""
    d = spark.read.schema(RESULT).option("multiLine", multiline).json(path)
    part = lambda c: d.select("alert_name", F.lit(c).alias("part"), F.posexplode(c).alias("ord", "card"))
    return part("sample").union(part("near_misses")).select("alert_name", "part", "ord", "card.*")
