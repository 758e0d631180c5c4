"""The text layer for SQL: functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .terms import _extract_terms, tight_word
from .text import few_at_once


@F.arrow_udf(T.StringType())
def _tight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield from (pa.array([tight_word(x or "") for x in texts.to_pylist()], pa.string()) for texts in few_at_once(b))


def register(spark: SparkSession) -> None:
    """Makes `tight(text)` and `extract_terms(text)` known to the session's SQL."""
    spark.udf.register("tight", _tight)
    spark.udf.register("extract_terms", _extract_terms)
