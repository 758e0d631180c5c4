"""Scalar functions over listing and feed columns. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Condition id -> label.
CONDITIONS = {1: "New", 2: "Like new", 3: "Good", 4: "Fair", 5: "Worn", 6: "Poor"}
#: Naive listing times are nine hours ahead of UTC.
NAIVE_OFFSET_HOURS = 9
MAX_LAG_SECONDS = 400 * 24 * 3600
IDF_CORPUS = 1_000_000
IDF_RANGE = (0.25, 5.0)


def item_url(item_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), item_id)


def parse_item_id(text: Column, site: str | None = None) -> Column:
    """An id as it is; of an address (it starts with http or names the site) the last part of the
    path. Null if nothing is left."""
    x = F.trim(text)
    is_url = x.startswith("http") if site is None else x.startswith("http") | F.contains(x, F.lit(site))
    path = F.rtrim(F.split_part(x, F.lit("?"), F.lit(1)), F.lit("/"))
    out = F.when(is_url, F.element_at(F.split(path, "/"), -1)).otherwise(x)
    return F.nullif(out, F.lit(""))


def condition_label(condition_id: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for k, v in CONDITIONS.items() for x in (k, v)])
    return F.try_element_at(labels, condition_id.cast("int"))


def parse_listed_at(text: Column) -> Column:
    """ISO time to an instant; without an offset it is nine hours ahead of UTC; else null."""
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.contains(text, F.lit(":"))
    at = F.try_to_timestamp(text)
    return F.when(aware, at).otherwise(at - F.make_dt_interval(hours=F.lit(NAIVE_OFFSET_HOURS)))


def lag_seconds(listed: Column, detected: Column) -> Column:
    """Whole seconds between the two; null unless 0 or more and under 400 days."""
    lag = F.floor((F.unix_micros(detected) - F.unix_micros(listed)) / 1_000_000).cast("long")
    return F.when((lag >= 0) & (lag < MAX_LAG_SECONDS), lag)


def target_hit(price: Column, target: Column) -> Column:
    return F.coalesce(price <= target, F.lit(False))


def idf_factor(found: Column) -> Column:
    """How much a term tells, from how many listings have it; 1 if unknown."""
    v = F.log10(F.lit(float(IDF_CORPUS)) / F.greatest(found, F.lit(10)))
    return F.when(found.isNull(), 1.0).otherwise(F.greatest(F.lit(IDF_RANGE[0]), F.least(F.lit(IDF_RANGE[1]), v)))


def term_weight_hint(term_t: Column, generic: Column) -> Column:
    """How much a tight term identifies by its length and make-up; 0 if empty."""
    digit, letter = term_t.rlike("[0-9]"), term_t.rlike("[a-z]")
    w = 1 + F.least(F.length(term_t), F.lit(10)) * 0.12 + F.when(digit & letter, 1.4).when(digit, 0.3).otherwise(0.0) - F.when(generic, 1.0).otherwise(0.0)
    return F.when(F.length(term_t) == 0, 0.0).otherwise(F.greatest(w, F.lit(0.1)))
