"""Alerts and raw listings: reading, checking, canonical columns, flattened rules."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import is_short_code, tight

#: What no alert wants, and named bundles of excludes.
DEFAULT_EXCLUDES = ["複製", "リプロ", "レプリカ", "コピー品", "偽物", "自作", "ダミー", "空箱", "箱のみ", "ケースのみ", "説明書のみ", "取扱説明書のみ", "外箱のみ", "求む", "探しています", "譲ってください", "買取"]
PRESETS = {
    "no_repro": ["複製", "リプロ", "レプリカ", "コピー品", "偽物", "自作", "ダミー"],
    "no_junk": ["ジャンク", "訳あり", "訳有り", "難あり", "破損", "汚れ大", "水濡れ跡"],
    "no_bulk": ["まとめ売り", "まとめて", "大量", "セット売り", "詰め合わせ", "福袋"],
    "no_parts": ["空箱", "箱のみ", "ケースのみ", "説明書のみ", "外箱のみ", "付属品のみ"],
    "sealed_only": [],
    "no_graded": ["PSA", "BGS", "ARS", "鑑定済"],
}

_STR = T.StringType()
ALERT = T.StructType(
    [
        *[T.StructField(c, _STR) for c in ("name", "label", "keyword", "notes", "created_at", "search_exclude")],
        *[T.StructField(c, T.ArrayType(_STR)) for c in ("queries", "presets", "rejected_ids", "learned_from")],
        T.StructField("categories", T.ArrayType(T.LongType())),
        *[T.StructField(c, T.LongType()) for c in ("price_min", "price_max", "target_price", "per_query_limit")],
        T.StructField("min_interval_minutes", T.DoubleType()),
        *[T.StructField(c, T.BooleanType()) for c in ("paused", "suppress_relists", "notify_email", "use_default_excludes")],
        T.StructField(
            "match",
            T.StructType(
                [
                    T.StructField("require", T.ArrayType(T.ArrayType(_STR))),
                    T.StructField("signals", T.ArrayType(T.StructType([T.StructField("term", _STR), T.StructField("weight", T.DoubleType())]))),
                    T.StructField("exclude", T.ArrayType(_STR)),
                    T.StructField("min_score", T.DoubleType()),
                    T.StructField("borderline_ratio", T.DoubleType()),
                    T.StructField("scope", _STR),
                ]
            ),
        ),
        T.StructField("source", _STR),
    ]
)


def _row(alert: dict, source: str, exclude_field: str) -> dict:
    """One alert of a configuration file in the columns of ALERT."""
    rules = alert.get("match") or {}
    signals = rules.get("signals") or {}
    pairs = [(s, 1.0) for s in signals] if isinstance(signals, list) else [(k, float(v)) for k, v in signals.items()]
    text = lambda xs: [str(x) for x in xs or []]
    out = {f.name: alert.get(f.name) for f in ALERT}
    out |= {"source": source, "search_exclude": alert.get(exclude_field), "queries": text(alert.get("queries")), "rejected_ids": text(alert.get("rejected_ids"))}
    if out["min_interval_minutes"] is not None:
        out["min_interval_minutes"] = float(out["min_interval_minutes"])
    out["match"] = {
        "require": [text(g) if isinstance(g, list) else [str(g)] for g in rules.get("require") or []],
        "signals": [{"term": k, "weight": w} for k, w in pairs],
        "exclude": text(rules.get("exclude")),
        "min_score": None if rules.get("min_score") is None else float(rules["min_score"]),
        "borderline_ratio": None if rules.get("borderline_ratio") is None else float(rules["borderline_ratio"]),
        "scope": rules.get("scope"),
    }
    return out


def alerts_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of ALERT as a local table, whose size Spark knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(ALERT)), ALERT)


def load_alerts(spark: SparkSession, json_path: str | None = None, yaml_path: str | None = None, exclude_field: str = "search_exclude") -> DataFrame:
    """The alerts of a JSON and a YAML file ({"alerts": [...]}), JSON first; either may be missing.
    Configuration is small and is parsed on the driver, from any store Spark reads."""
    import json

    rows: list[dict] = []
    for path, kind in ((json_path, "json"), (yaml_path, "yaml")):
        if path is None:
            continue
        try:
            text = spark.read.text(path, wholetext=True).first()
        except Exception as e:  # a missing file is no alerts; anything else is an error
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        if kind == "json":
            doc = json.loads(text[0]) if text else None
        else:
            import yaml

            doc = yaml.safe_load(text[0]) if text else None
        rows += [_row(a, kind, exclude_field) for a in (doc or {}).get("alerts") or []]
    return alerts_of(spark, rows)


def validate_alerts(alerts: DataFrame) -> DataFrame:
    """alerts as they are, or ValueError: a name, queries or a keyword, and no name twice."""
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    asks = (F.size(F.coalesce("queries", F.array())) > 0) | (F.coalesce("keyword", F.lit("")) != "")
    bad = alerts.filter(~named | ~asks).select("name").limit(5).collect()
    twice = alerts.groupBy("name").count().filter("count > 1").limit(5).collect()
    if bad or twice:
        raise ValueError(f"alerts without name or queries: {[r[0] for r in bad]}; names used twice: {[r[0] for r in twice]}")
    return alerts


def alert_defaults(alerts: DataFrame) -> DataFrame:
    """Defaults filled in: label, queries from the keyword, limits, flags, and alert_ord."""
    given = F.when(F.size(F.coalesce("queries", F.array())) > 0, F.col("queries")).otherwise(F.when(F.col("keyword").isNotNull(), F.array("keyword")).otherwise(F.array().cast("array<string>")))
    return alerts.withColumns(
        {
            "label": F.coalesce(F.nullif("label", F.lit("")), F.col("name")),
            "queries": F.filter(given, lambda q: F.coalesce(F.trim(q), F.lit("")) != ""),
            "paused": F.coalesce("paused", F.lit(False)),
            "per_query_limit": F.coalesce("per_query_limit", F.lit(30)),
            "suppress_relists": F.coalesce("suppress_relists", F.lit(False)),
            "notify_email": F.coalesce("notify_email", F.lit(True)),
            "use_default_excludes": F.coalesce("use_default_excludes", F.lit(True)),
            "categories": F.coalesce("categories", F.array().cast("array<bigint>")),
            "rejected_ids": F.array_distinct(F.filter(F.coalesce("rejected_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")),
            "notes": F.coalesce("notes", F.lit("")),
        }
    )


def rule_params(alerts: DataFrame) -> DataFrame:
    """(alert, min_score, borderline_ratio, scope) of alerts with defaults."""
    bare = _bare(F.col("match"), F.col("queries"))
    return alerts.select(
        F.col("name").alias("alert"),
        F.when(bare, 3.0).otherwise(F.coalesce("match.min_score", F.lit(4.0))).alias("min_score"),
        F.coalesce("match.borderline_ratio", F.lit(0.55)).alias("borderline_ratio"),
        F.coalesce("match.scope", F.when(bare, "title").otherwise("full")).alias("scope"),
    )


def _bare(match: Column, queries: Column) -> Column:
    """No rules but queries: the first query is the rule."""
    none = lambda c: F.size(F.coalesce(c, F.array())) <= 0
    return none(match["require"]) & none(match["signals"]) & (F.size(queries) > 0)


def flatten_rules(alerts: DataFrame) -> DataFrame:
    """alerts with defaults -> (alert, kind exclude/require/signal, grp, ord, term, term_t, weight,
    is_short_code). Excludes are the defaults, the alert's own and its presets, each tight form
    once; an alert without rules requires its first query, at weight 5."""
    bare = _bare(F.col("match"), F.col("queries"))
    strings = F.array().cast("array<string>")
    presets = F.create_map(*[x for k, v in PRESETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    exclude = F.concat(
        F.when(F.col("use_default_excludes"), F.array(*map(F.lit, DEFAULT_EXCLUDES))).otherwise(strings),
        F.coalesce("match.exclude", strings),
        F.flatten(F.transform(F.coalesce("presets", strings), lambda p: F.coalesce(F.try_element_at(presets, p), strings))),
    )
    require = F.when(bare, F.array(F.array(F.get("queries", F.lit(0))))).otherwise(F.coalesce("match.require", F.array().cast("array<array<string>>")))
    signals = F.when(bare, F.array(F.struct(F.get("queries", F.lit(0)).alias("term"), F.lit(5.0).alias("weight")))).otherwise(F.coalesce("match.signals", F.array().cast("array<struct<term:string,weight:double>>")))
    base = alerts.select(F.col("name").alias("alert"), exclude.alias("x"), require.alias("r"), signals.alias("s"))
    null = lambda kind: F.lit(None).cast(kind)
    ex = base.select("alert", F.posexplode("x").alias("ord", "term")).select("alert", F.lit("exclude").alias("kind"), null("int").alias("grp"), "ord", "term", null("double").alias("weight"))
    rq = base.select("alert", F.posexplode("r").alias("grp", "g")).select("alert", "grp", F.posexplode("g").alias("ord", "term")).select("alert", F.lit("require").alias("kind"), "grp", "ord", "term", null("double").alias("weight"))
    sg = base.select("alert", F.posexplode("s").alias("ord", "p")).select("alert", F.lit("signal").alias("kind"), null("int").alias("grp"), "ord", F.col("p.term").alias("term"), F.col("p.weight").alias("weight"))
    rules = ex.unionByName(rq).unionByName(sg).withColumn("term_t", tight(F.col("term")))
    first = Window.partitionBy("alert", "kind", "term_t").orderBy("ord")
    once = F.row_number().over(first)
    rules = rules.withColumn("n", once).filter("kind != 'exclude' or (n = 1 and term_t != '')").drop("n")
    return rules.withColumn("is_short_code", is_short_code(F.col("term_t")))


#: The names a raw listing's fields go by, best first.
ALIASES = {
    "id": ["id", "id_", "item_id", "itemId", "_id", "productId", "product_id"],
    "name": ["name", "title", "productName"],
    "description": ["description"],
    "price": ["price", "productPrice"],
    "thumbnail": ["thumbnails", "photos", "photo_urls", "images", "photoUrls", "imageUrls", "thumbnail"],
    "seller_id": ["seller_id", "sellerId"],
    "status": ["status"],
    "created": ["created", "created_at", "createdAt"],
    "condition_id": ["item_condition_id", "itemConditionId", "condition_id"],
    "category_id": ["category_id", "categoryId"],
}
ITEM_ID = r"^m\d{6,}$"


def _strings(schema: T.StructType, prefix: str = "", depth: int = 0) -> list[Column]:
    """String fields in order of name, each level before the next, two levels down at most."""
    fields = sorted(schema.fields, key=lambda f: f.name)
    here = [F.col(f"{prefix}`{f.name}`") for f in fields if isinstance(f.dataType, T.StringType)]
    below = [c for f in fields if isinstance(f.dataType, T.StructType) and depth < 2 for c in _strings(f.dataType, f"{prefix}`{f.name}`.", depth + 1)]
    return here + below


def recover_item_id(raw: DataFrame) -> Column:
    """The first string field, by name, that has the shape of an item id."""
    found = [F.when(c.rlike(ITEM_ID), c) for c in _strings(raw.schema)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalize_listings(raw: DataFrame) -> DataFrame:
    """Raw listings in the canonical columns: of each field's aliases the first that is filled. A
    description or seller_id that is there but empty stays the empty text: null is what was not fetched."""
    kinds = dict(raw.dtypes)

    def first(names: list[str], to: str) -> Column:
        cols = []
        for n in (n for n in names if n in kinds):
            c = F.get(F.col(f"`{n}`"), F.lit(0)) if kinds[n].startswith("array") else F.col(f"`{n}`")
            cols.append(F.nullif(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("")) if kinds[n].startswith("timestamp") else F.nullif(c.cast("string"), F.lit("")).cast(to))
        return F.coalesce(*cols) if cols else F.lit(None).cast(to)

    kind = {"price": "double", "condition_id": "int", "category_id": "int"}
    out = {k: first(v, kind.get(k, "string")) for k, v in ALIASES.items()}
    out["id"] = F.coalesce(out["id"], recover_item_id(raw))
    out["name"] = F.coalesce(out["name"], F.lit(""))
    for k in ("description", "seller_id"):
        out[k] = F.coalesce(out[k], *[F.col(f"`{n}`").cast("string") for n in ALIASES[k] if n in kinds])
    return raw.select(*[c.alias(k) for k, c in out.items()])


def upsert_alert(alerts: DataFrame, new: DataFrame) -> DataFrame:
    """new rows in place of those of the same name, else added."""
    return alerts.join(new.select("name"), "name", "left_anti").unionByName(new, allowMissingColumns=True)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
