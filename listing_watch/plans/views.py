"""The given tables seen as listings, alerts, runs and cards, in Spark and in SQL.

Each SQL text is a list of common table expressions; `sql(names, select)` puts together those a
query needs. Texts of the tables are Latin, where NFKC changes nothing, so lower case and two
patterns give the same forms there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tight
from ..operators.hits import prepared, term_hits
from ..operators.retrieve import query_matches, query_terms
from ..sources.alerts import _row, alert_defaults, alerts_of, flatten_rules, rule_params
from ..sources.store import stored

ALERTS = [
    {
        "name": "english",
        "label": "English notices",
        "queries": ["the with", "from that this", "licensed under"],
        "match": {"require": [["the", "and"], ["of", "with"]], "signals": {"that": 1.5, "from": 2.0, "licensed": 3.25, "version": 2.5, "this": 0.75, "nowhere to be found": 4.0}, "exclude": ["password", "idiot"], "min_score": 3.0},
        "target_price": 1500,
        "rejected_ids": ["m00000005", "m00000006", "m00000011"],
        "min_interval_minutes": 30,
    },
    {
        "name": "german",
        "queries": ["der und", "nicht"],
        "match": {"require": ["der"], "signals": {"und": 2.0, "nicht": 2.25, "eine": 1.25}, "min_score": 3.0},
        "price_max": 3000,
        "categories": [1, 2, 3],
        "suppress_relists": True,
    },
    {"name": "romance", "label": "Romance", "queries": ["para", "avec pour"], "match": {"signals": {"para": 2.5, "avec": 2.5, "pour": 1.0, "que": 0.5}, "exclude": ["license"], "min_score": 2.5, "scope": "title"}, "search_exclude": "idiot", "per_query_limit": 20},
    {"name": "resting", "keyword": "shall not run", "paused": True},
]
NOW = "2024-03-01 00:00:00"
PREFIX = "https://shop.example.com/item/"


def alerts(spark: SparkSession) -> DataFrame:
    rows = [_row(a, "inline", "search_exclude") for a in ALERTS]
    return alert_defaults(alerts_of(spark, rows))


def rules(spark: SparkSession) -> DataFrame:
    return flatten_rules(alerts(spark))


def params(spark: SparkSession) -> DataFrame:
    return rule_params(alerts(spark))


def now():
    return F.to_timestamp(F.lit(NOW))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"),
        F.col("text").alias("description"),
        F.col("n_chars").cast("double").alias("price"),
        F.col("source").alias("seller_id"),
        F.lit(None).cast("string").alias("thumbnail"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
        F.when(F.col("doc_id") % 3 == 0, "sold").otherwise("on_sale").alias("status"),
        (F.col("doc_id") % 7).cast("int").alias("condition_id"),
        (F.col("doc_id") % 5).cast("int").alias("category_id"),
    )


def prepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(listings(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_hits(prepped(spark, sf_dir), rules(spark))


class Work:
    """What the queries on matching share, for one of them: the hits of all
    rules and searches, and the candidates; hits and candidates are written once and read by each step."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        live = stored(alerts(spark).filter("not paused"), "alerts")
        self.rules, self.params = stored(rules(spark), "rules"), stored(params(spark), "params")
        self.listings = listings(spark, sf_dir)
        words = self.rules.select("term_t").union(query_terms(live))
        self.hits = stored(term_hits(prepared(self.listings), words), "hits")
        self.matches = query_matches(self.listings, live, self.hits)
        # every listing that any query of an alert finds; pos is its number
        found = self.matches.select("alert", "id").distinct().withColumn("pos", F.substring("id", 2, 8).cast("long"))
        self.candidates = stored(found, "candidates")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Work(spark, sf_dir).candidates


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("english", True, NOW[:11] + "00:00:00"), ("german", True, "2024-02-29 23:00:00")], "alert string, initialized boolean, at string").select("alert", "initialized", F.to_timestamp("at").alias("last_checked"))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document was seen by the English alert."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 2 = 0")
    return d.select(F.lit("english").alias("alert"), F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("run_ts"), F.col("doc_id").alias("pos"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the sold listings, at the time each was made."""
    from ..functions.text import fingerprint

    d = listings(spark, sf_dir).filter("status = 'sold'")
    return d.select(fingerprint(tight(F.col("name")), F.col("price"), F.col("seller_id")).alias("fp"), "id", F.to_timestamp("created").alias("t"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals: an alert for each type, with a price."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.select(F.col("event_type").alias("alert"), F.col("event_id").alias("id"), "ts", F.col("value").alias("price"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed entries."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("alert"), F.when(F.col("event_id") % 3 == 0, "borderline").otherwise("match").alias("status"), F.col("ts").alias("detected_at"), F.col("event_id").alias("pos"))


def event_now(spark: SparkSession, sf_dir: str):
    """The time of the last event, as a literal."""
    return F.lit(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0]).cast("timestamp")


def cards(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """Conversation turns as cards: an alert for each run of eight conversations, words as terms, marks
    by turn. The text's tight form is its words run together. single: an alert for each conversation,
    every third turn of it confirmed."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 2))
    mark = F.when(F.col("turn" if single else "conv_id") % 3 == 0, "confirmed").when(F.col("turn") % (3 if single else 2) == 1, "rejected")
    return d.select(
        F.floor(F.col("conv_id") / (1 if single else 8)).cast("string").alias("alert"),
        F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"),
        mark.alias("mark"),
        (F.length("text") / 4).alias("score"),
        words.alias("terms"),
        words.alias("tterms"),
        F.filter(words, lambda w: F.length(w) == 3).alias("generic"),
        F.regexp_replace(F.lower("text"), "[^0-9a-z]", "").alias("tt"),
    )


def card_rules(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """The same four rules for every alert of the cards."""
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(t).alias("term_t")) for k, t in (("exclude", "that"), ("require", "the"), ("signal", "this"), ("signal", "here"))]
    return cards(spark, sf_dir, single).select("alert").distinct().select("alert", F.explode(F.array(*rows)).alias("r")).select("alert", "r.*")


def _q(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) else _q(x) for x in r) + ")" for r in rows)


def _t(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def _rule_rows() -> list[tuple]:
    out = []
    for a in ALERTS:
        m, name = a.get("match") or {}, _q(a["name"])
        if not m:
            m = {"require": [a["keyword"]], "signals": {a["keyword"]: 5.0}}
        out += [(name, "'exclude'", "NULL", str(i + 17), _q(x), _q(_t(x)), "NULL") for i, x in enumerate(m.get("exclude") or [])]
        out += [(name, "'require'", str(g), str(i), _q(x), _q(_t(x)), "NULL") for g, xs in enumerate(m.get("require") or []) for i, x in enumerate(xs if isinstance(xs, list) else [xs])]
        out += [(name, "'signal'", "NULL", str(i), _q(x), _q(_t(x)), str(w)) for i, (x, w) in enumerate(m["signals"].items())]
    return out


def _hit(term: str, t: str, s: str) -> str:
    return f"(CASE WHEN length({term}) <= 6 THEN {t} = {term} OR contains({s}, ' ' || {term} || ' ') ELSE contains({t}, {term}) END)"


_LIVE = [a for a in ALERTS if not a.get("paused")]
_ID = "'m' || lpad(doc_id::VARCHAR, 8, '0')"
_TS = "make_timestamp((1704067200 + doc_id * 60) * 1000000)"
CTE = {
    "listings": f"""SELECT {_ID} AS id, split_part(text, chr(10), 1) AS name, text AS description, n_chars::DOUBLE AS price, source AS seller_id, NULL::VARCHAR AS thumbnail,
        strftime({_TS}, '%Y-%m-%dT%H:%M:%S') AS created, CASE WHEN doc_id % 3 = 0 THEN 'sold' ELSE 'on_sale' END AS status, (doc_id % 7)::INT AS condition_id, (doc_id % 5)::INT AS category_id FROM documents""",
    "prepped": """SELECT *, regexp_replace(lower(name), '[^0-9a-z]', '', 'g') AS t_title, ' ' || trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) || ' ' AS s_title,
        regexp_replace(lower(description), '[^0-9a-z]', '', 'g') AS t_desc, ' ' || trim(regexp_replace(lower(description), '[^0-9a-z]+', ' ', 'g')) || ' ' AS s_desc FROM listings""",
    "alerts": "SELECT * FROM (VALUES "
    + _values([(_q(a["name"]), _q(a.get("label") or a["name"]), str(a.get("paused", False)), str(a.get("price_max", "NULL")), str(a.get("target_price", "NULL")), str(len(a.get("queries") or [0])), str(a.get("per_query_limit", 30)), f"{a.get('rejected_ids') or []}::VARCHAR[]", str(a.get("min_interval_minutes", "NULL"))) for a in ALERTS])
    + ") v(alert, label, paused, price_max, target_price, queries, per_query_limit, rejected_ids, min_interval_minutes)",
    "params": "SELECT * FROM (VALUES " + _values([(_q(a["name"]), str((a.get("match") or {}).get("min_score", 3.0)), "0.55", _q((a.get("match") or {"scope": "title"}).get("scope", "full"))) for a in ALERTS]) + ") v(alert, min_score, borderline_ratio, scope)",
    "rules": "SELECT alert, kind, grp::INT AS grp, ord::INT AS ord, term, term_t, weight::DOUBLE AS weight FROM (VALUES " + _values(_rule_rows()) + ") v(alert, kind, grp, ord, term, term_t, weight)",
    "tokens": "SELECT * FROM (VALUES " + _values([(_q(a["name"]), str(i), _q(q), _q(w)) for a in _LIVE for i, q in enumerate(a["queries"]) for w in q.split()]) + ") v(alert, query_ord, query, term_t)",
    "hits": f"SELECT * FROM (SELECT id, term_t, {_hit('term_t', 't_title', 's_title')} AS in_title, {_hit('term_t', 't_desc', 's_desc')} AS in_desc FROM prepped, (SELECT DISTINCT term_t FROM rules)) WHERE in_title OR in_desc",
    "matches": f"""SELECT alert, query_ord, query, id, created FROM (SELECT q.alert, q.query_ord, q.query, p.id, p.created, count(*) AS n FROM prepped p, tokens q
        WHERE ({_hit('term_t', 't_title', 's_title')} OR {_hit('term_t', 't_desc', 's_desc')}) AND (alert <> 'german' OR (price <= 3000 AND category_id IN (1, 2, 3))) AND (alert <> 'romance' OR NOT contains(s_desc, ' idiot '))
        GROUP BY q.alert, q.query_ord, q.query, p.id, p.created) JOIN (SELECT alert, query_ord, count(*) AS need FROM tokens GROUP BY alert, query_ord) USING (alert, query_ord) WHERE n = need""",
    "found": "SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY alert, query_ord ORDER BY created DESC, id) AS rank FROM matches m) JOIN (SELECT alert, per_query_limit FROM alerts) USING (alert) WHERE rank <= per_query_limit",
    "candidates": "SELECT DISTINCT alert, id, substr(id, 2)::BIGINT AS pos FROM matches",
    "rule_hits": "SELECT alert, id, kind, grp, ord, term, weight, in_title, in_desc FROM hits JOIN rules USING (term_t)",
    "judged_title": """SELECT c.alert, c.id, c.pos, min_score, borderline_ratio, scope, (SELECT arg_min(term, ord) FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND kind = 'exclude' AND in_title) AS excluded_by,
        coalesce((SELECT sum(weight * 1.25) FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND kind = 'signal' AND in_title), 0) AS raw,
        (SELECT count(DISTINCT grp) FROM rules r WHERE r.alert = c.alert AND kind = 'require') - (SELECT count(DISTINCT grp) FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND kind = 'require' AND in_title) AS missing FROM candidates c JOIN params USING (alert)""",
    "judged_full": """SELECT c.alert, c.id, c.pos, min_score, borderline_ratio, scope, (SELECT arg_min(term, ord) FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND kind = 'exclude') AS excluded_by,
        coalesce((SELECT sum(weight * CASE WHEN in_title THEN 1.25 ELSE 1 END) FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND kind = 'signal'), 0) AS raw,
        (SELECT count(DISTINCT grp) FROM rules r WHERE r.alert = c.alert AND kind = 'require') - (SELECT count(DISTINCT grp) FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND kind = 'require') AS missing FROM candidates c JOIN params USING (alert)""",
    "title_status": "SELECT *, CASE WHEN excluded_by IS NOT NULL OR missing > 0 THEN 'reject' WHEN raw >= min_score THEN 'match' WHEN raw >= min_score * borderline_ratio THEN 'borderline' ELSE 'reject' END AS status FROM judged_title",
    "full_status": "SELECT *, CASE WHEN excluded_by IS NOT NULL OR missing > 0 THEN 'reject' WHEN raw >= min_score THEN 'match' WHEN raw >= min_score * borderline_ratio THEN 'borderline' ELSE 'reject' END AS status FROM judged_full",
    "undecided": "SELECT alert, id FROM title_status WHERE excluded_by IS NULL AND scope = 'full' AND status <> 'match'",
    "two_phase": """SELECT alert, id, pos, status, CASE WHEN excluded_by IS NOT NULL THEN 0 ELSE round(raw, 2) END AS score FROM title_status ANTI JOIN undecided USING (alert, id)
        UNION ALL SELECT alert, id, pos, status, CASE WHEN excluded_by IS NOT NULL THEN 0 ELSE round(raw, 2) END AS score FROM full_status SEMI JOIN undecided USING (alert, id)""",
    "seen": f"SELECT 'english' AS alert, {_ID} AS id, {_TS} AS run_ts, doc_id AS pos FROM documents WHERE doc_id % 2 = 0",
    "printed": "SELECT *, substr(sha1(t_title || '|' || coalesce(floor(price / 500)::BIGINT, 0) || '|' || coalesce(seller_id, '')), 1, 16) AS fp FROM prepped",
    "fingerprints": "SELECT fp, id, created::TIMESTAMP AS t FROM printed WHERE status = 'sold'",
    "events_": "SELECT event_type AS alert, event_id AS id, ts, value AS price FROM events",
    "feed": "SELECT event_id::VARCHAR AS id, event_type AS alert, CASE WHEN event_id % 3 = 0 THEN 'borderline' ELSE 'match' END AS status, ts AS detected_at, event_id AS pos FROM events",
    "cards": """SELECT (conv_id // 8)::VARCHAR AS alert, lpad(conv_id::VARCHAR, 12, '0') || '-' || lpad(turn::VARCHAR, 6, '0') AS id, CASE WHEN conv_id % 3 = 0 THEN 'confirmed' WHEN turn % 2 = 1 THEN 'rejected' END AS mark, length(text) / 4 AS score,
        list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS tterms, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS tt FROM conversations""",
    "marks": "SELECT alert, count(*) FILTER (mark = 'confirmed') AS confirmed, count(*) FILTER (mark = 'rejected') AS rejected, count(*) FILTER (mark IS NULL) AS unmarked FROM cards GROUP BY alert",
}
NEEDS = {
    "prepped": ["listings"],
    "hits": ["prepped", "rules"],
    "matches": ["prepped", "tokens"],
    "found": ["matches", "alerts"],
    "candidates": ["matches"],
    "rule_hits": ["hits", "rules"],
    "judged_title": ["candidates", "rule_hits", "params"],
    "judged_full": ["candidates", "rule_hits", "params"],
    "title_status": ["judged_title"],
    "full_status": ["judged_full"],
    "undecided": ["title_status"],
    "two_phase": ["undecided", "full_status"],
    "printed": ["prepped"],
    "fingerprints": ["printed"],
    "marks": ["cards"],
}


def sql(names: list[str], select: str, instead: dict[str, tuple[list[str], str]] | None = None) -> str:
    """`select` with the expressions it names, and those that they need, before it. instead: other
    expressions by name, each with what it needs."""
    order: list[str] = []
    instead = instead or {}

    def add(n: str) -> None:
        for m in instead[n][0] if n in instead else NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({instead[n][1] if n in instead else CTE[n]})" for n in order) + "\n" + select if order else select
