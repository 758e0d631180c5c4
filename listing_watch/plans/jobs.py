"""Queries of whole jobs and of documents in and out: the watch job with its state, alert files, feed,
status and result documents, and refining on cards that give proposals of every kind."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match as mt
from ..operators import refine as rf
from ..operators import reports as rp
from ..sources import alerts as al
from ..sources import results as rs
from ..sources.store import new_path, stored
from . import registry_parts as parts
from . import views as v
from .watch import empty_state, watch_run, watch_step

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
query = parts.registrar(QUERIES, ORACLE_SQL)

# the watch job -----------------------------------------------------------------------------------


def _prices(s: SparkSession, d: str) -> DataFrame:
    """Events as prices met before, by turns of two alerts."""
    alert = F.when(F.col("id") % 2 == 0, "german").otherwise("romance")
    return v.events(s, d).select(alert.alias("alert"), (F.col("price") * 100).cast("long").alias("price"), F.col("ts").alias("run_ts"), F.col("id").alias("pos"))


def _run(s: SparkSession, d: str, dry: bool) -> dict[str, DataFrame]:
    return watch_run(v.listings(s, d), v.alerts(s), v.runs(s), v.seen(s, d), v.fingerprints(s, d), _prices(s, d), v.now(), v.PREFIX, "shop", dry_run=dry)


_SHOWN = ["id", "alert", "status", "score", "deal", "relist", "target_hit", "lag_seconds"]
_NOW = f"TIMESTAMP '{v.NOW}'"


def _watch_sql(select: str, dry: bool) -> str:
    """The run in SQL: the alerts that are due, their candidates, verdicts, reposts and deals."""
    due = "('english'), ('german'), ('romance')" if dry else "('german'), ('romance')"
    gone = ", ".join(f"('{a['name']}', {v._q(i)})" for a in v.ALERTS for i in a.get("rejected_ids", []))
    first = f"SELECT f.alert, id, query_ord, rank, row_number() OVER (PARTITION BY f.alert, id ORDER BY query_ord, rank) AS n FROM found f JOIN (VALUES {due}) d(alert) USING (alert) ANTI JOIN (VALUES {gone}) g(alert, id) USING (alert, id)"
    pooled = f"SELECT alert, id, row_number() OVER (PARTITION BY alert ORDER BY query_ord, rank, id) - 1 AS pos, alert = 'romance' AS first_run FROM ({first}) WHERE n = 1"
    earlier = "FALSE" if dry else "EXISTS (SELECT 1 FROM hit e WHERE e.fp = m.fp AND (e.alert, e.pos) < (m.alert, m.pos))"
    more = {
        "candidates": (["found"], pooled),
        "prices": ([], "SELECT CASE WHEN event_id % 2 = 0 THEN 'german' ELSE 'romance' END AS alert, trunc(value * 100)::BIGINT AS price, ts AS run_ts, event_id AS pos FROM events"),
        "medians": (["prices"], "SELECT alert, median(price) AS median FROM prices GROUP BY alert HAVING count(*) >= 4"),
        "hit": (["two_phase", "printed", "candidates"], "SELECT t.alert, t.id, t.pos, t.status, t.score, c.first_run, p.fp, p.price, p.created FROM two_phase t JOIN candidates c USING (alert, id) JOIN printed p USING (id) WHERE t.status = 'match'"),
        "flagged": (["hit", "fingerprints"], f"SELECT m.*, NOT first_run AND (fp IN (SELECT fp FROM fingerprints) OR {earlier}) AS relist FROM hit m"),
        "kept": (["flagged", "medians"], "SELECT f.*, NOT first_run AND coalesce(price <= median * 0.75, FALSE) AS deal FROM flagged f LEFT JOIN medians USING (alert) WHERE NOT (alert = 'german' AND relist)"),
        "near": (["two_phase", "candidates", "listings"], "SELECT * FROM (SELECT t.*, l.price, l.created, row_number() OVER (PARTITION BY alert ORDER BY t.pos) AS k FROM two_phase t JOIN candidates c USING (alert, id) JOIN listings l USING (id) WHERE t.status = 'borderline' AND NOT c.first_run) WHERE k <= 8"),
    }
    lag = f"CASE WHEN epoch({_NOW} - (created::TIMESTAMP - INTERVAL 9 HOUR)) BETWEEN 0 AND 34559999 THEN floor(epoch({_NOW} - (created::TIMESTAMP - INTERVAL 9 HOUR)))::BIGINT END"
    rows = f"""SELECT id, alert, CASE WHEN first_run THEN 'baseline' ELSE 'match' END AS status, score, deal, relist, coalesce(alert = 'english' AND price <= 1500, FALSE) AS target_hit, {lag} AS lag_seconds FROM kept
        UNION ALL SELECT id, alert, status, score, FALSE, FALSE, coalesce(alert = 'english' AND price <= 1500, FALSE), {lag} FROM near"""
    return v.sql(["kept", "near"], select or rows, more)


@query(sql=_watch_sql("", False))
def watch(s, d):
    return _run(s, d, False)["entries"].select(*_SHOWN)


@query(sql=_watch_sql("", True))
def dry_run(s, d):
    """The run that judges every candidate and keeps no state."""
    return _run(s, d, True)["entries"].select(*_SHOWN)


def _of(table: str, alert, key, value) -> list:
    return [F.lit(table).alias("part"), alert.cast("string").alias("alert"), key.cast("string").alias("key"), value.cast("long").alias("value")]


@query(
    sql=_watch_sql(
        f"""SELECT 'seen' AS part, alert, id AS key, pos AS value FROM candidates
    UNION ALL SELECT * FROM (SELECT 'seen', 'english', '{"m"}' || lpad(doc_id::VARCHAR, 8, '0'), doc_id FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id DESC LIMIT 600)
    UNION ALL SELECT * FROM (SELECT 'fingerprints', '', fp || '/' || id, epoch(t)::BIGINT FROM (SELECT fp, id, t FROM fingerprints WHERE fp NOT IN (SELECT fp FROM kept) UNION ALL SELECT fp, id, {_NOW} FROM kept) WHERE t >= {_NOW} - INTERVAL 45 DAY ORDER BY t DESC, fp LIMIT 4000)
    UNION ALL SELECT 'prices', alert, '', price FROM (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY run_ts DESC, pos DESC) AS n FROM (SELECT alert, price, run_ts, pos FROM prices UNION ALL SELECT alert, price::BIGINT, {_NOW}, pos FROM kept) WHERE price > 0) WHERE n <= 60
    UNION ALL SELECT 'runs', alert, 'TRUE', epoch({_NOW})::BIGINT FROM (VALUES ('english'), ('german'), ('romance')) r(alert)""",
        False,
    )
)
def watch_state(s, d):
    """The state that the run leaves: seen ids, fingerprints, prices and runs."""
    out = _run(s, d, False)
    c, none = F.col, F.lit("")
    seen = out["seen"].select(*_of("seen", c("alert"), c("id"), c("pos")))
    fps = out["fingerprints"].select(*_of("fingerprints", none, F.concat_ws("/", "fp", "id"), F.unix_timestamp("t")))
    prices = out["prices"].select(*_of("prices", c("alert"), none, c("price")))
    runs = out["runs"].select(*_of("runs", c("alert"), F.upper(c("initialized").cast("string")), F.unix_timestamp("last_checked")))
    return seen.unionByName(fps).unionByName(prices).unionByName(runs)


@query(
    sql=_watch_sql(
        """SELECT a.alert, queries::INT AS queries, CASE WHEN NOT paused THEN epoch(TIMESTAMP '2024-03-01 00:00:00')::BIGINT END AS checked, coalesce(known, 0) AS known_listings, coalesce(m24, 0) AS matches_24h
    FROM alerts a LEFT JOIN (SELECT alert, count(*) AS known FROM (SELECT alert, id FROM candidates UNION ALL SELECT * FROM (SELECT 'english', doc_id FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id DESC LIMIT 600)) GROUP BY alert) k USING (alert)
    LEFT JOIN (SELECT alert, count(*) AS m24 FROM (SELECT alert, id, row_number() OVER (PARTITION BY id ORDER BY alert) AS n FROM (SELECT alert, id FROM kept UNION ALL SELECT alert, id FROM near)) JOIN kept USING (alert, id) WHERE n = 1 AND NOT first_run GROUP BY alert) m USING (alert)""",
        False,
    )
)
def watch_status(s, d):
    """The status after the run, its feed having been empty before."""
    state = {**empty_state(s), "runs": v.runs(s), "seen": v.seen(s, d), "fingerprints": v.fingerprints(s, d), "prices": _prices(s, d)}
    out = watch_step(v.listings(s, d), v.alerts(s), state, v.now(), 1, v.PREFIX, "shop")["status"]
    return out.select("alert", "queries", F.unix_timestamp("last_checked").alias("checked"), "known_listings", "matches_24h")


# alert files ---------------------------------------------------------------------------------------


def _alert_rows(s: SparkSession, d: str) -> list[dict]:
    """An alert for each source of the documents."""
    rows = s.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()  # sources are few
    out = []
    for i, r in enumerate(rows):
        name = str(r["source"])
        a = {"name": name, "queries": [name, " ", f"{name} new"], "per_query_limit": r["n"], "match": {"require": [name, ["old", name]], "signals": {name: 2.5, "rare": r["n"]}, "exclude": [f"not {name}", "複製"], "min_score": 3.5}, "rejected_ids": ["m1", "m1", ""]}
        if i % 4 == 1:
            a = {"name": name, "keyword": f"{name} shop", "label": "", "paused": True}
        if i % 4 == 2:
            a["match"] = {"signals": [name, "rare"], "scope": "title"}
            a["presets"] = ["no_graded", "unknown"]
            a["use_default_excludes"] = False
        out.append(a)
    return out


def _loaded(s: SparkSession, d: str) -> DataFrame:
    """Those alerts, every other one from a JSON and from a YAML file, as read back."""
    import yaml

    rows = _alert_rows(s, d)
    paths = {kind: new_path(s, f"alerts-{kind}") for kind in ("json", "yaml")}
    for kind, text in (("json", json.dumps({"alerts": rows[::2]})), ("yaml", yaml.safe_dump({"alerts": rows[1::2]}, sort_keys=False))):
        s.createDataFrame([(text,)], "value string").coalesce(1).write.text(paths[kind])
    return al.load_alerts(s, paths["json"], paths["yaml"])


_SOURCES = "SELECT source AS name, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS i FROM documents GROUP BY source"
_GIVEN = "CASE WHEN i % 4 = 1 THEN '' ELSE name || '| |' || name || ' new' END"


@query(sql=f"SELECT name, CASE WHEN i % 2 = 0 THEN 'json' ELSE 'yaml' END AS source, {_GIVEN} AS queries, CASE WHEN i % 4 <> 1 THEN n END AS per_query_limit FROM ({_SOURCES})")
def load_alerts(s, d):
    return _loaded(s, d).select("name", "source", F.array_join("queries", "|").alias("queries"), "per_query_limit")


@query(sql=f"SELECT name, i % 4 = 1 AS by_keyword FROM ({_SOURCES})")
def validate_alerts(s, d):
    return al.validate_alerts(_loaded(s, d)).select("name", F.col("keyword").isNotNull().alias("by_keyword"))


@query(sql=f"SELECT name, name AS label, CASE WHEN i % 4 = 1 THEN name || ' shop' ELSE name || '|' || name || ' new' END AS queries, i % 4 = 1 AS paused, CASE WHEN i % 4 = 1 THEN 30 ELSE n END AS per_query_limit, i % 4 <> 2 AS use_default_excludes, CASE WHEN i % 4 = 1 THEN '' ELSE 'm1' END AS rejected FROM ({_SOURCES})")
def alert_defaults(s, d):
    a = al.alert_defaults(_loaded(s, d))
    return a.select("name", "label", F.array_join("queries", "|").alias("queries"), "paused", "per_query_limit", "use_default_excludes", F.array_join("rejected_ids", "|").alias("rejected"))


_KANA = [(i, x, t) for i, (x, t) in enumerate(zip(al.DEFAULT_EXCLUDES, ["複製", "りぷろ", "れぷりか", "こぴー品", "偽物", "自作", "だみー", "空箱", "箱のみ", "けーすのみ", "説明書のみ", "取扱説明書のみ", "外箱のみ", "求む", "探しています", "譲ってください", "買取"]))]
_T = "regexp_replace(lower({0}), '[^0-9a-z]', '', 'g')"
_RULES = f"""src AS ({_SOURCES}),
defaults AS (SELECT * FROM (VALUES {", ".join(f"({i}, {v._q(x)}, {v._q(t)})" for i, x, t in _KANA)}) v(ord, term, term_t)),
rules AS (SELECT name AS alert, 'exclude' AS kind, NULL::INT AS grp, ord::INT AS ord, term, term_t, NULL::DOUBLE AS weight FROM src, defaults WHERE i % 4 <> 2
UNION ALL SELECT name, 'exclude', NULL, 17, 'not ' || name, 'not' || {_T.format("name")}, NULL FROM src WHERE i % 4 IN (0, 3)
UNION ALL SELECT name, 'exclude', NULL, x.ord, x.term, x.term_t, NULL FROM src, (VALUES (0, 'PSA', 'psa'), (1, 'BGS', 'bgs'), (2, 'ARS', 'ars'), (3, '鑑定済', '鑑定済')) x(ord, term, term_t) WHERE i % 4 = 2
UNION ALL SELECT name, 'require', 0, 0, name, {_T.format("name")}, NULL FROM src WHERE i % 4 IN (0, 3)
UNION ALL SELECT name, 'require', 1, 0, 'old', 'old', NULL FROM src WHERE i % 4 IN (0, 3)
UNION ALL SELECT name, 'require', 1, 1, name, {_T.format("name")}, NULL FROM src WHERE i % 4 IN (0, 3)
UNION ALL SELECT name, 'require', 0, 0, name || ' shop', {_T.format("name")} || 'shop', NULL FROM src WHERE i % 4 = 1
UNION ALL SELECT name, 'signal', NULL, 0, name || ' shop', {_T.format("name")} || 'shop', 5 FROM src WHERE i % 4 = 1
UNION ALL SELECT name, 'signal', NULL, 0, name, {_T.format("name")}, CASE WHEN i % 4 = 2 THEN 1 ELSE 2.5 END FROM src WHERE i % 4 <> 1
UNION ALL SELECT name, 'signal', NULL, 1, 'rare', 'rare', CASE WHEN i % 4 = 2 THEN 1 ELSE n END FROM src WHERE i % 4 <> 1)"""


@query(sql=f"WITH {_RULES}\nSELECT * FROM rules")
def flatten_rules(s, d):
    return al.flatten_rules(al.alert_defaults(_loaded(s, d))).select("alert", "kind", "grp", "ord", "term", "term_t", "weight")


@query(
    sql=f"""WITH {_RULES}
SELECT alert, coalesce(string_agg(g, '/' ORDER BY grp), '') AS require, coalesce(any_value(sg), '') AS signals, coalesce(any_value(ex), '') AS exclude FROM
(SELECT alert, string_agg(term_t || '=' || round(weight)::BIGINT::VARCHAR, '|' ORDER BY term_t) FILTER (kind = 'signal') AS sg, string_agg(term_t, '|' ORDER BY ord) FILTER (kind = 'exclude') AS ex FROM rules GROUP BY alert)
LEFT JOIN (SELECT alert, grp, string_agg(term_t, '|' ORDER BY ord) AS g FROM rules WHERE kind = 'require' GROUP BY alert, grp) USING (alert) GROUP BY alert"""
)
def rule_tights(s, d):
    r = rf.rule_tights(al.flatten_rules(al.alert_defaults(_loaded(s, d))))
    signals = F.array_join(F.array_sort(F.transform(F.map_entries("signals"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"]).cast("long").cast("string")))), "|")
    return r.select("alert", F.array_join(F.transform("require", lambda g: F.array_join(g, "|")), "/").alias("require"), signals.alias("signals"), F.array_join("exclude", "|").alias("exclude"))


# documents out and back in -------------------------------------------------------------------------


@query(["feed"], "SELECT id, alert, status, floor(epoch(detected_at))::BIGINT AS detected, pos FROM feed")
def write_feed(s, d):
    path = new_path(s, "feed")
    rs.write_feed(v.feed(s, d), path)
    return s.read.parquet(path).select("id", "alert", "status", F.unix_timestamp("detected_at").alias("detected"), "pos")


@query(["feed"], "SELECT alert, count(*) FILTER (status = 'match') AS matches, max(floor(epoch(detected_at))::BIGINT) AS last FROM feed GROUP BY alert")
def write_status(s, d):
    path = new_path(s, "status")
    rs.write_status(v.feed(s, d).groupBy("alert").agg(F.count_if(F.col("status") == "match").alias("matches"), F.unix_timestamp(F.max("detected_at")).alias("last")), path)
    return s.read.schema("alert string, matches long, last long").json(path)


def _results(s: SparkSession, d: str) -> str:
    """Previews of the alerts, written as result documents."""
    w = v.Work(s, d)
    judged = stored(mt.two_phase_verdicts(w.candidates, w.hits, w.rules, w.params), "judged")
    judged = judged.join(w.listings.select("id", "name", "description", "created"), "id")
    path = new_path(s, "results")
    rs.write_result(rp.preview_summary(judged, w.params, v.alerts(s), v.now()), rp.preview_sample(judged), path)
    return path


_PLACED = "SELECT alert, id, status, score, row_number() OVER (PARTITION BY alert, status ORDER BY score DESC, pos) AS place FROM two_phase WHERE status <> 'reject'"


@query(["two_phase"], f"SELECT alert AS alert_name, CASE WHEN status = 'match' THEN 'sample' ELSE 'near_misses' END AS part, (place - 1)::INT AS ord, id, status, score FROM ({_PLACED}) WHERE place <= CASE WHEN status = 'match' THEN 24 ELSE 8 END")
def read_results(s, d):
    return rs.read_results(s, _results(s, d)).select("alert_name", "part", "ord", "id", "status", "score")


@query(["two_phase", "params"], "SELECT p.alert AS alert_name, 'preview' AS kind, 'ok' AS status, count(t.id) AS candidates, count(*) FILTER (t.status = 'match') AS matched, count(*) FILTER (t.status = 'borderline') AS borderline, min_score::DOUBLE AS min_score FROM params p LEFT JOIN two_phase t USING (alert) GROUP BY p.alert, min_score")
def write_result(s, d):
    return s.read.schema(rs.RESULT).json(_results(s, d)).select("alert_name", "kind", "status", "candidates", "matched", "borderline", "min_score")


# refining on single conversations ---------------------------------------------------------------------

_SINGLE = {
    "cards": (
        [],
        v.CTE["cards"].replace("(conv_id // 8)::VARCHAR", "conv_id::VARCHAR").replace("conv_id % 3 = 0", "turn % 3 = 0").replace("turn % 2 = 1", "turn % 3 = 1"),
    )
}
_VOCAB = """{0}_vocab AS (SELECT DISTINCT alert, unnest(tterms) AS tterm FROM cards WHERE mark = '{0}'),
{0}_spread AS (SELECT x.alert, x.tterm, count(*) FILTER (mark = 'confirmed') AS c, count(*) FILTER (mark = 'rejected') AS r, count(*) FILTER (mark IS NULL) AS u FROM {0}_vocab x JOIN cards k ON k.alert = x.alert AND contains(k.tt, x.tterm) GROUP BY ALL)"""
_REQUIRES = """require_rows AS (SELECT s.alert, tterm, confirmed AS count FROM confirmed_spread s JOIN marks USING (alert) WHERE rejected > 0 AND c = confirmed AND r = 0 AND length(tterm) <> 3 AND tterm <> 'the'),
requires AS (SELECT * FROM (SELECT alert, row_number() OVER (PARTITION BY alert ORDER BY length(tterm) DESC, tterm) AS place, tterm, count FROM require_rows a WHERE NOT EXISTS (SELECT 1 FROM require_rows b WHERE b.alert = a.alert AND b.tterm <> a.tterm AND contains(b.tterm, a.tterm))) WHERE place <= 8)"""
_EXCLUDES = f"""exclude_rows AS (SELECT s.alert, tterm, r AS count FROM rejected_spread s JOIN marks USING (alert) WHERE tterm NOT IN ('that', 'the') AND NOT {parts.OWN} AND CASE WHEN confirmed > 0 THEN c = 0 ELSE u = 0 END)"""
_HALF = "floor((clears + blocks) / 2 * 10 + 0.5) / 10"
_THRESHOLDS = f"""thresholds AS (SELECT alert FROM (SELECT alert, min(score) FILTER (CASE WHEN confirmed > 0 THEN mark = 'confirmed' ELSE mark IS NULL END) AS clears, max(score) FILTER (mark = 'rejected') AS blocks FROM cards JOIN marks USING (alert) WHERE rejected > 0 GROUP BY alert)
WHERE blocks < clears AND {_HALF} > 3 AND {_HALF} <= clears)"""


def _single_sql(steps: list[str], select: str) -> str:
    return v.sql(["marks"], "", _SINGLE).rstrip() + "".join(",\n" + x for x in steps) + "\n" + select


@query(sql=_single_sql([_VOCAB.format("confirmed"), _REQUIRES], "SELECT * FROM requires"))
def suggest_requires_single(s, d):
    return rf.suggest_requires(v.cards(s, d, True), v.card_rules(s, d, True)).select("alert", "place", "tterm", "count")


@query(
    sql=_single_sql(
        [_VOCAB.format("confirmed"), _VOCAB.format("rejected"), _REQUIRES, _EXCLUDES, _THRESHOLDS],
        """SELECT alert, (CASE WHEN confirmed > 0 THEN confirmed ELSE unmarked END) = 0 AS nothing_kept, confirmed = 0 AND unmarked > 0 AS nothing_confirmed,
    confirmed > 0 AND alert NOT IN (SELECT alert FROM exclude_rows UNION SELECT alert FROM requires UNION SELECT alert FROM thresholds) AS nothing_found FROM marks WHERE rejected > 0""",
    )
)
def suggest_warnings_single(s, d):
    c, r = v.cards(s, d, True), v.card_rules(s, d, True)
    least = c.select("alert").distinct().withColumn("min_score", F.lit(3.0))
    return rf.suggest_warnings(c, rf.suggest_excludes(c, r), rf.suggest_requires(c, r), rf.suggest_threshold(c, least))
