"""Registered queries of the library, each over the whole of the tables it names, and their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, session, terms, text
from ..operators import feed as fd
from ..operators import hits as ht
from ..operators import learn as ln
from ..operators import match as mt
from ..operators import refine as rf
from ..operators import reports as rp
from ..operators import retrieve as rt
from ..operators import state as st
from ..sources import alerts as al
from ..sources.store import stored
from . import japanese, jobs, learn_sql
from . import views as v
from .registry_parts import OWN, Query, registrar

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


# sources -----------------------------------------------------------------------------------


@query(["listings"], "SELECT id, name, description, price, thumbnail, seller_id, status, created, condition_id, category_id FROM listings")
def normalize_listings(s, d):
    raw = v.listings(s, d).select(F.col("id").alias("itemId"), F.lit("").alias("id_"), F.col("name").alias("title"), "description", F.col("price").alias("productPrice"), F.col("seller_id").alias("sellerId"), "status", F.col("created").alias("createdAt"), F.col("condition_id").alias("itemConditionId"), F.col("category_id").alias("categoryId"))
    return al.normalize_listings(raw)


@query(["listings"], "SELECT CASE WHEN doc_id % 2 = 0 THEN 'm' || lpad(doc_id::VARCHAR, 8, '0') END AS item_id, doc_id FROM documents")
def recover_item_id(s, d):
    raw = _docs(s, d).select("doc_id", F.col("lang").alias("aaa"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))).alias("ref"), "source").alias("data"))
    return raw.select("doc_id", al.recover_item_id(raw).alias("item_id"))


@query([], "SELECT page_id, nullif(CASE WHEN starts_with(trim(url), 'http') THEN list_last(string_split(rtrim(split_part(trim(url), '?', 1), '/'), '/')) ELSE trim(url) END, '') AS item_id FROM pages")
def parse_item_id(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", scalars.parse_item_id(F.col("url")).alias("item_id"))


@query([], "SELECT 'src' || source AS name, count(*) AS n, 'old' AS label FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 0) GROUP BY source UNION ALL SELECT 'src' || source, count(*), 'new' FROM documents WHERE doc_id % 50 = 0 GROUP BY source")
def upsert_alert(s, d):
    docs = _docs(s, d).withColumn("name", F.concat(F.lit("src"), "source"))
    rows = lambda x, label: x.groupBy("name").agg(F.count("*").alias("n")).withColumn("label", F.lit(label))
    return al.upsert_alert(rows(docs, "old"), rows(docs.filter("doc_id % 50 = 0"), "new"))


# text and scalars --------------------------------------------------------------------------


@query([], "SELECT doc_id, sha256(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) AS tight_sha FROM documents")
def tight(s, d):
    return _docs(s, d).select("doc_id", F.sha2(text.tight(F.col("text")), 256).alias("tight_sha"))


@query([], "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'))) AS spaced_sha FROM documents")
def spaced(s, d):
    return _docs(s, d).select("doc_id", F.sha2(text.spaced(F.col("text")), 256).alias("spaced_sha"))


@query([], "SELECT doc_id, sha256(text) AS sha FROM documents")
def kata_to_hira(s, d):
    return _docs(s, d).select("doc_id", F.sha2(text.kata_to_hira(F.col("text")), 256).alias("sha"))


@query([], "SELECT doc_id, sha256(nfc_normalize(text)) AS sha FROM documents")
def nfkc(s, d):
    return _docs(s, d).select("doc_id", F.sha2(text.nfkc(F.col("text")), 256).alias("sha"))


@query(["prepped"], "SELECT id, sha256(t_desc) AS t_sha, sha256(s_desc) AS s_sha FROM prepped")
def prep(s, d):
    return v.prepped(s, d).select("id", F.sha2("t_desc", 256).alias("t_sha"), F.sha2("s_desc", 256).alias("s_sha"))


@query(["prepped"], f"SELECT id, {v._hit(repr('with'), 't_desc', 's_desc')} AS with_, {v._hit(repr('licensed'), 't_desc', 's_desc')} AS licensed FROM prepped")
def contains_term(s, d):
    has = lambda w: text.contains_term(F.lit(w), F.col("t_desc"), F.col("s_desc"))
    return v.prepped(s, d).select("id", has("with").alias("with_"), has("licensed").alias("licensed"))


@query(["prepped"], "SELECT id, CASE WHEN contains(s_desc, ' nicht ') OR t_desc = 'nicht' THEN 'nicht' WHEN contains(t_desc, 'version') THEN 'version' WHEN contains(s_desc, ' para ') OR t_desc = 'para' THEN 'para' END AS first_term FROM prepped")
def contains_any(s, d):
    return v.prepped(s, d).select("id", text.contains_any([F.lit(w) for w in ("nicht", "version", "para")], F.col("t_desc"), F.col("s_desc")).alias("first_term"))


_WORDS = "list_filter(list_transform(regexp_extract_all(text, '[0-9A-Za-z_–—‐‑-]+'), lambda w: trim(w, '-‐‑–—_')), lambda w: w <> '')"


@query([], f"SELECT doc_id, len(ws) AS runs, sha256(array_to_string(ws, ' ')) AS sha FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)")
def script_runs(s, d):
    r = _docs(s, d).select("doc_id", terms.script_runs(F.col("text")).alias("r"))
    return r.select("doc_id", F.size("r").cast("long").alias("runs"), F.sha2(F.array_join(F.transform("r", lambda x: x["surface"]), " "), 256).alias("sha"))


@query()
def extract_terms(s, d):
    r = _docs(s, d).select("doc_id", F.posexplode(terms.extract_terms(F.col("text"))).alias("ord", "x"))
    return r.select("doc_id", "ord", "x.term", "x.term_t")


@query([], f"SELECT doc_id, sha256(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) AS tight_sha, count(term) AS terms FROM documents LEFT JOIN ({learn_sql.terms('documents', 'doc_id', 'text')}) USING (doc_id) GROUP BY doc_id, text")
def sql_functions(s, d):
    """The text layer as SQL has it."""
    session.register(s)
    return s.sql("SELECT doc_id, sha2(tight(text), 256) AS tight_sha, cast(size(extract_terms(text)) AS long) AS terms FROM {docs}", docs=_docs(s, d))


@query([], "SELECT lang, term, 1 + least(length(term), 10) * 0.12::DOUBLE + CASE WHEN regexp_matches(term, '[0-9]') AND regexp_matches(term, '[a-z]') THEN 1.4 WHEN regexp_matches(term, '[0-9]') THEN 0.3 ELSE 0 END AS hint FROM (SELECT DISTINCT lang, unnest(string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term <> ''")
def term_weight_hint(s, d):
    w = _docs(s, d).select("lang", F.explode(F.split(text.spaced(F.col("text")), " ")).alias("term")).filter("term != ''").distinct()
    return w.select("lang", "term", scalars.term_weight_hint(F.col("term"), terms.is_generic(F.col("term"))).alias("hint"))


@query()
def card_terms(s, d):
    c = v.listings(s, d).select("id", terms.card_terms(F.col("name"), F.col("description")).alias("c"))
    joined = lambda k: F.array_join(f"c.{k}", "|").alias(k)
    return c.select("id", joined("terms"), joined("tterms"), joined("generic"), F.sha2("c.tt", 256).alias("tt_sha"))


@query(["listings"], f"SELECT id, '{v.PREFIX}' || id AS url FROM listings")
def item_url(s, d):
    return v.listings(s, d).select("id", scalars.item_url(F.col("id"), v.PREFIX).alias("url"))


@query(["listings"], "SELECT id, CASE condition_id WHEN 1 THEN 'New' WHEN 2 THEN 'Like new' WHEN 3 THEN 'Good' WHEN 4 THEN 'Fair' WHEN 5 THEN 'Worn' WHEN 6 THEN 'Poor' END AS label FROM listings")
def condition_label(s, d):
    return v.listings(s, d).select("id", scalars.condition_label(F.col("condition_id")).alias("label"))


@query(["listings"], "SELECT id, epoch(created::TIMESTAMP - INTERVAL 9 HOUR)::BIGINT AS listed FROM listings")
def parse_listed_at(s, d):
    return v.listings(s, d).select("id", F.unix_timestamp(scalars.parse_listed_at(F.col("created"))).alias("listed"))


@query(["listings"], f"SELECT id, CASE WHEN epoch(TIMESTAMP '{v.NOW}' - (created::TIMESTAMP - INTERVAL 9 HOUR)) BETWEEN 0 AND 34559999 THEN epoch(TIMESTAMP '{v.NOW}' - (created::TIMESTAMP - INTERVAL 9 HOUR))::BIGINT END AS lag FROM listings")
def lag_seconds(s, d):
    return v.listings(s, d).select("id", scalars.lag_seconds(scalars.parse_listed_at(F.col("created")), v.now()).alias("lag"))


@query(["listings"], "SELECT id, price <= 1500 AS hit FROM listings")
def target_hit(s, d):
    return v.listings(s, d).select("id", scalars.target_hit(F.col("price"), F.lit(1500)).alias("hit"))


@query([], "SELECT source, greatest(0.25, least(5.0, log10(1e6 / greatest(count(*), 10)))) AS idf FROM documents GROUP BY source")
def idf_factor(s, d):
    return _docs(s, d).groupBy("source").agg(F.count("*").alias("n")).select("source", scalars.idf_factor(F.col("n")).alias("idf"))


@query(["printed"], "SELECT id, fp FROM printed")
def fingerprint(s, d):
    return v.listings(s, d).select("id", text.fingerprint(text.tight(F.col("name")), F.col("price"), F.col("seller_id")).alias("fp"))


# retrieval ---------------------------------------------------------------------------------


@query([], "SELECT source AS name FROM (SELECT source, max(doc_id) AS m, count(*) AS n FROM documents GROUP BY source) WHERE m % 3 <> 0 AND (n % 2 = 0 OR m % 60 >= 30)")
def active_alerts(s, d):
    g = _docs(s, d).groupBy("source").agg(F.max("doc_id").alias("m"), F.count("*").alias("n"))
    a = g.select(F.col("source").alias("name"), (F.col("m") % 3 == 0).alias("paused"), F.when(F.col("n") % 2 == 1, 30.0).alias("min_interval_minutes"))
    runs = g.select(F.col("source").alias("alert"), (v.now() - F.make_dt_interval(mins=(F.col("m") % 60).cast("int"))).alias("last_checked"))
    return rt.active_alerts(a, runs, v.now()).select("name")


@query(["found"], "SELECT alert, query_ord, id, rank FROM found")
def search_listings(s, d):
    return rt.search_listings(v.Work(s, d).matches, v.alerts(s)).select("alert", F.col("query_ord").cast("int").alias("query_ord"), "id", "rank")


@query(["matches", "tokens"], "SELECT DISTINCT alert, query_ord, query, (SELECT count(*) FROM matches m WHERE m.alert = t.alert AND m.query_ord = t.query_ord) AS total FROM tokens t")
def query_totals(s, d):
    return rt.query_totals(v.Work(s, d).matches, v.alerts(s).filter("not paused"))


_DEFAULTS = ", ".join(f"({v._q(terms.tight_word(x))})" for x in al.DEFAULT_EXCLUDES)


@query(
    ["prepped", "rules"],
    f"""SELECT w.term_t, count(p.id) AS listings FROM (SELECT term_t FROM rules UNION SELECT * FROM (VALUES {_DEFAULTS}) x(term_t)) w
    LEFT JOIN prepped p ON {v._hit('w.term_t', 'p.t_title', 'p.s_title')} OR {v._hit('w.term_t', 'p.t_desc', 'p.s_desc')} GROUP BY w.term_t""",
)
def term_counts(s, d):
    return ht.term_counts(v.prepped(s, d), v.rules(s))


@query(["found"], "SELECT alert, id, query_ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY alert, id ORDER BY query_ord, rank) AS n FROM found) WHERE n = 1")
def pool_candidates(s, d):
    return rt.pool_candidates(rt.search_listings(v.Work(s, d).matches, v.alerts(s))).select("alert", "id", F.col("query_ord").cast("int").alias("query_ord"), "rank")


_GONE = "(SELECT alert, unnest(rejected_ids) AS id FROM alerts)"


@query(
    ["found", "tokens"],
    f"""SELECT t.alert, t.query_ord, (SELECT count(*) FROM matches m WHERE m.alert = t.alert AND m.query_ord = t.query_ord) AS total, (SELECT count(*) FROM found f WHERE f.alert = t.alert AND f.query_ord = t.query_ord) AS returned,
    (SELECT count(*) FROM (SELECT alert, id, min(query_ord) AS q FROM found ANTI JOIN {_GONE} USING (alert, id) GROUP BY ALL) x WHERE x.alert = t.alert AND x.q = t.query_ord) AS new_here,
    (SELECT count(*) FROM found f SEMI JOIN {_GONE} USING (alert, id) WHERE f.alert = t.alert AND f.query_ord = t.query_ord) AS dismissed FROM (SELECT DISTINCT alert, query_ord FROM tokens) t""",
)
def query_breakdown(s, d):
    m, a = v.Work(s, d).matches, v.alerts(s).filter("not paused")
    return rt.query_breakdown(rt.search_listings(m, a), m, a).select("alert", F.col("query_ord").cast("int").alias("query_ord"), "total", "returned", "new_here", "dismissed")


@query(["candidates", "alerts"], f"SELECT alert, id FROM candidates ANTI JOIN {_GONE} USING (alert, id)")
def drop_rejected(s, d):
    return rt.drop_rejected(v.candidates(s, d), v.alerts(s)).select("alert", "id")


@query(["candidates", "seen"], "SELECT alert, id FROM candidates ANTI JOIN seen USING (alert, id)")
def drop_seen(s, d):
    return rt.drop_seen(v.candidates(s, d), v.seen(s, d)).select("alert", "id")


# matching ----------------------------------------------------------------------------------


@query(["hits"], "SELECT * FROM hits")
def term_hits(s, d):
    return v.hits(s, d)


@query(["rule_hits"], "SELECT alert, id, arg_min(term, ord) AS excluded_by FROM rule_hits WHERE kind = 'exclude' GROUP BY alert, id")
def excluded_by(s, d):
    return mt.excluded_by(mt.rule_hits(v.hits(s, d), v.rules(s)))


@query(["candidates", "rule_hits"], "SELECT c.alert, c.id, r.grp FROM candidates c JOIN (SELECT DISTINCT alert, grp FROM rules WHERE kind = 'require') r USING (alert) WHERE NOT EXISTS (SELECT 1 FROM rule_hits h WHERE h.alert = c.alert AND h.id = c.id AND h.kind = 'require' AND h.grp = r.grp)")
def missing_required(s, d):
    w = v.Work(s, d)
    return mt.missing_required(w.candidates, mt.rule_hits(w.hits, w.rules), w.rules)


@query(["rule_hits"], "SELECT alert, id, sum(weight * CASE WHEN in_title THEN 1.25 ELSE 1 END) AS score_raw, string_agg(term, ',' ORDER BY ord) AS hits FROM rule_hits WHERE kind = 'signal' GROUP BY alert, id")
def signal_score(s, d):
    return mt.signal_score(mt.rule_hits(v.hits(s, d), v.rules(s))).withColumn("hits", F.array_join("hits", ","))


def _judge(s, d, with_desc=True):
    w = v.Work(s, d)
    return mt.verdicts(w.candidates, w.hits, w.rules, w.params, with_desc)


def _two_phase(s, d):
    w = v.Work(s, d)
    return mt.two_phase_verdicts(w.candidates, w.hits, w.rules, w.params)


@query(["full_status"], "SELECT alert, id, status, CASE WHEN excluded_by IS NOT NULL THEN 0 ELSE raw END AS score, CASE WHEN excluded_by IS NOT NULL THEN 0 ELSE missing END::INT AS n_missing, excluded_by FROM full_status")
def verdict(s, d):
    return _judge(s, d).select("alert", "id", "status", F.col("score_raw").alias("score"), "n_missing", "excluded_by")


@query(["two_phase"], "SELECT alert, id, status, score FROM two_phase")
def two_phase_verdict(s, d):
    return _two_phase(s, d).select("alert", "id", "status", "score")


@query(["undecided", "candidates"], "SELECT alert, id FROM undecided JOIN candidates USING (alert, id) ORDER BY pos, alert LIMIT 80")
def detail_budget(s, d):
    return mt.detail_budget(_judge(s, d, with_desc=False).filter("needs_description"), 80, ["pos", "alert"]).select("alert", "id")


@query(["two_phase"], "SELECT alert, id, status, score FROM two_phase WHERE status <> 'reject'")
def match_alerts(s, d):
    w = v.Work(s, d)
    return mt.match_alerts(w.listings, w.candidates, w.rules, w.params, w.hits).select("alert", "id", "status", "score")


@query(
    ["full_status", "rule_hits"],
    """SELECT alert, id, status || ' | ' || printf('%.2f of %.2f', CASE WHEN excluded_by IS NOT NULL THEN 0 ELSE round(raw, 2) END, min_score) || ' | ' || CASE WHEN excluded_by IS NOT NULL THEN 'excluded by ' || excluded_by WHEN missing > 0 THEN 'missing required groups: ' || missing
    WHEN raw > 0 THEN 'signals: ' || (SELECT string_agg(term, ', ' ORDER BY ord) FROM rule_hits h WHERE h.alert = f.alert AND h.id = f.id AND kind = 'signal') ELSE 'no signals' END AS line FROM full_status f""",
)
def explain(s, d):
    return mt.explain(_judge(s, d), v.params(s))


# state -------------------------------------------------------------------------------------


@query(
    ["candidates", "seen"],
    f"""SELECT alert, id FROM (SELECT *, row_number() OVER (PARTITION BY alert ORDER BY run_ts DESC, pos, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY alert, id ORDER BY run_ts DESC, pos) AS n FROM
    (SELECT alert, id, run_ts, pos FROM seen UNION ALL SELECT alert, id, TIMESTAMP '{v.NOW}', pos FROM candidates)) WHERE n = 1) WHERE k <= 600""",
)
def record_seen(s, d):
    return st.record_seen(v.seen(s, d), v.candidates(s, d), v.now()).select("alert", "id")


@query(["candidates"], "SELECT alert, id, alert NOT IN ('english', 'german') AS first_run FROM candidates")
def baseline_first_run(s, d):
    return st.baseline_first_run(v.candidates(s, d), v.runs(s)).select("alert", "id", "first_run")


def _prints(s, d):
    fp = text.fingerprint(text.tight(F.col("name")), F.col("price"), F.col("seller_id"))
    return v.listings(s, d).select("id", "status", fp.alias("fp"), F.lit(False).alias("first_run"))


@query(["fingerprints", "printed"], "SELECT id, fp IN (SELECT fp FROM fingerprints) OR id > min(id) OVER (PARTITION BY fp) AS relist FROM printed WHERE status = 'on_sale'")
def flag_relists(s, d):
    return st.flag_relists(_prints(s, d).filter("status = 'on_sale'"), v.fingerprints(s, d), ["id"]).select("id", "relist")


@query(["fingerprints"], "SELECT fp, id FROM fingerprints WHERE t >= TIMESTAMP '2024-01-01 05:00:00' ORDER BY t DESC, fp LIMIT 4000")
def prune_fingerprints(s, d):
    return st.prune_fingerprints(v.fingerprints(s, d), F.to_timestamp(F.lit("2024-02-15 05:00:00"))).select("fp", "id")


_LAST = "SELECT alert, trunc(price)::BIGINT AS price, row_number() OVER (PARTITION BY alert ORDER BY ts DESC, id DESC) AS n FROM events_ WHERE trunc(price) > 0"


def _prices(s, d):
    e = v.events(s, d).select("alert", "price", F.col("ts").alias("run_ts"), F.col("id").alias("pos"))
    return st.record_prices(e.limit(0).withColumn("price", F.col("price").cast("long")), e)


@query(["events_"], f"SELECT alert, price FROM ({_LAST}) WHERE n <= 60")
def record_prices(s, d):
    return _prices(s, d).select("alert", "price")


@query(["events_"], f"SELECT alert, median(price) AS median FROM ({_LAST}) WHERE n <= 60 GROUP BY alert")
def price_median(s, d):
    return st.price_median(_prices(s, d))


_ROLL = "CASE WHEN count(price) OVER w >= 4 THEN median(price) OVER w END AS median"
_FRAME = "WINDOW w AS (PARTITION BY alert ORDER BY ts, id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


@query(["events_"], f"SELECT id, {_ROLL} FROM events_ {_FRAME}")
def rolling_price_median(s, d):
    return st.rolling_price_median(v.events(s, d)).select("id", "median")


@query(["events_"], f"SELECT e.id, price <= m.median * 0.75 AS deal FROM events_ e JOIN (SELECT alert, median(price) AS median FROM ({_LAST}) WHERE n <= 60 GROUP BY alert) m USING (alert)")
def flag_deals(s, d):
    return st.flag_deals(v.events(s, d), st.price_median(_prices(s, d))).select("id", "deal")


# feed --------------------------------------------------------------------------------------


@query(
    ["two_phase", "listings", "alerts"],
    f"SELECT l.id, t.alert, a.label AS alert_label, '{v.PREFIX}' || l.id AS url, l.name, l.price, t.status, t.score, coalesce(l.price <= a.target_price, FALSE) AS target_hit FROM two_phase t JOIN listings l USING (id) JOIN alerts a USING (alert) WHERE t.status <> 'reject'",
)
def make_entries(s, d):
    judged = _two_phase(s, d).filter("status != 'reject'")
    m = judged.join(v.listings(s, d).drop("status"), "id").withColumns({"deal": F.lit(False), "relist": F.lit(False)})
    e = fd.make_entries(m, v.alerts(s), F.col("status"), v.now(), v.PREFIX, "shop")
    return e.select("id", "alert", "alert_label", "url", "name", "price", "status", "score", "target_hit")


@query(["feed"], "SELECT id, CASE WHEN pos % 2 = 0 THEN status ELSE 'match' END AS status FROM feed")
def merge_feed(s, d):
    """The even events are the feed; the new entries are the odd ones and every third, some of which the feed has."""
    f = v.feed(s, d).select("id", "status", "pos")
    return fd.merge_feed(f.filter("pos % 2 = 0"), f.filter("pos % 2 = 1 or pos % 3 = 0").withColumn("status", F.lit("match"))).select("id", "status")


@query(["feed"], "SELECT id FROM feed WHERE detected_at >= (SELECT max(detected_at) FROM feed) - INTERVAL 45 DAY ORDER BY pos DESC LIMIT 400")
def prune_feed(s, d):
    return fd.prune_feed(v.feed(s, d), v.event_now(s, d), [F.desc("pos")]).select("id")


_SINCE = "count(*) FILTER (status = 'match' AND detected_at >= (SELECT max(detected_at) FROM feed) - INTERVAL {} HOUR) AS matches_{}h"


@query(["feed"], f"SELECT alert, {_SINCE.format(24, 24)}, {_SINCE.format(168, 168)} FROM feed GROUP BY alert")
def matches_since(s, d):
    return fd.matches_since(v.feed(s, d), v.event_now(s, d))


@query(
    ["feed", "events_"],
    f"""SELECT alert, count(DISTINCT id) AS known_listings, any_value(m.median) AS median_price, {_SINCE.format(24, 24)}, count(*) FILTER (status = 'match' AND detected_at >= (SELECT max(detected_at) FROM feed) - INTERVAL 168 HOUR) AS matches_7d
    FROM feed f JOIN (SELECT alert, median(price) AS median FROM ({_LAST}) WHERE n <= 60 GROUP BY alert) m USING (alert) GROUP BY alert""",
)
def alert_status(s, d):
    f = v.feed(s, d)
    a = f.select(F.col("alert").alias("name")).distinct().select("name", F.col("name").alias("label"), F.lit(False).alias("paused"), F.array(F.lit("q")).alias("queries"))
    none = v.runs(s).limit(0)
    out = fd.alert_status(a, none, f.select("alert", "id"), st.price_median(_prices(s, d)), f, v.event_now(s, d))
    return out.select("alert", "known_listings", "median_price", "matches_24h", "matches_7d")


@query(
    ["two_phase", "alerts", "listings"],
    f"""SELECT alert, label, section, count(*) OVER (PARTITION BY alert, section) AS n, pos, id, line FROM (SELECT t.alert, t.id, t.pos, a.label, CASE t.status WHEN 'match' THEN 'match' ELSE 'borderline' END AS section,
    CASE WHEN t.status = 'match' THEN l.name ELSE printf('[%.2f] ', t.score) || l.name END || ' | ' || format('{{:,}}', l.price::BIGINT) || ' | {v.PREFIX}' || l.id AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY alert, status ORDER BY pos) AS k FROM two_phase WHERE status <> 'reject') t JOIN listings l USING (id) JOIN alerts a USING (alert) WHERE t.status = 'match' OR k <= 8)""",
)
def digest(s, d):
    m = _two_phase(s, d).join(v.listings(s, d).select("id", "name", "price"), "id").join(v.alerts(s).select(F.col("name").alias("alert"), "label"), "alert")
    cols = ["alert", "label", "pos", "id", "name", "price", "score"]
    return fd.digest(m.filter("status = 'match'").select(*cols), m.filter("status = 'borderline'").select(*cols), v.PREFIX)


# reports -----------------------------------------------------------------------------------


def _sold(s, d):
    judged = _two_phase(s, d).filter("status = 'match'").select("alert", "id", "pos")
    return judged.join(v.listings(s, d).filter("status = 'sold'").select("id", "price"), "id")


@query(["two_phase", "listings"], "SELECT alert, count(*) AS n, min(price) AS min_price, trunc(median(price))::BIGINT AS median_price, trunc(avg(price))::BIGINT AS mean_price, max(price) AS max_price, trunc(median(price) * 1.15)::BIGINT AS suggested_cap FROM two_phase t JOIN listings l USING (id) WHERE t.status = 'match' AND l.status = 'sold' GROUP BY alert")
def comps(s, d):
    return rp.comps(_sold(s, d))


@query(["two_phase", "listings"], "SELECT alert, id, price FROM (SELECT alert, id, price, row_number() OVER (PARTITION BY alert ORDER BY pos) AS n FROM two_phase t JOIN listings l USING (id) WHERE t.status = 'match' AND l.status = 'sold') WHERE n <= 12")
def recent_sold(s, d):
    return rp.recent_sold(_sold(s, d)).select("alert", "id", "price")


@query(
    ["two_phase", "listings", "alerts", "params"],
    """SELECT a.alert, count(t.id) AS candidates, count(*) FILTER (t.status = 'match') AS matched, count(*) FILTER (t.status = 'match' AND l.created::TIMESTAMP - INTERVAL 9 HOUR >= TIMESTAMP '2024-01-01 03:00:00') AS matched_24h, count(*) FILTER (t.status = 'borderline') AS borderline,
    any_value(p.min_score)::DOUBLE AS min_score, any_value(len(rejected_ids))::INT AS hidden_rejected FROM alerts a JOIN params p USING (alert) LEFT JOIN two_phase t USING (alert) LEFT JOIN listings l USING (id) GROUP BY a.alert""",
)
def preview_summary(s, d):
    judged = _two_phase(s, d).select("alert", "id", "status").join(v.listings(s, d).select("id", "created"), "id")
    return rp.preview_summary(judged, v.params(s), v.alerts(s), F.to_timestamp(F.lit("2024-01-02 03:00:00")))


@query(
    ["two_phase"],
    "SELECT alert, id, status, place FROM (SELECT alert, id, status, row_number() OVER (PARTITION BY alert, status ORDER BY score DESC, pos) AS place FROM two_phase WHERE status <> 'reject') WHERE place <= CASE WHEN status = 'match' THEN 24 ELSE 8 END",
)
def preview_sample(s, d):
    judged = _two_phase(s, d).join(v.listings(s, d).select("id", "name", "description"), "id")
    return rp.preview_sample(judged).select("alert", "id", "status", "place")


# learning ----------------------------------------------------------------------------------


def _examples(s, d):
    """Labelled documents as examples: a label for each run of 16 ids, good ones positive."""
    x = _docs(s, d).join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return x.select(F.floor(F.col("doc_id") / 16).cast("string").alias("label_id"), F.col("doc_id").alias("ex_ord"), F.col("quality").alias("polarity"), F.col("doc_id").cast("string").alias("item_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"), F.col("text").alias("description"))


class _Learn:
    """The steps of learning up to the ranked terms, for one query: each stored, as several read it."""

    def __init__(self, s: SparkSession, d: str) -> None:
        p = stored(ht.prepared(_examples(s, d)), "examples")
        self.pos, self.neg = p.filter("polarity = 1"), p.filter("polarity = 0")
        self.terms = stored(ln.collect_candidates(self.pos), "terms")
        self.df = stored(ln.sized(ln.candidate_df(self.terms, self.pos), self.pos), "term-df")
        self.live = ln.live_negatives(self.neg)
        self.corpus = v.prepped(s, d)

    @cached_property
    def _ranked(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return ln.ranked_terms(self.df, self.corpus)

    @property
    def ranked(self) -> DataFrame:
        return self._ranked[0]

    @property
    def kept(self) -> DataFrame:
        return self._ranked[1]

    @property
    def counts(self) -> DataFrame:
        return self._ranked[2]

    def signals(self) -> DataFrame:
        return stored(ln.learn_signals(ln.neg_penalty(self.kept, self.live)), "signals")


def _learned(s, d):
    return ln.learned_rules(stored(ht.prepared(_examples(s, d)), "examples"), v.prepped(s, d))


@query()
def collect_candidates(s, d):
    return ln.collect_candidates(_examples(s, d)).select("label_id", "term_t", "surface", "first_seen.*")


@query()
def candidate_df(s, d):
    return _Learn(s, d).df.select("label_id", "term_t", "df_all", "df_title", "n")


@query()
def rank_candidates(s, d):
    return _Learn(s, d).ranked.select("label_id", "term_t", "surface", "df_all", "df_title", "n", "hint", "listings", "idf", "rank")


@query()
def drop_redundant(s, d):
    return _Learn(s, d).kept.select("label_id", "term_t", "df_all", "rank")


_EXAMPLES = "SELECT (d.doc_id // 16)::VARCHAR AS label_id, d.doc_id AS ex_ord, quality AS polarity, p.t_title, p.s_title, p.t_desc, p.s_desc FROM documents d JOIN labels USING (doc_id) JOIN prepped p ON p.id = 'm' || lpad(d.doc_id::VARCHAR, 8, '0')"


@query(["prepped"], f"SELECT label_id, ex_ord FROM ({_EXAMPLES}) e WHERE polarity = 0 AND NOT EXISTS (SELECT 1 FROM (VALUES {_DEFAULTS}) w(term_t) WHERE {v._hit('w.term_t', 'e.t_title', 'e.s_title')} OR {v._hit('w.term_t', 'e.t_desc', 'e.s_desc')})")
def live_negatives(s, d):
    return ln.live_negatives(ht.prepared(_examples(s, d)).filter("polarity = 0")).select("label_id", "ex_ord")


@query()
def neg_penalty(s, d):
    x = _Learn(s, d)
    return ln.neg_penalty(x.kept, x.live).select("label_id", "term_t", "penalty")


@query()
def learn_signals(s, d):
    return _Learn(s, d).signals()


@query()
def learn_excludes(s, d):
    p = stored(ht.prepared(_examples(s, d)), "examples")
    return ln.learn_excludes(p.filter("polarity = 1"), p.filter("polarity = 0"))


@query()
def learn_require(s, d):
    return ln.learn_require(_Learn(s, d).kept).select("label_id", F.array_join("terms", "|").alias("terms"))


@query()
def learn_threshold(s, d):
    x = _learned(s, d)
    return ln.learn_threshold(x["signals"], x["judged"], True)


@query()
def build_queries(s, d):
    x = _Learn(s, d)
    return ln.build_queries(x.ranked, x.kept, x.pos)


@query()
def coverage_grid(s, d):
    x = _Learn(s, d)
    return ln.coverage_grid(stored(ln.build_queries(x.ranked, x.kept, x.pos), "queries"), x.pos)


@query()
def specificity_report(s, d):
    x = _Learn(s, d)
    return ln.specificity_report(x.counts, x.signals())


@query()
def scoring_report(s, d):
    return ln.scoring_report(_learned(s, d)["judged"]).select("label_id", "polarity", "ex_ord", "status", "score", "excluded_by", "verdict")


@query()
def learn_alert(s, d):
    e = _examples(s, d)
    out = ln.learned_alert(ln.learn_alerts(e, v.prepped(s, d)), e)
    joined = lambda c, to: F.array_join(c, "|").alias(to)
    hundredths = F.transform("match.signals", lambda x: F.round(x["weight"] * 100).cast("long").cast("string"))
    return out.select("name", "label", joined("queries", "queries"), joined(F.flatten("match.require"), "require"), joined("match.signals.term", "signals"), joined(hundredths, "weights"), joined("match.exclude", "exclude"), "match.min_score", joined("learned_from", "learned_from"))


# refining ----------------------------------------------------------------------------------


_CARD_RULES = "(VALUES ('that'), ('the'), ('this'), ('here')) r(t)"


@query(["cards"], "SELECT alert, tterm, arg_min(tterm, (id, ord)) AS term FROM (SELECT alert, id, unnest(tterms) AS tterm, generate_subscripts(tterms, 1) AS ord FROM cards) GROUP BY alert, tterm")
def card_vocab(s, d):
    return rf.card_vocab(v.cards(s, d))


_SPREAD = """vocab AS (SELECT DISTINCT alert, unnest(tterms) AS tterm FROM cards WHERE mark = '{mark}'),
spread AS (SELECT x.alert, x.tterm, count(*) FILTER (mark = 'confirmed') AS c, count(*) FILTER (mark = 'rejected') AS r, count(*) FILTER (mark IS NULL) AS u FROM vocab x JOIN cards k ON k.alert = x.alert AND contains(k.tt, x.tterm) GROUP BY ALL)"""

QUERIES["suggest_excludes"] = lambda s, d: rf.suggest_excludes(v.cards(s, d), v.card_rules(s, d)).select("alert", "place", "tterm", "count", "collateral", "broad", F.col("all").alias("in_all"))
ORACLE_SQL["suggest_excludes"] = (
    v.sql(["marks"], "").rstrip()
    + ",\n"
    + _SPREAD.format(mark="rejected")
    + f""",
rows AS (SELECT s.alert, tterm, r AS count, CASE WHEN confirmed > 0 THEN u ELSE 0 END AS collateral, length(tterm) = 3 AND EXISTS (SELECT 1 FROM cards k WHERE k.alert = s.alert AND list_contains(k.tterms, s.tterm)) AS broad, r = rejected AS in_all
  FROM spread s JOIN marks USING (alert) WHERE tterm NOT IN ('that', 'the') AND NOT {OWN} AND CASE WHEN confirmed > 0 THEN c = 0 ELSE u = 0 END),
kept AS (SELECT * FROM rows a WHERE NOT EXISTS (SELECT 1 FROM rows b WHERE b.alert = a.alert AND b.tterm <> a.tterm AND contains(a.tterm, b.tterm) AND b.count >= a.count))
SELECT * FROM (SELECT alert, row_number() OVER (PARTITION BY alert ORDER BY broad, collateral, count DESC, length(tterm) DESC, tterm) AS place, tterm, count, collateral, broad, in_all FROM kept) WHERE place <= 12"""
)
QUERIES["suggest_requires"] = lambda s, d: rf.suggest_requires(v.cards(s, d), v.card_rules(s, d)).select("alert", "place", "tterm", "count")
ORACLE_SQL["suggest_requires"] = (
    v.sql(["marks"], "").rstrip()
    + ",\n"
    + _SPREAD.format(mark="confirmed")
    + """,
rows AS (SELECT s.alert, tterm, confirmed AS count FROM spread s JOIN marks USING (alert) WHERE rejected > 0 AND c = confirmed AND r = 0 AND length(tterm) <> 3),
kept AS (SELECT * FROM rows a WHERE NOT EXISTS (SELECT 1 FROM rows b WHERE b.alert = a.alert AND b.tterm <> a.tterm AND contains(b.tterm, a.tterm)))
SELECT * FROM (SELECT alert, row_number() OVER (PARTITION BY alert ORDER BY length(tterm) DESC, tterm) AS place, tterm, count FROM kept) WHERE place <= 8"""
)


def _score_params(s, d):
    return v.cards(s, d).select("alert").distinct().withColumn("min_score", F.lit(3.0))


def _parted(s, d):
    """Cards whose scores are told apart by their mark in every other alert."""
    c = v.cards(s, d)
    low = (F.col("mark") == "rejected") & (F.col("alert").cast("int") % 2 == 0)
    return c.withColumn("score", F.when(low, F.col("score") / 1000).otherwise(F.col("score") + 10))


@query(
    ["marks"],
    """SELECT alert, floor((clears + blocks) / 2 * 10 + 0.5) / 10 AS value, clears, blocks FROM (SELECT alert, min(s) FILTER (CASE WHEN confirmed > 0 THEN mark = 'confirmed' ELSE mark IS NULL END) AS clears, max(s) FILTER (mark = 'rejected') AS blocks
    FROM (SELECT *, CASE WHEN mark = 'rejected' AND alert::INT % 2 = 0 THEN score / 1000 ELSE score + 10 END AS s FROM cards JOIN marks USING (alert) WHERE rejected > 0) GROUP BY alert)
    WHERE blocks < clears AND floor((clears + blocks) / 2 * 10 + 0.5) / 10 > 3 AND floor((clears + blocks) / 2 * 10 + 0.5) / 10 <= clears""",
)
def suggest_threshold(s, d):
    return rf.suggest_threshold(_parted(s, d), _score_params(s, d))


@query(["marks"], "SELECT alert, (CASE WHEN confirmed > 0 THEN confirmed ELSE unmarked END) = 0 AS nothing_kept, confirmed = 0 AND unmarked > 0 AS nothing_confirmed FROM marks WHERE rejected > 0")
def suggest_warnings(s, d):
    c, r = v.cards(s, d), v.card_rules(s, d)
    out = rf.suggest_warnings(c, rf.suggest_excludes(c, r), rf.suggest_requires(c, r), rf.suggest_threshold(c, _score_params(s, d)))
    return out.select("alert", "nothing_kept", "nothing_confirmed")


ORACLE_SQL.update(learn_sql.ORACLE_SQL)
for part in (japanese, jobs):
    QUERIES.update(part.QUERIES)
    ORACLE_SQL.update(part.ORACLE_SQL)
