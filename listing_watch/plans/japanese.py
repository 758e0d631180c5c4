"""Queries of the text layer over Japanese: each given document behind one of six phrases, by its id.

What the phrases must give was worked out by hand from the rules and stands in PHRASES; the rest of a
text is Latin, for which SQL has the rules themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, terms, text
from . import learn_sql, views

#: For each phrase: its text, NFKC form, tight form, runs (surface/script), terms that are runs, and
#: terms that join runs; a term is surface/tight form.
PHRASES = [
    ("光の城", "光の城", "光の城", ["光/J", "の/H", "城/J"], [], ["光の城/光の城"]),
    ("勇者ロボ号", "勇者ロボ号", "勇者ろぼ号", ["勇者/J", "ロボ/K", "号/J"], ["勇者/勇者", "ロボ/ろぼ"], ["勇者ロボ/勇者ろぼ", "ロボ号/ろぼ号"]),
    ("城を求めて", "城を求めて", "城を求めて", ["城/J", "を/H", "求/J", "めて/H"], [], ["城を求/城を求", "城を求めて/城を求めて", "求めて/求めて"]),
    ("ｽｰﾊﾟｰ・ﾛﾎﾞ", "スーパー・ロボ", "すーぱーろぼ", ["スーパー・ロボ/K"], ["スーパー・ロボ/すーぱーろぼ"], []),
    ("商品 発送", "商品 発送", "商品発送", ["商品/J", "発送/J"], [], []),
    ("５枚セット", "5枚セット", "5枚せっと", ["5/A", "枚/J", "セット/K"], ["セット/せっと"], ["5枚/5枚", "枚セット/枚せっと"]),
]
#: Words with what is known of them: (word, stop word, broad, counter).
WORDS = [("商品", True, False, False), ("発送", True, False, False), ("カード", False, True, False), ("セット", False, True, False), ("５枚", False, False, True), ("12点", False, False, True), ("ロボ", False, False, False), ("光の城", False, False, False), ("枚", True, False, False)]
BREAK = "。"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    phrases = F.array(*[F.lit(p[0]) for p in PHRASES])
    phrase = F.get(phrases, (F.col("doc_id") % len(PHRASES)).cast("int"))
    return d.select("doc_id", "source", F.concat(phrase, F.lit(BREAK), F.coalesce("text", F.lit(""))).alias("jp"), phrase.alias("phrase"), "text")


def _rows(values: list[tuple]) -> str:
    cell = lambda x: "[" + ", ".join(map(cell, x)) + "]::VARCHAR[]" if isinstance(x, list) else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else views._q(x)
    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in values)


_GOLD = f"gold AS (SELECT * FROM (VALUES {_rows([(i, *p) for i, p in enumerate(PHRASES)])}) v(k, phrase, nfkc, tight, runs, run_terms, joined_terms)),\ndocs AS (SELECT d.doc_id, d.source, coalesce(d.text, '') AS text, g.* FROM documents d JOIN gold g ON d.doc_id % {len(PHRASES)} = g.k)"
_SPLIT = "SELECT doc_id, {1} AS stage, generate_subscripts({0}, 1) AS i, split_part(unnest({0}), '/', 1) AS term, split_part(unnest({0}), '/', 2) AS term_t FROM docs"
_TERMS = f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY stage, i) - 1)::INT AS ord, term, term_t FROM ({_SPLIT.format("run_terms", 1)} UNION ALL SELECT doc_id, 2 AS stage, i, term, term_t FROM ({learn_sql.terms("docs", "doc_id", "text")}) UNION ALL {_SPLIT.format("joined_terms", 3)})"""
_HINT = f"CASE WHEN term_t IN ('せっと', 'かーど') THEN greatest({learn_sql._HINT.format('term_t')} - 1::DOUBLE, 0.1::DOUBLE) ELSE {learn_sql._HINT.format('term_t')} END"


def _sql(select: str) -> str:
    return f"WITH {_GOLD}\n{select}"


def nfkc_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.nfkc(F.col("jp")), 256).alias("sha"))


def forms_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", text.tight(F.col("phrase")).alias("tight"), F.sha2(text.tight(F.col("jp")), 256).alias("tight_sha"), text.kata_to_hira(F.col("phrase")).alias("hiragana"))


def script_runs_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _docs(spark, sf_dir).select("doc_id", terms.script_runs(F.col("jp")).alias("r"))
    written = F.array_join(F.transform("r", lambda x: F.concat(x["surface"], F.lit("/"), x["script"])), " ")
    return r.select("doc_id", F.size("r").cast("long").alias("runs"), F.sha2(written, 256).alias("sha"))


def extract_terms_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _docs(spark, sf_dir).select("doc_id", F.posexplode(terms.extract_terms(F.col("jp"))).alias("ord", "x"))
    return r.select("doc_id", "ord", "x.term", "x.term_t")


def card_terms_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _docs(spark, sf_dir).select("doc_id", terms.card_terms(F.col("phrase"), F.concat(F.lit(BREAK), F.coalesce("text", F.lit("")))).alias("c"))
    joined = lambda k: F.array_join(f"c.{k}", "|").alias(k)
    return c.select("doc_id", joined("terms"), joined("tterms"), joined("generic"), F.sha2("c.tt", 256).alias("tt_sha"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.get(F.array(*[F.lit(w[0]) for w in WORDS]), (F.col("doc_id") % len(WORDS)).cast("int")).alias("word"))


def is_stopword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", terms.is_stopword(text.tight(F.col("word"))).alias("stop"))


def is_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", terms.is_generic(text.tight(F.col("word"))).alias("broad"))


def is_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", terms.is_counter(text.nfkc(F.col("word"))).alias("counter"))


def contains_term_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of other spellings, and codes that touch other letters, in the phrase and the document."""
    d = _docs(spark, sf_dir).select("doc_id", text.prep(F.concat("phrase", F.lit("AB12型 x"), "source", F.lit("y"))).alias("p"))
    has = lambda term: text.contains_term(text.tight(F.lit(term)), F.col("p.t"), F.col("p.s"))
    return d.select("doc_id", has("ろぼ").alias("kana"), has("ａｂ－１２").alias("code"), has("b12").alias("inside"), has("ロボ号").alias("mixed"), has("").alias("empty"))


def term_weight_hint_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms.is_generic(F.col("term_t"))
    return extract_terms_japanese(spark, sf_dir).select("term_t").distinct().select("term_t", scalars.term_weight_hint(F.col("term_t"), t).alias("hint"))


_VALUES = f"(VALUES {_rows([(i, *w) for i, w in enumerate(WORDS)])}) w(k, word, stop, broad, counter) ON d.doc_id % {len(WORDS)} = w.k"
_LATIN = "regexp_replace(lower({0}), '[^0-9a-z]', '', 'g')"
_RUNS = learn_sql.WORDS.format("text")
_CARD = f"SELECT *, {_HINT} AS hint FROM ({_TERMS})"
_CARD_TEXT = f"SELECT doc_id, tight || {_LATIN.format('text')} AS tt FROM docs"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (nfkc_japanese, forms_japanese, script_runs_japanese, extract_terms_japanese, card_terms_japanese, contains_term_japanese, term_weight_hint_japanese, is_stopword, is_generic, is_counter)}
ORACLE_SQL = {
    "nfkc_japanese": _sql(f"SELECT doc_id, sha256(nfkc || '{BREAK}' || nfc_normalize(text)) AS sha FROM docs"),
    "forms_japanese": _sql(f"SELECT doc_id, tight, sha256(tight || {_LATIN.format('text')}) AS tight_sha, CASE k WHEN 1 THEN '勇者ろぼ号' WHEN 5 THEN '５枚せっと' ELSE phrase END AS hiragana FROM docs"),
    "script_runs_japanese": _sql(f"SELECT doc_id, len(rs) AS runs, sha256(array_to_string(rs, ' ')) AS sha FROM (SELECT doc_id, list_concat(runs, list_transform({_RUNS}, lambda w: w || '/A')) AS rs FROM docs)"),
    "extract_terms_japanese": _sql(_TERMS),
    "card_terms_japanese": _sql(
        f"""SELECT doc_id, coalesce(terms, '') AS terms, coalesce(tterms, '') AS tterms, coalesce(generic, '') AS generic, sha256(tt) AS tt_sha FROM ({_CARD_TEXT}) LEFT JOIN (SELECT doc_id, string_agg(term, '|' ORDER BY n) AS terms, string_agg(term_t, '|' ORDER BY n) AS tterms, string_agg(term_t, '|' ORDER BY n) FILTER (term_t IN ('せっと', 'かーど')) AS generic
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hint DESC, length(term_t) DESC, ord) AS n FROM ({_CARD})) WHERE n <= 40 GROUP BY doc_id) USING (doc_id)"""
    ),
    "contains_term_japanese": _sql("SELECT doc_id, k IN (1, 3) AS kana, TRUE AS code, FALSE AS inside, k = 1 AS mixed, FALSE AS empty FROM docs"),
    "term_weight_hint_japanese": _sql(f"SELECT DISTINCT term_t, {_HINT} AS hint FROM ({_TERMS})"),
    **{f"is_{n}": f"SELECT doc_id, {c} FROM documents d JOIN {_VALUES}" for n, c in (("stopword", "stop"), ("generic", "broad"), ("counter", "counter"))},
}
