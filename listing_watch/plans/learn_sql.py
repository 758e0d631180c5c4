"""SQL for the learning queries over the given tables: plain counting and comparing of all pairs, step
by step, where the library joins and folds.

Texts of the tables are Latin, so that terms are words of ASCII letters and digits, none of them is
broad, a counter or a stop word, and no default exclude, which are all Japanese, occurs."""

from __future__ import annotations

from . import views as v

#: Words of an SQL text, as the library's runs of letters, digits and hyphens.
WORDS = "list_filter(list_transform(regexp_extract_all({0}, '[0-9A-Za-z_–—‐‑-]+'), lambda w: trim(w, '-‐‑–—_')), lambda w: w <> '')"
_TIGHT = "regexp_replace(lower({0}), '[^0-9a-z]', '', 'g')"
_HINT = "greatest((1 + least(length({0}), 10) * 0.12::DOUBLE) + CASE WHEN regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '[a-z]') THEN 1.4::DOUBLE WHEN regexp_matches({0}, '[0-9]') THEN 0.3::DOUBLE ELSE 0::DOUBLE END, 0.1::DOUBLE)"
_TITLE, _DESC = (v._hit("{0}", f"e.t_{k}", f"e.s_{k}") for k in ("title", "desc"))
_FIRST = "ex_ord, p, i"
_APART = "NOT contains({0}, {1}) AND NOT contains({1}, {0})"


def terms(source: str, keys: str, text: str) -> str:
    """The terms of a text column: (keys, i, term, term_t), one for each tight form, in order."""
    words = f"SELECT {keys}, unnest(ws) AS term, generate_subscripts(ws, 1) AS at_ FROM (SELECT {keys}, {WORDS.format(text)} AS ws FROM {source})"
    tight = f"SELECT *, {_TIGHT.format('term')} AS term_t FROM ({words})"
    first = f"SELECT {keys}, term_t, arg_min(term, at_) AS term, min(at_) AS at_ FROM ({tight}) WHERE length(term_t) BETWEEN 2 AND 24 AND NOT regexp_full_match(term_t, '[0-9]+') GROUP BY {keys}, term_t"
    return f"SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY at_) - 1)::INT AS i, term, term_t FROM ({first})"


def _candidates(which: str) -> str:
    return f"SELECT label_id, term_t, arg_min(term, (length(term), {_FIRST})) AS surface, arg_min(ex_ord, ({_FIRST})) AS ex_ord, arg_min(p, ({_FIRST})) AS p, arg_min(i, ({_FIRST})) AS i FROM ex_terms WHERE {which} GROUP BY label_id, term_t"


def _counted(cand: str, polarity: int) -> str:
    title, desc = _TITLE.format("c.term_t"), _DESC.format("c.term_t")
    hits = f"SELECT c.label_id, c.term_t, {title} AS in_title, {desc} AS in_desc FROM {cand} c JOIN ex e ON e.label_id = c.label_id AND e.polarity = {polarity}"
    df = f"SELECT label_id, term_t, count(*) FILTER (in_title OR in_desc) AS df_all, count(*) FILTER (in_title) AS df_title FROM ({hits}) GROUP BY ALL"
    return f"SELECT * FROM {cand} JOIN ({df}) USING (label_id, term_t) JOIN (SELECT label_id, count(*) AS n FROM ex WHERE polarity = {polarity} GROUP BY label_id) USING (label_id) WHERE df_all > 0"


def _kept(cand: str) -> str:
    """Without the redundant terms: (label_id, term_t)."""
    pairs = f"SELECT a.label_id, a.term_t AS outer_t, b.term_t AS inner_t, a.df_all AS df_outer, b.df_all AS df_inner FROM {cand} a JOIN {cand} b ON a.label_id = b.label_id AND length(b.term_t) < length(a.term_t) AND a.df_all <= b.df_all AND contains(a.term_t, b.term_t)"
    return f"""WITH pairs AS MATERIALIZED ({pairs}), covered AS MATERIALIZED (SELECT DISTINCT label_id, inner_t AS term_t FROM pairs WHERE df_outer = df_inner),
    wide AS (SELECT DISTINCT label_id, outer_t AS term_t FROM pairs WHERE df_outer < df_inner AND (label_id, inner_t) NOT IN (SELECT label_id, term_t FROM covered))
    SELECT label_id, term_t FROM {cand} EXCEPT SELECT * FROM covered EXCEPT SELECT * FROM wide"""


_RANK = f"(df_all::DOUBLE / n) * (df_all::DOUBLE / n) * 10 * {_HINT.format('term_t')} * (1 + 0.5::DOUBLE * df_title / n)"
_BY_RANK = f"rank DESC, length(term_t) DESC, {_FIRST}"
_JUDGED_HIT = f"({_TITLE.format('r.term_t')} OR {_DESC.format('r.term_t')})"
_PICK = "SELECT label_id, surface, term_t FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY df_title DESC, rank DESC, length(term_t) DESC, ex_ord, p, i, surface, term_t) AS k FROM required WHERE {0}) WHERE k = 1"
_NOT_NESTED = "NOT EXISTS (SELECT 1 FROM {0} x WHERE x.label_id = required.label_id AND (contains(x.term_t, required.term_t) OR contains(required.term_t, x.term_t)))"

STEPS = {
    "ex": "SELECT (d.doc_id // 16)::VARCHAR AS label_id, d.doc_id AS ex_ord, quality AS polarity, split_part(text, chr(10), 1) AS title, text, p.t_title, p.s_title, p.t_desc, p.s_desc FROM documents d JOIN labels USING (doc_id) JOIN prepped p ON p.id = 'm' || lpad(d.doc_id::VARCHAR, 8, '0')",
    "ex_terms": f"SELECT *, 0 AS p FROM ({terms('ex', 'label_id, ex_ord, polarity', 'title')}) UNION ALL SELECT *, 1 AS p FROM ({terms('ex', 'label_id, ex_ord, polarity', 'text')})",
    "cand": _candidates("polarity = 1"),
    "cdf": _counted("cand", 1),
    "kept_terms": _kept("cdf"),
    "asked": f"SELECT label_id, surface, term_t FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {_BY_RANK}) AS k FROM (SELECT *, {_RANK} * 1::DOUBLE AS rank FROM cdf SEMI JOIN kept_terms USING (label_id, term_t) WHERE df_all = n)) WHERE k <= 14",
    "counts": f"SELECT * FROM asked JOIN (SELECT term_t, count(DISTINCT id) FILTER ({v._hit('term_t', 't_title', 's_title')} OR {v._hit('term_t', 't_desc', 's_desc')}) AS listings FROM (SELECT DISTINCT term_t FROM asked), prepped GROUP BY term_t) USING (term_t)",
    "ranked": f"SELECT *, {_RANK} * idf AS rank FROM (SELECT *, {_HINT.format('term_t')} AS hint, CASE WHEN listings IS NULL THEN 1::DOUBLE ELSE greatest(0.25::DOUBLE, least(5::DOUBLE, log10(1e6 / greatest(listings, 10)))) END AS idf FROM cdf LEFT JOIN (SELECT DISTINCT surface, listings FROM counts) USING (surface))",
    "kept_ranked": "SELECT * FROM ranked SEMI JOIN kept_terms USING (label_id, term_t)",
    "penalties": f"SELECT k.*, CASE WHEN m.n_neg > 0 AND (SELECT count(*) FROM ex e WHERE e.label_id = k.label_id AND e.polarity = 0 AND ({_TITLE.format('k.term_t')} OR {_DESC.format('k.term_t')})) = m.n_neg THEN 0.4::DOUBLE ELSE 1::DOUBLE END AS penalty FROM kept_ranked k LEFT JOIN (SELECT label_id, count(*) AS n_neg FROM ex WHERE polarity = 0 GROUP BY label_id) m USING (label_id)",
    "best_signals": f"SELECT label_id, ord, surface, term_t, round(greatest(0.2::DOUBLE, least(25::DOUBLE, CASE WHEN df_all = n THEN 3::DOUBLE WHEN df_all >= n * 0.75 THEN 2::DOUBLE ELSE 1::DOUBLE END * idf * penalty)), 2) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {_BY_RANK}) - 1 AS ord FROM penalties WHERE df_all = n OR (df_title >= 1 AND df_all >= ceil(n / 2))) WHERE ord < 12",
    "signals_": f"SELECT * FROM best_signals UNION ALL SELECT label_id, ord, surface, term_t, 1::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {_BY_RANK}) - 1 AS ord FROM penalties ANTI JOIN best_signals USING (label_id)) WHERE ord < 5",
    "required": "SELECT * FROM kept_ranked WHERE df_all = n",
    "pick1": _PICK.format("true"),
    "pick2": _PICK.format(_NOT_NESTED.format("pick1")),
    "pick3": _PICK.format(_NOT_NESTED.format("pick1") + " AND " + _NOT_NESTED.format("pick2")),
    "picks": "SELECT *, 1 AS k FROM pick1 UNION ALL SELECT *, 2 FROM pick2 UNION ALL SELECT *, 3 FROM pick3",
    "neg_cand": _candidates("polarity = 0"),
    "neg_df": _counted("neg_cand", 0),
    "neg_kept": _kept("neg_df"),
    "excludes_": f"""SELECT label_id, ord, surface, term_t FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY df_all DESC, length(term_t), {_FIRST}) - 1 AS ord FROM neg_df c SEMI JOIN neg_kept USING (label_id, term_t)
        WHERE df_all >= CASE WHEN n > 1 THEN greatest(2, ceil(n / 2)) ELSE 1 END AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.label_id = c.label_id AND e.polarity = 1 AND ({_TITLE.format("c.term_t")} OR {_DESC.format("c.term_t")}))) WHERE ord < 4""",
    "judged_": f"""SELECT label_id, ex_ord, polarity, excluded_by, CASE WHEN excluded_by IS NOT NULL THEN 0 ELSE raw END AS raw, missing FROM (SELECT e.label_id, e.ex_ord, e.polarity,
        (SELECT arg_min(r.surface, r.ord) FROM excludes_ r WHERE r.label_id = e.label_id AND {_JUDGED_HIT}) AS excluded_by,
        (SELECT list_reduce(list_prepend(0::DOUBLE, list(r.weight * CASE WHEN {_TITLE.format("r.term_t")} THEN 1.25::DOUBLE ELSE 1::DOUBLE END ORDER BY r.ord)), lambda a, b: a + b) FROM signals_ r WHERE r.label_id = e.label_id AND {_JUDGED_HIT}) AS raw,
        EXISTS (SELECT 1 FROM picks r WHERE r.label_id = e.label_id) AND NOT EXISTS (SELECT 1 FROM picks r WHERE r.label_id = e.label_id AND {_JUDGED_HIT}) AS missing
        FROM ex e WHERE polarity IN (0, 1) AND label_id IN (SELECT label_id FROM signals_ UNION SELECT label_id FROM excludes_))""",
    "scored": "SELECT label_id, ex_ord, polarity, excluded_by, CASE WHEN excluded_by IS NOT NULL OR missing THEN 'reject' WHEN coalesce(raw, 0) >= 4 THEN 'match' WHEN coalesce(raw, 0) >= 4::DOUBLE * 0.55::DOUBLE THEN 'borderline' ELSE 'reject' END AS status, round(coalesce(raw, 0)::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE AS score FROM judged_",
    "shared": f"SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {_BY_RANK}) AS place FROM kept_ranked WHERE df_all = n",
    "strong": "SELECT * FROM shared WHERE place <= 4",
    "title_terms": f"SELECT label_id, e.ex_ord, surface, term_t, row_number() OVER (PARTITION BY label_id, e.ex_ord ORDER BY rank * CASE WHEN df_title = 0 THEN 0.7::DOUBLE ELSE 1::DOUBLE END DESC, term_t) AS k FROM (SELECT DISTINCT label_id, ex_ord, term_t FROM ({terms('ex', 'label_id, ex_ord, polarity', 'title')}) WHERE polarity = 1) e JOIN ranked r USING (label_id, term_t)",
    "pairs_of_title": f"SELECT a.label_id, a.ex_ord, a.surface AS s1, a.term_t AS t1, arg_min(b.surface, b.k) AS s2, arg_min(b.term_t, b.k) AS t2 FROM (SELECT * FROM title_terms WHERE k = 1) a LEFT JOIN title_terms b ON a.label_id = b.label_id AND a.ex_ord = b.ex_ord AND {_APART.format('a.term_t', 'b.term_t')} GROUP BY ALL",
    "every_query": f"""SELECT label_id, 1 AS step, place AS a, place AS b, term_t AS key, surface AS query, 'rare' AS origin FROM shared WHERE listings <= 3000
        UNION ALL SELECT label_id, 2, ex_ord, ex_ord, t1 || coalesce(t2, ''), concat_ws(' ', s1, s2), 'title' FROM pairs_of_title
        UNION ALL SELECT x.label_id, 3, x.place, y.place, x.term_t || y.term_t, x.surface || ' ' || y.surface, 'pair' FROM strong x JOIN strong y ON x.label_id = y.label_id AND x.place < y.place AND {_APART.format('x.term_t', 'y.term_t')}
        UNION ALL SELECT label_id, 4, 0, 0, b.t || c.t, b.s || ' ' || c.s, 'code' FROM (SELECT label_id, arg_min(surface, (idf, place)) AS s, arg_min(term_t, (idf, place)) AS t FROM strong GROUP BY label_id) b
            JOIN (SELECT label_id, arg_min(surface, place) AS s, arg_min(term_t, place) AS t FROM shared WHERE regexp_matches(term_t, '[0-9]') AND regexp_matches(term_t, '[a-z]') GROUP BY label_id) c USING (label_id) WHERE b.t <> c.t""",
    "queries_": "SELECT label_id, ord, query, origin FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY step, a, b) - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY label_id, key ORDER BY step, a, b) AS k FROM every_query) WHERE k = 1) WHERE ord < 8",
}
NEEDS = {
    "ex_terms": ["ex"],
    "cand": ["ex_terms"],
    "cdf": ["cand"],
    "kept_terms": ["cdf"],
    "asked": ["kept_terms"],
    "counts": ["asked"],
    "ranked": ["counts"],
    "kept_ranked": ["ranked"],
    "penalties": ["kept_ranked"],
    "best_signals": ["penalties"],
    "signals_": ["best_signals"],
    "required": ["kept_ranked"],
    "pick1": ["required"],
    "pick2": ["pick1"],
    "pick3": ["pick2"],
    "picks": ["pick3"],
    "neg_cand": ["ex_terms"],
    "neg_df": ["neg_cand"],
    "neg_kept": ["neg_df"],
    "excludes_": ["neg_kept"],
    "judged_": ["signals_", "picks", "excludes_"],
    "scored": ["judged_"],
    "shared": ["kept_ranked"],
    "strong": ["shared"],
    "title_terms": ["ranked"],
    "pairs_of_title": ["title_terms"],
    "every_query": ["strong", "pairs_of_title"],
    "queries_": ["every_query"],
}


def sql(name: str, select: str, *others: str) -> str:
    """`select` with the steps up to `name` and the others before it, each worked out once."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in (name, *others):
        add(n)
    steps = [("listings", v.CTE["listings"]), ("prepped", v.CTE["prepped"]), *[(n, STEPS[n]) for n in order]]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({text})" for n, text in steps) + "\n" + select


_GRID = f"""SELECT label_id, ex_ord, q, bool_and({_TITLE.format("w.term_t")}) AS t, bool_and({_TITLE.format("w.term_t")} OR {_DESC.format("w.term_t")}) AS f
    FROM (SELECT label_id, ord AS q, {_TIGHT.format("word")} AS term_t FROM (SELECT label_id, ord, unnest(string_split(query, ' ')) AS word FROM queries_) WHERE word <> '') w JOIN ex e USING (label_id) WHERE polarity = 1 GROUP BY label_id, ex_ord, q"""
_GRID_ROWS = f"SELECT label_id, ex_ord, string_agg(CASE WHEN t THEN 'T' WHEN f THEN 'd' ELSE '.' END, '' ORDER BY q) AS marks FROM ({_GRID}) GROUP BY label_id, ex_ord"

_THRESHOLD = """SELECT label_id, greatest(3::DOUBLE, round(least(greatest(coalesce(top, 4::DOUBLE), coalesce(worst * 1.2::DOUBLE + 0.5::DOUBLE, 0::DOUBLE)), coalesce(weakest, 8::DOUBLE) * 0.75::DOUBLE), 1)) AS min_score
        FROM (SELECT label_id, 0.75::DOUBLE * sum(weight) AS top FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY weight DESC, ord) AS k FROM signals_) WHERE k <= 2 GROUP BY label_id)
        FULL JOIN (SELECT label_id, min(score) FILTER (polarity = 1) AS weakest, max(score) FILTER (polarity = 0) AS worst FROM scored GROUP BY label_id) USING (label_id)"""
_BEST = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_HINT.format('term_t')} DESC, length(term_t) DESC, i) AS n FROM ({terms('card_texts', 'id', 'text')})"

ORACLE_SQL = {
    "card_terms": f"""WITH listings AS ({v.CTE["listings"]}), card_texts AS (SELECT id, trim(concat_ws(' ', nullif(name, ''), nullif(description, ''))) AS text FROM listings)
SELECT id, coalesce(terms, '') AS terms, coalesce(tterms, '') AS tterms, '' AS generic, sha256({_TIGHT.format("text")}) AS tt_sha FROM card_texts LEFT JOIN (SELECT id, string_agg(term, '|' ORDER BY n) AS terms, string_agg(term_t, '|' ORDER BY n) AS tterms FROM ({_BEST}) WHERE n <= 40 GROUP BY id) USING (id)""",
    "extract_terms": f"SELECT doc_id, i AS ord, term, term_t FROM ({terms('documents', 'doc_id', 'text')})",
    "collect_candidates": sql("ex_terms", f"SELECT label_id, term_t, surface, ex_ord, p, i FROM ({_candidates('true')})"),
    "candidate_df": sql("cdf", "SELECT label_id, term_t, df_all, df_title, n FROM cdf"),
    "rank_candidates": sql("ranked", "SELECT label_id, term_t, surface, df_all, df_title, n, hint, listings, idf, rank FROM ranked"),
    "drop_redundant": sql("kept_ranked", "SELECT label_id, term_t, df_all, rank FROM kept_ranked"),
    "neg_penalty": sql("penalties", "SELECT label_id, term_t, penalty FROM penalties"),
    "learn_signals": sql("signals_", "SELECT label_id, ord, surface, term_t, weight FROM signals_"),
    "learn_excludes": sql("excludes_", "SELECT label_id, ord, surface, term_t FROM excludes_"),
    "learn_require": sql("picks", "SELECT label_id, string_agg(surface, '|' ORDER BY k) AS terms FROM picks GROUP BY label_id"),
    "learn_threshold": sql("scored", _THRESHOLD),
    "learn_alert": sql(
        "scored",
        f"""SELECT label_id AS name, label, coalesce(queries, '') AS queries, coalesce(require, '') AS require, signals, weights, coalesce(exclude, '') AS exclude, min_score, learned_from
        FROM (SELECT label_id, string_agg(surface, '|' ORDER BY ord) AS signals, string_agg(round(weight * 100)::BIGINT::VARCHAR, '|' ORDER BY ord) AS weights FROM signals_ GROUP BY label_id)
        JOIN (SELECT label_id, substr(arg_min(title, ex_ord), 1, 60) AS label, string_agg(ex_ord::VARCHAR, '|' ORDER BY ex_ord) AS learned_from FROM ex WHERE polarity = 1 GROUP BY label_id) USING (label_id)
        LEFT JOIN (SELECT label_id, string_agg(surface, '|' ORDER BY k) AS require FROM picks GROUP BY label_id) USING (label_id)
        LEFT JOIN (SELECT label_id, string_agg(surface, '|' ORDER BY ord) AS exclude FROM excludes_ GROUP BY label_id) USING (label_id)
        LEFT JOIN (SELECT label_id, string_agg(query, '|' ORDER BY ord) AS queries FROM queries_ GROUP BY label_id) USING (label_id) LEFT JOIN ({_THRESHOLD}) USING (label_id)""",
        "queries_",
    ),
    "build_queries": sql("queries_", "SELECT label_id, ord, query, origin FROM queries_"),
    "coverage_grid": sql("queries_", f"SELECT label_id, ex_ord, marks, CASE WHEN contains(marks, 'T') THEN 'title' WHEN contains(marks, 'd') THEN 'text' ELSE 'none' END AS reach FROM ({_GRID_ROWS})"),
    "specificity_report": sql("signals_", "SELECT label_id, place, surface, listings, weight FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY listings, surface) AS place FROM counts) LEFT JOIN (SELECT label_id, surface, weight FROM signals_) USING (label_id, surface) WHERE place <= 14"),
    "scoring_report": sql(
        "scored",
        """SELECT label_id, polarity, ex_ord, status, score, excluded_by, CASE WHEN polarity = 1 THEN CASE WHEN status = 'match' THEN 'pass' ELSE 'fail' END WHEN excluded_by IS NOT NULL THEN 'rejected by ' || excluded_by
        WHEN status = 'match' THEN 'false positive' WHEN status = 'borderline' THEN 'borderline' ELSE 'rejected' END AS verdict FROM scored""",
    ),
}
