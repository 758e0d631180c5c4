"""Judging candidates by rules: excludes, required groups, weighted signals, verdicts.

Inputs: candidates (alert, id, ...), hits of `term_hits`, rules of `flatten_rules`, and params
(alert, min_score, borderline_ratio, scope). Verdicts are built from the candidates' side, so a
candidate without any hit is judged too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

TITLE_FACTOR = 1.25


def rule_hits(hits: DataFrame, rules: DataFrame, with_desc: bool = True) -> DataFrame:
    """(alert, id, kind, grp, ord, term, weight, in_title): the rules' terms that a listing has. Hits with
    an alert meet its rules only; others meet those of every alert that has the term."""
    h = hits if with_desc else hits.filter("in_title")
    return h.join(rules, [c for c in ("alert", "term_t") if c in h.columns]).select("alert", "id", "kind", "grp", "ord", "term", "weight", "in_title")


def excluded_by(found: DataFrame) -> DataFrame:
    """(alert, id, excluded_by): the first exclude term, in rule order, that a listing has."""
    return found.filter("kind = 'exclude'").groupBy("alert", "id").agg(F.min_by("term", "ord").alias("excluded_by"))


def missing_required(candidates: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """(alert, id, grp): required groups of which a candidate has no term."""
    groups = rules.filter("kind = 'require'").select("alert", "grp").distinct()
    has = found.filter("kind = 'require'").select("alert", "id", "grp")
    return candidates.select("alert", "id").join(groups, "alert").join(has, ["alert", "id", "grp"], "left_anti")


def signal_score(found: DataFrame) -> DataFrame:
    """(alert, id, score_raw, hits): weights of the signals a listing has, those in the title by a
    quarter more, added in rule order; hits in the same order."""
    w = F.col("weight") * F.when(F.col("in_title"), TITLE_FACTOR).otherwise(1.0)
    rows = F.array_sort(F.collect_list(F.struct("ord", w.alias("w"), "term")))
    d = found.filter("kind = 'signal'").groupBy("alert", "id").agg(rows.alias("s"))
    return d.select("alert", "id", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]).alias("score_raw"), F.transform("s", lambda x: x["term"]).alias("hits"))


def status_of(score: Column, params_min: Column, ratio: Column) -> Column:
    return F.when(score >= params_min, "match").when(score >= params_min * ratio, "borderline").otherwise("reject")


def verdicts(candidates: DataFrame, hits: DataFrame, rules: DataFrame, params: DataFrame, with_desc: bool = True) -> DataFrame:
    """candidates with status, score (2 places), score_raw, hits, n_missing, excluded_by and
    needs_description. All figures come from one aggregation by (alert, id)."""
    found = rule_hits(hits, rules, with_desc)
    w = F.col("weight") * F.when(F.col("in_title"), TITLE_FACTOR).otherwise(1.0)
    agg = found.groupBy("alert", "id").agg(
        F.min_by(F.when(F.col("kind") == "exclude", F.col("term")), F.when(F.col("kind") == "exclude", F.col("ord"))).alias("excluded_by"),
        F.count_distinct(F.when(F.col("kind") == "require", F.col("grp"))).alias("n_groups_hit"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "signal", F.struct("ord", w.alias("w"), "term")))).alias("s"),
    )
    groups = rules.filter("kind = 'require'").groupBy("alert").agg(F.count_distinct("grp").alias("n_groups"))
    # rules without any term in a group are groups that nothing meets
    p = params.join(groups, "alert", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    d = candidates.join(agg, ["alert", "id"], "left").join(p, "alert")
    raw = F.coalesce(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]), F.lit(0.0))
    out = F.col("excluded_by").isNotNull()
    missing = F.col("n_groups") - F.coalesce("n_groups_hit", F.lit(0))
    d = d.withColumn("score_raw", F.when(out, 0.0).otherwise(raw)).withColumn("n_missing", F.when(out, 0).otherwise(missing).cast("int"))
    status = F.when(out | (F.col("n_missing") > 0), "reject").otherwise(status_of(F.col("score_raw"), F.col("min_score"), F.col("borderline_ratio")))
    none = F.array().cast("array<string>")
    return d.select(
        *[F.col(f"`{c}`") for c in candidates.columns],
        status.alias("status"),
        F.round("score_raw", 2).alias("score"),
        "score_raw",
        F.when(out, none).otherwise(F.coalesce(F.transform("s", lambda x: x["term"]), none)).alias("hits"),
        "n_missing",
        "excluded_by",
        (F.lit(not with_desc) & ~out & (F.col("scope") == "full") & (status != "match")).alias("needs_description"),
    )


def two_phase_verdicts(candidates: DataFrame, hits: DataFrame, rules: DataFrame, params: DataFrame, budget: int | None = None, order: list[str] | None = None, per_alert: bool = False) -> DataFrame:
    """Judged on the title; only undecided candidates are judged again with the description, so a
    match by title is final. With a budget only the first so many undecided, in `order`, are."""
    first = stored(verdicts(candidates, hits, rules, params, with_desc=False), "title-verdicts")
    open_ = F.col("needs_description")
    if budget is not None:
        pick = first.filter(open_).select("alert", "id", *[c for c in order or ["alert", "id"] if c not in ("alert", "id")])
        if per_alert:
            w = Window.partitionBy("alert").orderBy(*(order or ["id"]))
            pick = pick.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= budget)
        else:
            pick = pick.orderBy(*(order or ["alert", "id"])).limit(budget)
        first = first.join(pick.select("alert", "id", F.lit(True).alias("_go")), ["alert", "id"], "left")
        open_ = open_ & F.coalesce("_go", F.lit(False))
    again = verdicts(first.filter(open_).select(*[F.col(f"`{c}`") for c in candidates.columns]), hits, rules, params)
    done = first.filter(~open_).drop("_go") if budget is not None else first.filter(~open_)
    return done.unionByName(again)


def detail_budget(undecided: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The first `budget` undecided candidates of a run."""
    return undecided.orderBy(*order).limit(budget)


def match_alerts(prepped: DataFrame, candidates: DataFrame, rules: DataFrame, params: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Matches and borderline candidates, by title and then description."""
    from .hits import term_hits

    hits = term_hits(prepped, rules) if hits is None else hits
    return two_phase_verdicts(candidates, hits, rules, params).filter("status != 'reject'")


def explain(judged: DataFrame, params: DataFrame) -> DataFrame:
    """(alert, id, line): what was decided and why."""
    d = judged.join(params.select("alert", "min_score"), "alert")
    why = (
        F.when(F.col("excluded_by").isNotNull(), F.concat(F.lit("excluded by "), "excluded_by"))
        .when(F.col("n_missing") > 0, F.concat(F.lit("missing required groups: "), F.col("n_missing").cast("string")))
        .when(F.size("hits") > 0, F.concat(F.lit("signals: "), F.array_join("hits", ", ")))
        .otherwise("no signals")
    )
    return d.select("alert", "id", F.concat_ws(" | ", "status", F.format_string("%.2f of %.2f", "score", "min_score"), why).alias("line"))
