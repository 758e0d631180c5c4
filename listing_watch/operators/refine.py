"""Rule changes proposed from marked listings: words to exclude, words to require, a threshold.

Cards have alert, id, mark (confirmed, rejected or null), score, terms and tterms (aligned), generic
and tt. Rules are in tight form: (alert, kind, grp, ord, term_t, weight). A term is in a card if it
is a substring of tt, without the guard for short codes. Joins are by alert."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import spread, stored
from . import automaton
from .blocks import by_size, in_blocks
from .hits import _gram_of, _grams

MAX_EXCLUDES, MAX_REQUIRES = 12, 8


def card_vocab(cards: DataFrame) -> DataFrame:
    """(alert, tterm, term): distinct tight terms of cards, the first surface by card and place."""
    d = cards.select("alert", "id", F.posexplode(F.arrays_zip("terms", "tterms")).alias("ord", "x")).select("alert", "id", "ord", "x.terms", "x.tterms")
    return d.filter("tterms != ''").groupBy("alert", F.col("tterms").alias("tterm")).agg(F.min_by("terms", F.struct("id", "ord")).alias("term"))


def generic_terms(cards: DataFrame) -> DataFrame:
    return cards.select("alert", F.explode("generic").alias("tterm")).distinct()


def _marks(cards: DataFrame) -> DataFrame:
    """(alert, confirmed, rejected, unmarked) counts."""
    m = F.col("mark")
    return cards.groupBy("alert").agg(F.count_if(m == "confirmed").alias("confirmed"), F.count_if(m == "rejected").alias("rejected"), F.count_if(m.isNull()).alias("unmarked"))


def _spread(cards: DataFrame, vocab: DataFrame, most: int = automaton.MOST, per_alert: int | None = None) -> DataFrame:
    """(alert, tterm, term, in_confirmed, in_rejected, in_unmarked): how many cards have each term.

    A card is read once for all terms of its alert. A vocabulary beyond the automaton's bound meets the
    cards in blocks, of which only counts come; alerts of more than `per_alert` (`blocks.TERMS`) terms
    go by 2-grams."""
    vocab = stored(vocab, "card-terms")
    words = vocab.select("alert", F.col("tterm").alias("term_t")).dropna()
    rows = automaton.few_enough(words, ["alert"], most)
    if rows is not None:
        g = _counted(automaton.find(spread(cards.select("alert", "mark", "tt")), rows, ["alert"], ["mark"], {"there": ("tt", "tt")}, guard=False).withColumnRenamed("term_t", "tterm").withColumn("k", F.lit(1)))
    else:
        few, many = by_size(words, ["alert"], per_alert)
        g = _counts_in_blocks(cards, few)
        if many is not None:
            g = g.unionByName(_counted(_on_grams(cards, many.withColumnRenamed("term_t", "tterm"))))
    return g.join(vocab, ["alert", "tterm"]).select("alert", "tterm", "term", "in_confirmed", "in_rejected", "in_unmarked")


def _counted(found: DataFrame) -> DataFrame:
    m = F.col("mark")
    n = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0)).cast("long")
    return found.groupBy("alert", "tterm").agg(n(m == "confirmed").alias("in_confirmed"), n(m == "rejected").alias("in_rejected"), n(m.isNull()).alias("in_unmarked"))


def _counts_in_blocks(cards: DataFrame, words: DataFrame) -> DataFrame:
    marks = ("confirmed", "rejected", None)

    def work(finder: automaton.Finder, rows: pa.Table) -> dict[str, list]:
        n: dict = {m: Counter() for m in marks}
        seen: dict[str, None] = {}
        for mark, tt in zip(rows.column("mark").to_pylist(), rows.column("tt").to_pylist()):
            found = finder.terms((), tt or "", "")
            seen.update(dict.fromkeys(found))
            if mark in n:
                n[mark].update(found)
        return {"tterm": list(seen), **{k: [n[m][x] for x in seen] for k, m in zip(("in_confirmed", "in_rejected", "in_unmarked"), marks)}}

    texts = cards.select("alert", "mark", "tt", F.xxhash64("id", "tt").alias("_part"))
    g = in_blocks(texts, F.octet_length("tt"), words, ["alert"], F.col("_part"), work, "tterm string, in_confirmed long, in_rejected long, in_unmarked long", guard=False)
    return g.groupBy("alert", "tterm").agg(*[F.sum(c).alias(c) for c in ("in_confirmed", "in_rejected", "in_unmarked")])


def _on_grams(cards: DataFrame, vocab: DataFrame) -> DataFrame:
    """(alert, tterm, mark, k): terms and cards of an alert that meet on 2-grams, as terms and listings
    do, and are found to contain one another; k equal cards are one row."""
    marked = cards.select("alert", "mark", "tt", F.xxhash64("id", "tt", "mark").alias("_card")).groupBy("alert", "_card").agg(F.first("mark").alias("mark"), F.first("tt").alias("tt"), F.count("*").alias("k"))
    met = marked.select("alert", "_card", F.explode(_grams(F.col("tt"), True)).alias("gram")).join(_gram_of(vocab.select("alert", F.col("tterm").alias("term_t")), ["alert"]), ["alert", "gram"])
    return met.select("alert", "_card", F.col("term_t").alias("tterm")).distinct().join(marked, ["alert", "_card"]).filter(F.contains("tt", F.col("tterm")))


def own_compound(term: Column, own: Column) -> Column:
    """Of a term nothing of substance is left without the alert's own words, longest first."""
    words = F.array_sort(F.transform(F.filter(own, lambda w: w != ""), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    rest = F.aggregate(words, term, lambda a, x: F.replace(a, x["w"], F.lit("")))
    return (F.length(F.regexp_replace(rest, r"[ぁ-ゖー\s]", "")) < 1) & (F.length(F.regexp_replace(rest, r"\s", "")) < 2)


def drop_redundant_rows(rows: DataFrame, prefer_shorter: bool, most: int | None = None) -> DataFrame:
    """Without terms that another as well evidenced (count) covers: the shorter stays, or the longer.
    An automaton of an alert's terms reads each of them, and only what stays comes of it; alerts of
    more than `most` (`blocks.TERMS`) terms go by substrings."""
    rows = stored(rows, "suggested-terms")
    few, many = by_size(rows, ["alert"], most)

    def run(key: tuple, found: pa.Table) -> pa.Table:
        if key[0].as_py() is None:
            return found
        words = found.column("tterm").to_pylist()
        n = {w: k for w, k in zip(words, found.column("count").to_pylist()) if w}
        finder, worse = automaton.Finder([(w,) for w in n], False), set()
        for w, k in n.items():
            for b in finder.terms((), w, ""):
                if len(b) < len(w) and (n[b] >= k if prefer_shorter else k >= n[b]):
                    worse.add(w if prefer_shorter else b)
        return found.filter(pa.array([w not in worse for w in words], pa.bool_()))

    kept = few.groupBy("alert").applyInArrow(run, few.schema)
    return kept if many is None else kept.unionByName(_less_redundant_by_substrings(many, prefer_shorter))


def _less_redundant_by_substrings(rows: DataFrame, prefer_shorter: bool) -> DataFrame:
    """Terms are short: containment is an equality with a proper substring, and no pairs are tried."""
    t, n = F.col("tterm"), F.length("tterm")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(t, i, k))))
    parts = rows.filter(n > 1).select("alert", F.col("tterm").alias("outer"), F.col("count").alias("n_outer"), F.explode(F.array_distinct(cut)).alias("inner"))
    both = parts.join(rows.select("alert", F.col("tterm").alias("inner"), F.col("count").alias("n_inner")), ["alert", "inner"])
    worse = both.filter("n_inner >= n_outer").select("alert", F.col("outer").alias("tterm")) if prefer_shorter else both.filter("n_outer >= n_inner").select("alert", F.col("inner").alias("tterm"))
    return rows.join(worse.distinct(), ["alert", "tterm"], "left_anti")


def rule_tights(rules: DataFrame) -> DataFrame:
    """(alert, require, signals, exclude): flattened rules in tight form, the required groups as arrays
    in order, the signals as a map from term to weight (the last of equal terms), the excludes in order."""
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "term_t", "weight"))))
    groups = rules.filter("kind = 'require'").groupBy("alert", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term_t"))), lambda x: x["term_t"]).alias("terms"))
    groups = groups.groupBy("alert").agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "terms"))), lambda x: x["terms"]).alias("require"))
    d = rules.groupBy("alert").agg(listed("signal").alias("s"), listed("exclude").alias("e")).join(groups, "alert", "left")
    # later weights of a term replace earlier ones
    last = F.filter("s", lambda x, i: ~F.exists(F.slice("s", i + 2, F.greatest(F.size("s") - i - 1, F.lit(0))), lambda y: y["term_t"] == x["term_t"]))
    signals = F.map_from_entries(F.transform(last, lambda x: F.struct(x["term_t"], x["weight"])))
    return d.select("alert", F.coalesce("require", F.array().cast("array<array<string>>")).alias("require"), signals.alias("signals"), F.transform("e", lambda x: x["term_t"]).alias("exclude"))


def suggest_excludes(cards: DataFrame, rules: DataFrame, keep: int = MAX_EXCLUDES) -> DataFrame:
    """(alert, place, term, tterm, count, broad, collateral, all): words of rejected cards that no
    protected card has. Confirmed cards are protected; unmarked ones only where none is confirmed."""
    marks = _marks(cards)
    vocab = card_vocab(cards.filter("mark = 'rejected'"))
    used = rules.filter("kind in ('exclude', 'require')").select("alert", F.col("term_t").alias("tterm")).distinct()
    own = rules.filter("kind in ('require', 'signal')").groupBy("alert").agg(F.collect_set("term_t").alias("own"))
    d = _spread(cards, vocab).join(used, ["alert", "tterm"], "left_anti").join(marks, "alert").join(own, "alert", "left")
    d = d.filter(~own_compound(F.col("tterm"), F.coalesce("own", F.array().cast("array<string>"))))
    yes = F.col("confirmed") > 0
    d = d.filter(F.when(yes, F.col("in_confirmed") == 0).otherwise(F.col("in_unmarked") == 0))
    broad = generic_terms(cards).withColumn("broad", F.lit(True))
    rows = d.join(broad, ["alert", "tterm"], "left").select("alert", "tterm", "term", F.col("in_rejected").alias("count"), F.when(yes, F.col("in_unmarked")).otherwise(0).alias("collateral"), F.coalesce("broad", F.lit(False)).alias("broad"), (F.col("in_rejected") == F.col("rejected")).alias("all"))
    rows = drop_redundant_rows(rows, True)
    w = Window.partitionBy("alert").orderBy("broad", "collateral", F.desc("count"), F.desc(F.length("tterm")), "tterm")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def suggest_requires(cards: DataFrame, rules: DataFrame, keep: int = MAX_REQUIRES) -> DataFrame:
    """(alert, place, term, tterm, count): words that every confirmed card has and no rejected one,
    not broad, not required yet; where any card is rejected and any confirmed."""
    marks = _marks(cards).filter("confirmed > 0 and rejected > 0")
    d = _spread(cards, card_vocab(cards.filter("mark = 'confirmed'"))).join(marks, "alert").filter("in_confirmed = confirmed and in_rejected = 0")
    d = d.join(generic_terms(cards), ["alert", "tterm"], "left_anti")
    d = d.join(rules.filter("kind = 'require'").select("alert", F.col("term_t").alias("tterm")).distinct(), ["alert", "tterm"], "left_anti")
    rows = drop_redundant_rows(d.select("alert", "tterm", "term", F.col("confirmed").alias("count")), False)
    w = Window.partitionBy("alert").orderBy(F.desc(F.length("tterm")), "tterm")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def suggest_threshold(cards: DataFrame, params: DataFrame) -> DataFrame:
    """(alert, value, clears, blocks): half-way between the kept and the rejected scores, where they
    are apart and it is above the present threshold."""
    d = cards.join(_marks(cards), "alert").filter("rejected > 0")
    kept = F.when(F.col("confirmed") > 0, F.col("mark") == "confirmed").otherwise(F.col("mark").isNull())
    g = d.groupBy("alert").agg(F.min(F.when(kept, F.col("score"))).alias("clears"), F.max(F.when(F.col("mark") == "rejected", F.col("score"))).alias("blocks"))
    g = g.join(params.select("alert", "min_score"), "alert", "left").withColumn("value", F.floor((F.col("clears") + F.col("blocks")) / 2 * 10 + 0.5) / 10)
    return g.filter((F.col("blocks") < F.col("clears")) & (F.col("value") > F.coalesce("min_score", F.lit(0.0))) & (F.col("value") <= F.col("clears"))).select("alert", "value", "clears", "blocks")


def suggest_warnings(cards: DataFrame, excludes: DataFrame, requires: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(alert, nothing_kept, nothing_confirmed, nothing_found) for alerts with a rejected card."""
    some = excludes.select("alert").union(requires.select("alert")).union(thresholds.select("alert")).distinct().withColumn("some", F.lit(True))
    d = _marks(cards).filter("rejected > 0").join(some, "alert", "left")
    kept = F.when(F.col("confirmed") > 0, F.col("confirmed")).otherwise(F.col("unmarked"))
    return d.select("alert", (kept == 0).alias("nothing_kept"), ((kept > 0) & (F.col("confirmed") == 0)).alias("nothing_confirmed"), ((F.col("confirmed") > 0) & F.col("some").isNull()).alias("nothing_found"))
