"""Quality rules as weak supervision (native: DataFrame functions only).

Every rule votes -1 (poor), +1 (good) or 0 (abstains) on a document. Expectation-maximisation
over the table of vote patterns, which has at most 3^rules rows whatever the corpus, estimates
how often each rule casts each vote on good and on poor documents, among those that pass the
base checks, until no estimate moves by more than TOLERANCE. It starts from the balance of the
votes. A prior of PRIOR_DOCS documents a class, the same at any size, keeps votes never seen
from certainty; all else is learned. A document is kept if the posterior probability of being
good is at least `threshold` and the base checks pass; no rule can reject alone unless its
estimated accuracy says so.

Defined results: a null or empty text has no words, fails the base and is not kept. An empty
table gives an empty result. Repeated rows are judged alike, each on its own. Columns of the
input are carried along, whatever their names; those made here start with `wq_`, and an input
column of the same name gives way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, packed, stored, unpacked, word_array

SYMBOLS = "[#*$%&|<>]"
#: The end of a line that closes a sentence.
ENDED = r"""[.!?:;…"')\]][ \t\r]*(\n|\z)"""
#: A word that ends in a letter, but for closing marks; and one that ends in a mark.
PLAIN = r"""\p{L}[.,;:!?…"')\]]{0,3}(?![^ \t-\r])"""
MARKED = r"[.,;:!?](?![^ \t-\r])"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_ROUNDS = 100
TOLERANCE = 1e-4
THRESHOLD = 0.5
#: What is believed of any rule's votes before any is seen, as shares of PRIOR_DOCS documents.
BELIEF = {"good": {-1: 0.05, 0: 0.25, 1: 0.7}, "poor": {-1: 0.4, 0: 0.3, 1: 0.3}}
PRIOR_DOCS = 20
PRIOR_GOOD = 0.8
#: A document starts as likely good if its votes' sum is over this share of the rules.
START = 0.25
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_loud", "n_ended", "n_plain", "n_marked"]


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(chars)).cast("long")


def _measured(docs: DataFrame, text_col: str, made: list[str]) -> DataFrame:
    """`row` (the columns of docs) and the measures, by their names without `wq_`."""
    d = packed(docs, None, made, t=F.coalesce(F.col(text_col), F.lit("")))
    t, w, h, s, p, lines = map(F.col, ("t", "w", "h", "s", "p", "lines"))
    d = d.withColumn("w", word_array(t))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("x", F.transform("w", lambda x: F.xxhash64(x)))
    x, n = F.col("x"), F.col("n_words").cast("int")
    later = lambda k: F.slice(x, k + 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    two = F.zip_with(later(0), later(1), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("h", F.zip_with(two, later(2), lambda a, b: F.xxhash64(a, b)))
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    d = d.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    again = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
    d = d.withColumn("p", F.sort_array(F.transform(again, lambda x: x["p"])))
    steps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1))).cast("long"))
    d = d.withColumn("lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NON_SPACE)))
    return d.select(
        "row",
        "n_words",
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct("x")).cast("long").alias("n_distinct"),
        _count(t, r"[!?\p{Lu}]").alias("n_loud"),
        _count(t, ENDED).alias("n_ended"),
        _count(t, PLAIN).alias("n_plain"),
        _count(t, MARKED).alias("n_marked"),
    )


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts the rules look at, all `wq_` columns.

    `wq_n_repeat_words`: words that lie in a window of three words found twice or more in the
    text. Windows are compared by a 64-bit hash of the hashes of their words; only texts with any
    repeated hash are sorted."""
    d = _measured(docs, text_col, [f"wq_{m}" for m in MEASURES])
    return unpacked(d, *[F.col(m).alias(f"wq_{m}") for m in MEASURES])


def rule_votes() -> dict[str, Column]:
    """Rule name -> vote in {-1, 0, 1} over the measures: poor on clear evidence, good on its clear
    absence, and nothing between."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))

    def vote(poor: Column, good: Column) -> Column:
        return F.when(poor, -1).when(good, 1).otherwise(0)

    size, loud = F.col("word_chars") / n, F.col("n_loud") / F.greatest(F.col("word_chars"), F.lit(1))
    symbols, plain, marked = F.col("n_symbols") / n, F.col("n_plain") / n, F.col("n_marked") / n
    repeats, copied, ended = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines, F.col("n_ended") / lines
    variety = F.col("n_distinct") / F.least(n, F.lit(1000))
    return {
        "symbols": vote(symbols > 0.1, symbols <= 0.02),
        "plain_words": vote(plain < 0.7, plain >= 0.85),
        "word_length": vote((size < 3) | (size > 10), (size >= 3.5) & (size <= 7)),
        "marks": vote((marked < 0.02) | (marked > 0.5), marked.between(0.05, 0.3)),
        "sentences": vote(ended < 0.5, ended >= 0.9),
        "shouting": vote(loud > 0.4, loud <= 0.15),
        "repeats": vote(repeats > 0.2, repeats <= 0.05),
        "copied_lines": vote(copied > 0.3, copied <= 0.05),
        "variety": vote(variety < 0.15, variety >= 0.3),
    }


def fit(votes: DataFrame, rules: list[str], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> dict:
    """EM over the pattern counts of `votes` (columns `v_<rule>`).

    Returns {"prior": P(good), "good": {rule: {vote: P}}, "poor": ...}. Each round is one
    aggregation of the pattern table to one row; the last is that after which no figure moved by
    more than `tolerance`."""
    cols = [f"v_{r}" for r in rules]
    patterns = stored(votes.groupBy(*cols).agg(F.count("*").alias("k")).coalesce(1), "quality-patterns")
    balance = reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in cols])
    post = 1 / (1 + F.exp(START * len(rules) - balance))
    model: dict = {}
    for _ in range(rounds):
        row = patterns.withColumn("q", post).agg(
            F.sum("k").alias("n"),
            F.sum(F.col("k") * F.col("q")).alias("g"),
            *[F.sum(F.when(F.col(c) == v, F.col("k") * F.col("q")).otherwise(0.0)).alias(f"{c}_{v}_g") for c in cols for v in (-1, 0, 1)],
            *[F.sum(F.when(F.col(c) == v, F.col("k") * (1 - F.col("q"))).otherwise(0.0)).alias(f"{c}_{v}_b") for c in cols for v in (-1, 0, 1)],
        ).first()
        n, g = float(row["n"] or 0), float(row["g"] or 0)
        last, model = model, {"prior": (g + PRIOR_GOOD * PRIOR_DOCS) / (n + PRIOR_DOCS), "good": {}, "poor": {}}
        for r, c in zip(rules, cols):
            for side, mark, size in (("good", "g", g), ("poor", "b", n - g)):
                model[side][r] = {v: (float(row[f"{c}_{v}_{mark}"] or 0) + PRIOR_DOCS * BELIEF[side][v]) / (size + PRIOR_DOCS) for v in (-1, 0, 1)}
        post = posterior(model, rules)
        if last and max(abs(model["prior"] - last["prior"]), *(abs(model[s][r][v] - last[s][r][v]) for s in ("good", "poor") for r in rules for v in (-1, 0, 1))) <= tolerance:
            break
    return model


def posterior(model: dict, rules: list[str]) -> Column:
    """P(good | votes) as a column over the `v_` columns."""
    odds: Column = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r in rules:
        gain = {v: math.log(model["good"][r][v] / model["poor"][r][v]) for v in (-1, 0, 1)}
        c = F.col(f"v_{r}")
        odds = odds + F.when(c < 0, gain[-1]).when(c > 0, gain[1]).otherwise(gain[0])
    return 1 / (1 + F.exp(-odds))


def _judged(docs: DataFrame, text_col: str, threshold: float, rounds: int, made: list[str]) -> DataFrame:
    """`row` with the measures, votes and verdict, by their names without `wq_`."""
    votes = rule_votes()
    d = _measured(docs, text_col, made)
    d = stored(d.withColumns({f"v_{r}": v.cast("tinyint") for r, v in votes.items()}), "quality-votes")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = d.withColumn("posterior", posterior(fit(d.filter(~F.col("base_failed")), list(votes), rounds), list(votes)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def judge(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, rounds: int = MAX_ROUNDS) -> DataFrame:
    """docs with the `wq_` measures, the votes as `wq_v_<rule>`, `wq_base_failed`, `wq_posterior` and
    `wq_kept`.

    Measures and votes are computed once and stored in the shared folder with the input's
    columns, so the text is read once and nothing is joined back."""
    made = [*MEASURES, *[f"v_{r}" for r in rule_votes()], "base_failed", "posterior", "kept"]
    d = _judged(docs, text_col, threshold, rounds, [f"wq_{m}" for m in made])
    return unpacked(d, *[F.col(m).alias(f"wq_{m}") for m in made])


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever those are named."""
    return unpacked(_judged(docs, text_col, threshold, MAX_ROUNDS, []).filter("kept"))
