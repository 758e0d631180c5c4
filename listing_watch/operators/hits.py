"""Which terms occur in which listings, and how often.

Up to FEW terms, the usual rule table, are tested in place, one literal after another. More, as far
as `automaton.few_enough` goes, are found by an Aho-Corasick automaton. Either way a listing's text
is read once where it lies and only its hits are shuffled. Still more terms meet the listings in an
equi-join on 2-grams: the distinct 2-grams of a listing's tight text, as narrow rows, against one
2-gram of each term (the character itself for terms of one), then `contains_term` on the pairs that
meet. All three give the same rows: one for each id and term, whether of one listing or of several
that repeat an id."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import codes_of, contains_term, fold, nfkc_each, padded_of
from ..sources.store import spread, stored
from . import automaton
from .blocks import by_size, in_blocks

FEW = 200
PASSES = 8
TEXTS = ["t_title", "s_title", "t_desc", "s_desc"]


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """df with cols, each worked out once a row: a generator of one row keeps the optimizer from
    writing them out again at every use."""
    x = F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_once")
    return df.select("*", x).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_once").getField(k).alias(k) for k in cols])


def prepared(listings: DataFrame) -> DataFrame:
    """listings with t_title, s_title, t_desc and s_desc; each text is normalised once."""
    a, b = nfkc_each([F.col("name"), F.col("description")])
    d = once(spread(listings).withColumns({"_a": a, "_b": b}), {"_c": fold(F.col("_a")), "_d": fold(F.col("_b"))})
    d = once(d, {"s_title": padded_of(F.col("_c")), "s_desc": padded_of(F.col("_d"))})
    # the tight form is the spaced one without its spaces
    forms = [f(k).alias(f"{x}_{k}") for k in ("title", "desc") for x, f in (("t", lambda k: F.replace(F.col(f"s_{k}"), F.lit(" "), F.lit(""))), ("s", lambda k: F.col(f"s_{k}")))]
    return d.select(*[F.col(f"`{c}`") for c in listings.columns], *forms)


def _grams(tight: Column, singles: bool) -> Column:
    """Distinct 2-grams of a tight text, with its characters if asked for."""
    c = F.filter(F.split(tight, ""), lambda x: x != "")
    n = F.greatest(F.size(c) - 1, F.lit(0))
    two = F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.concat(two, c) if singles else two)


def _gram_of(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term_t, gram): one gram of each term, that which the fewest other terms have."""
    grams = F.when(F.length("term_t") == 1, F.array("term_t")).otherwise(_grams(F.col("term_t"), False))
    g = words.select(*keys, "term_t", F.explode(grams).alias("gram"))
    n = g.groupBy("gram").count()
    return g.join(n, "gram").groupBy(*keys, "term_t").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))


def _folded(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys, "id", "term_t").agg(F.bool_or("in_title").alias("in_title"), F.bool_or("in_desc").alias("in_desc"))


def hits_within(prepped: DataFrame, terms: DataFrame, keys: list[str], most: int = automaton.MOST) -> DataFrame:
    """(keys, id, term_t, in_title, in_desc): as `term_hits`, each term being looked for in the
    listings of equal keys only. The terms are looked at, as far as `most`, while the query is put
    together."""
    rows = automaton.few_enough(terms, keys, most)
    if rows is None and keys and prepped.schema["id"].dataType.simpleString() == "string":
        few, many = by_size(_words(terms, keys), keys)
        found = _hits_in_blocks(prepped, few, keys)
        return found if many is None else found.unionByName(hits_on_grams(prepped, many, keys))
    if rows is None:
        return hits_on_grams(prepped, terms, keys)
    forms = {"in_title": ("t_title", "s_title"), "in_desc": ("t_desc", "s_desc")}
    return _folded(automaton.find(spread(prepped.select(*keys, "id", *TEXTS)), rows, keys, ["id"], forms), keys)


def found_by_id(finder: automaton.Finder, rows: Iterable[tuple]) -> tuple[dict, dict]:
    """The terms of each id of the rows (id, s_title, s_desc): in the title and in the description, and in either text."""
    title, either = {}, {}
    for i, a, b in rows:
        # the tight form is the spaced one without its spaces
        t, d = (finder.terms((), (s or "").replace(" ", ""), s or "") for s in (a, b))
        title.setdefault(i, (set(), set()))[0].update(t)
        title[i][1].update(d)
    for i, (t, d) in title.items():
        either[i] = t | d
    return title, either


def _block(rows: pa.Table) -> Iterable[tuple]:
    return zip(*[rows.column(c).to_pylist() for c in ("_id", "s_title", "s_desc")])


def _hits_in_blocks(prepped: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    def work(finder: automaton.Finder, rows) -> dict[str, list]:
        title, either = found_by_id(finder, _block(rows))
        hits = [(i, x, x in title[i][0], x in title[i][1]) for i, found in either.items() for x in sorted(found)]
        return dict(zip(("id", "term_t", "in_title", "in_desc"), map(list, zip(*hits) if hits else [()] * 4)))

    texts = prepped.select(*keys, F.col("id").alias("_id"), "s_title", "s_desc")
    size = F.octet_length("s_title") + F.octet_length("s_desc")
    return in_blocks(texts, size, terms, keys, F.col("_id"), work, "id string, term_t string, in_title boolean, in_desc boolean")


def _words(terms: DataFrame, keys: list[str]) -> DataFrame:
    return terms.select(*keys, "term_t").dropna().filter("term_t != ''").distinct()


def hit_counts(prepped: DataFrame, terms: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, term_t, df_all, df_title): how many ids of equal keys have each term, in all and in the
    title; terms that none has are left out. Texts and terms of a key meet in blocks, of which only
    counts come; keys of more than `most` (`blocks.TERMS`) terms go by their hits on 2-grams."""
    few, many = by_size(_words(terms, keys), keys, most)

    def work(finder: automaton.Finder, rows) -> dict[str, list]:
        title, either = found_by_id(finder, _block(rows))
        n, k = Counter(), Counter()
        for x in either.values():
            n.update(x)
        for x, _ in title.values():
            k.update(x)
        return {"term_t": list(n), "df_all": list(n.values()), "df_title": [k[x] for x in n]}

    texts = prepped.select(*keys, F.to_json(F.struct("id")).alias("_id"), "s_title", "s_desc")
    size = F.octet_length("s_title") + F.octet_length("s_desc")
    found = in_blocks(texts, size, few, keys, F.col("_id"), work, "term_t string, df_all long, df_title long")
    found = found.groupBy(*keys, "term_t").agg(F.sum("df_all").alias("df_all"), F.sum("df_title").alias("df_title"))
    if many is None:
        return found
    rest = hits_on_grams(prepped, many, keys).groupBy(*keys, "term_t").agg(F.count("*").alias("df_all"), F.count_if("in_title").alias("df_title"))
    return found.unionByName(rest)


def hits_on_grams(prepped: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """`hits_within` for any number of terms. A large group is spread over its grams."""
    words = terms.select(*keys, "term_t").filter("term_t != ''").distinct()
    texts = prepped.select(*keys, "id", *TEXTS, F.xxhash64(*TEXTS).alias("_h"))
    grams = _grams(F.concat("t_title", F.lit("\0"), "t_desc"), True)
    met = texts.select(*keys, "id", "_h", F.explode(grams).alias("gram")).join(_gram_of(words, keys), [*keys, "gram"])
    # the terms that may be in a text come to it together, so that it is moved once
    met = met.groupBy(*keys, "id", "_h").agg(F.collect_set("term_t").alias("_terms"))
    one = texts.dropDuplicates([*keys, "id", "_h"]).withColumnsRenamed({c: f"_{c}" for c in [*keys, "id"]}).withColumnRenamed("_h", "_g")
    same = F.col("_h") == F.col("_g")
    for c in [*keys, "id"]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return _folded(_coded(met.join(one, same)).select(*keys, "id", _found(F.col("_terms"))).select(*keys, "id", "x.*"), keys)


def _coded(prepped: DataFrame) -> DataFrame:
    """With what `contains_term` needs of each text, worked out once."""
    return once(prepped, {f"_codes_{k}": codes_of(F.col(f"t_{k}"), F.col(f"s_{k}")) for k in ("title", "desc")})


def _found(words: Column) -> Column:
    """A row `x` (term_t, in_title, in_desc) for each of the words that the coded texts have."""
    has = lambda t, k: contains_term(t, F.col(f"t_{k}"), F.col(f"s_{k}"), F.col(f"_codes_{k}"))
    test = lambda t: F.struct(t.alias("term_t"), has(t, "title").alias("in_title"), has(t, "desc").alias("in_desc"))
    return F.explode(F.filter(F.transform(words, test), lambda x: x["in_title"] | x["in_desc"])).alias("x")


def term_hits(prepped: DataFrame, terms: DataFrame, few: int = FEW) -> DataFrame:
    """(id, term_t, in_title, in_desc): a row for each id and distinct tight term that a listing of
    that id has. The terms are looked at, as far as `few`, while the query is put together."""
    words = terms.select("term_t").filter("term_t != ''").distinct()
    some = sorted(r[0] for r in words.limit(few + 1).collect())
    if len(some) > few:
        return hits_within(prepped, words, [])
    words = F.array(*map(F.lit, some)) if some else F.array().cast("array<string>")
    return _folded(_coded(prepped.select("id", *TEXTS)).select("id", _found(words)).select("id", "x.*"), [])


def term_counts(prepped: DataFrame, terms: DataFrame, most: int = automaton.MOST) -> DataFrame:
    """(term_t, listings): how many listings, by id, have each term; 0 for those in none.

    Up to PASSES times `most` terms are found by one automaton after another, and only the numbers of a
    text's terms are kept of it; terms beyond that go by their hits."""
    terms = terms.select("term_t").distinct()
    rows = automaton.few_enough(terms, [], PASSES * most, PASSES * automaton.CHARS)
    if rows is None or len(rows) <= FEW:
        n = term_hits(prepped, terms).groupBy("term_t").agg(F.count("*").alias("listings"))
    else:
        texts = spread(prepped.select("id", "s_title", "s_desc"))
        texts = stored(texts, "spaced-texts") if len(rows) > most else texts
        n = reduce(DataFrame.unionByName, [_counts_of(texts, rows[i : i + most]) for i in range(0, len(rows), most)])
    return terms.join(n, "term_t", "left").select("term_t", F.coalesce("listings", F.lit(0)).alias("listings"))


def _counts_of(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    """(term_t, listings) of the terms that any listing has."""
    shared = automaton.Shared(texts.sparkSession, rows, True)

    def look(batches):
        finder = shared.finder()
        number = {t: i for i, (t,) in enumerate(shared.rows.value)}
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                found = []
                for a, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    some = set().union(*(finder.terms((), (s or "").replace(" ", ""), s or "") for s in (a, d)))
                    found.append([number[x] for x in some])
                yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["id", "at"])

    def name(batches):
        for b in batches:
            yield pa.record_batch([pa.array([shared.rows.value[i][0] for i in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["term_t", "listings"])

    found = stored(texts.mapInArrow(look, T.StructType([texts.schema["id"], T.StructField("at", T.ArrayType(T.IntegerType()))])), "numbers-found")
    # an id counts once, however many listings repeat it; as a rule none does
    again = stored(found.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again")), "repeated-ids")
    at = F.explode("at").alias("at")
    if again.isEmpty():
        one = found.select(at)
    else:
        same = F.col("id").eqNullSafe(F.col("again"))
        one = found.join(again, same, "left_anti").select(at).unionByName(found.join(again, same, "left_semi").select("id", at).distinct().select("at"))
    return one.groupBy("at").agg(F.count("*").alias("listings")).mapInArrow(name, "term_t string, listings long")
