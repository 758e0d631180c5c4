"""Many terms in many texts: an Aho-Corasick automaton run once over each text.

The terms, with the keys each belongs to, are looked at on the driver up to MOST rows and CHARS
characters in all, LONGEST in one; what is within that bound goes to the tasks as one broadcast list,
from which each worker builds the automaton once. A task reads a text once, however many terms there
are, and emits the terms found, so only hits are shuffled. Beyond the bound `few_enough` gives None
and the caller meets terms and texts on grams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SHORT_CODE

MOST = 300_000
CHARS = 6_000_000
LONGEST = 256

_CODE = re.compile(rf"[0-9a-z]{{1,{SHORT_CODE}}}")
_CODES = re.compile("[0-9a-z]+")
_BUILT: dict[str, "Finder"] = {}


def few_enough(terms: DataFrame, keys: list[str], most: int = MOST, chars: int = CHARS) -> list[tuple] | None:
    """The rows (keys, term_t) of `terms`, sorted and each once, or None where they, repeats among them,
    are beyond the bound or a term is longer than LONGEST. Terms that are empty and keys that are null
    find nothing and are left out."""
    d = terms.select(*keys, "term_t").dropna().filter("term_t != ''")
    short = d.withColumn("term_t", F.when(F.length("term_t") <= LONGEST, F.col("term_t")))
    table = short.limit(most + 1).toArrow()
    names = table.column("term_t")
    if len(names) > most or names.null_count or (pc.sum(pc.utf8_length(names)).as_py() or 0) > chars:
        return None
    return sorted(set(zip(*[c.to_pylist() for c in table.columns])))


class Finder:
    """The terms of each key, found in texts. With `guard` short codes must stand free of other letters
    and digits, as `contains_term` has it; otherwise every term is found as a substring."""

    def __init__(self, rows: list[tuple], guard: bool) -> None:
        self.owners: dict[str, set[tuple]] = {}
        for *key, term in rows:
            self.owners.setdefault(term, set()).add(tuple(key))
        self.keyed = bool(rows) and len(rows[0]) > 1
        self.codes = {t for t in self.owners if guard and _CODE.fullmatch(t)}
        self.automaton = ahocorasick.Automaton()
        for t in self.owners:
            if t not in self.codes:
                self.automaton.add_word(t, t)
        self.has_long = len(self.automaton) > 0
        if self.has_long:
            self.automaton.make_automaton()

    def terms(self, key: tuple, t: str, s: str) -> set[str]:
        """The terms of the key that a text has; t is its tight form, s its spaced one."""
        found = {term for _, term in self.automaton.iter(t)} if self.has_long else set()
        if self.codes:
            words = set(s.split())
            words.update(_CODES.findall(t))
            if not s.isascii():
                words.update(_CODES.findall(s))
            found |= self.codes & words
        return {x for x in found if key in self.owners[x]} if self.keyed else found


class Shared:
    """A finder for the tasks of one job: the rows are broadcast, and a worker builds it once."""

    def __init__(self, spark: SparkSession, rows: list[tuple], guard: bool) -> None:
        self.name, self.guard = uuid.uuid4().hex, guard
        self.rows = spark.sparkContext.broadcast(rows)

    def finder(self) -> Finder:
        if self.name not in _BUILT:
            _BUILT.clear()
            _BUILT[self.name] = Finder(self.rows.value, self.guard)
        return _BUILT[self.name]


def find(texts: DataFrame, rows: list[tuple], keys: list[str], keep: list[str], forms: dict[str, tuple[str, str]], guard: bool = True) -> DataFrame:
    """(keys, keep, term_t, and a boolean for each of `forms`): a row for each row of texts and each
    term of its keys in any of its forms, which name columns (tight, spaced). A null text is empty."""
    shared = Shared(texts.sparkSession, rows, guard)
    n, m = len(keys), len(keep)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = shared.finder()
        for b in batches:
            key_cols = [b.column(i).to_pylist() for i in range(n)]
            at: list[int] = []
            terms: list[str] = []
            flags: list[list[bool]] = [[] for _ in forms]
            for r in range(b.num_rows):
                key = tuple(c[r] for c in key_cols)
                hits = [finder.terms(key, b.column(n + m + 2 * i)[r].as_py() or "", b.column(n + m + 2 * i + 1)[r].as_py() or "") for i in range(len(forms))]
                some = sorted(set().union(*hits))
                at += [r] * len(some)
                terms += some
                for flag, h in zip(flags, hits):
                    flag += [x in h for x in some]
            take = pa.array(at, pa.int64())
            yield pa.record_batch([*[b.column(i).take(take) for i in range(n + m)], pa.array(terms, pa.string()), *[pa.array(f, pa.bool_()) for f in flags]], names=[*keys, *keep, "term_t", *forms])

    d = texts.select(*keys, *keep, *[F.col(c) for pair in forms.values() for c in pair])
    out = T.StructType([*d.schema.fields[: n + m], T.StructField("term_t", T.StringType()), *[T.StructField(f, T.BooleanType()) for f in forms]])
    # columns of equal names, as where tight and spaced are one, would be ambiguous: by place
    return d.toDF(*[f"c{i}" for i in range(len(d.columns))]).mapInArrow(look, out)
