"""Language of each word, and of each text, by a linear-chain conditional random field.

A word's features are its affixes, its letter n-grams and, from a lexicon, the languages it is
mostly seen in; transition scores are learned from training chains of which some switch their
language half-way. Forward-backward gives each word's label probabilities; a text's language is
the one with the greatest sum over its words that have a letter.

The model is fitted on a bounded sample: at most LINES_PER_LANG lines for each language, from
documents picked by a hash of their id. Lines over LINE_CHARS characters are cut, at white space
where there is any; lines under LEAST_CHARS serve only languages that have no others. Predictions read
whole texts, in chains of CHAIN consecutive words; a word over MAX_LETTERS characters, as in text
without spaces, is cut into pieces that count as words of their own.

Defined results: a null text, or one without a letter, is `und` with score 0. Without any
labelled row to learn from, every text is `und`. Rows are predicted alone, from the text only;
ties go to the language that sorts first. Columns made here start with `lc_`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import groups, packed, unpacked

LINES_PER_LANG = 1500
DOCS_PER_LANG = 600
LINE_CHARS = 2000
LEAST_CHARS = 20
BUCKETS = 1 << 15
CHAIN = 256
SALTS = 32
CACHE_WORDS = 300_000
NONE = "und"
LETTER = r"\p{L}"
EDGES = ".,;:!?\"'()[]{}|*#$%&<>"
MAX_LETTERS = 40


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def pieces(text: str) -> tuple[list[str], list[int]]:
    """The words of a text, those over MAX_LETTERS characters cut into consecutive pieces, and how
    many pieces each word has."""
    words = text.split()
    if max(map(len, words), default=0) <= MAX_LETTERS:
        return words, [1] * len(words)
    cut = [[w[i : i + MAX_LETTERS] for i in range(0, len(w), MAX_LETTERS)] for w in words]
    return list(chain.from_iterable(cut)), list(map(len, cut))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word places, feature buckets): letter n-grams of two and three, with marks at both ends so
    that those at an end are affixes, and affixes of three letters. Words without a letter have
    none. All words together, in numpy over their code points."""
    plain = [w.lower().strip(EDGES) for w in words]
    at = np.array([i for i, w in enumerate(plain) if w.isalpha() or any(map(str.isalpha, w))], np.int64)
    if not len(at):
        return at, at
    marked = [f"^{plain[i]}$" for i in at]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) for w in marked], np.int64)
    owner, start = np.repeat(np.arange(len(at)), size), np.cumsum(size) - size
    who, found = [], []

    def take(first: np.ndarray, n: int) -> None:
        h = np.full(len(first), n, np.uint64)
        for k in range(n):
            h = (h ^ c[first + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        who.append(owner[first])
        found.append((h % np.uint64(BUCKETS)).astype(np.int64))

    for n in (2, 3):
        first = np.arange(len(c) - n + 1)
        take(first[owner[first] == owner[first + n - 1]], n)
    long = size >= 4
    take(start[long], 4)
    take((start + size - 4)[long], 4)
    return at[np.concatenate(who)], np.concatenate(found)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, int]  # word -> feature that says which language it is mostly seen in
    cache: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """word_features, and the lexicon's feature for each word that has one."""
        who, found = word_features(words)
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if not known:
            return who, found
        return np.concatenate([who, [i for i, _ in known]]), np.concatenate([found, [f for _, f in known]])

    def rows(self, words: list[str]) -> np.ndarray:
        """Places of words in `scores`."""
        if self.scores is None or len(self.cache) > CACHE_WORDS:
            self.cache, self.scores = {}, np.zeros((0, len(self.langs) + 1), np.float32)
        new = list(set(words) - self.cache.keys())
        who, found = self.features(new)
        rows = np.zeros((len(new), len(self.langs) + 1), np.float32)
        for k in range(len(self.langs)):
            rows[:, k] = np.bincount(who, self.weights[found, k], len(new))
        rows[who, -1] = 1  # has a letter, and counts in the text's vote
        n = len(self.scores)
        self.scores = np.concatenate([self.scores, rows])
        self.cache.update(zip(new, range(n, n + len(new))))
        return np.array(list(map(self.cache.__getitem__, words)), np.int64)

    def probabilities(self, words: list[str], lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For the words of chains of these lengths: label probabilities, and whether each word has a
        letter."""
        at = self.rows(words)  # may replace scores
        got = self.scores[at]
        m, _, _ = crf.marginals(got[:, :-1].astype(np.float64), np.array(lengths), self.start, self.trans)
        return m, got[:, -1] > 0

    def label_words(self, text: str | None) -> list[tuple[str, str]]:
        """Each word of a text with its language; `und` for words without a letter."""
        words = (text or "").split()
        if not words:
            return []
        items, sizes = pieces(text)
        m, real = self.probabilities(items, cuts(len(items)))
        start = np.cumsum([0, *sizes[:-1]])
        m, real = np.add.reduceat(m * real[:, None], start), np.logical_or.reduceat(real, start)
        return [(w, self.langs[k] if r else NONE) for w, k, r in zip(words, m.argmax(axis=1), real)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of each text, and its share of the words' probability."""
        cut = [pieces(t)[0] for t in texts]
        words = list(chain.from_iterable(cut))
        if not words:
            return [(NONE, 0.0)] * len(texts)
        m, real = self.probabilities(words, [n for c in cut for n in cuts(len(c))])
        who = np.repeat(np.arange(len(cut)), [len(c) for c in cut])[real]
        votes = np.stack([np.bincount(who, m[real, k], len(texts)) for k in range(len(self.langs))], axis=1)
        total = votes.sum(axis=1)
        top = votes.argmax(axis=1)
        return [(self.langs[k], min(1.0, float(votes[i, k] / total[i]))) if total[i] > 0 else (NONE, 0.0) for i, k in enumerate(top.tolist())]


def cuts(n: int) -> list[int]:
    """Lengths of the chains that n words are cut to."""
    return [min(CHAIN, n - i) for i in range(0, n, CHAIN)]


def fit(lines: list[tuple[str, str]], rounds: int = 40) -> Model | None:
    """A model from (language, line) pairs, in any order; None if there are none."""
    lines = sorted({(a, b) for a, b in lines if any(map(str.isalpha, b))}, key=lambda x: (zlib.crc32(x[1].encode("utf-8", "replace")), x))
    langs = sorted({a for a, _ in lines})
    if not langs:
        return None
    number = {a: i for i, a in enumerate(langs)}
    seen = Counter((w, a) for a, t in lines for w in set(pieces(t)[0]))
    total = Counter()
    for (w, _), n in seen.items():
        total[w] += n
    lexicon = {w: BUCKETS + number[a] for (w, a), n in seen.items() if n >= 4 and n >= 0.9 * total[w]}
    model = Model(langs, np.zeros((BUCKETS + len(langs), len(langs)), np.float32), np.zeros(len(langs)), np.zeros((len(langs), len(langs))), lexicon)
    chains: list[list[str]] = []
    labels: list[int] = []
    for i, (a, t) in enumerate(lines):
        words = pieces(t)[0][:CHAIN]
        if i % 3 == 0 and chains:  # a chain that switches
            chains[-1] = chains[-1] + words
        else:
            chains.append(words)
        labels += [number[a]] * len(words)
    types: dict[str, int] = {}
    items = np.array([types.setdefault(w, len(types)) for c in chains for w in c])
    who, flat = model.features(list(types))
    order = np.argsort(who, kind="stable")
    flat, offsets = flat[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(types)))])
    w, model.start, model.trans = crf.train(flat, offsets, items, np.array(labels), np.array([len(c) for c in chains]), BUCKETS + len(langs), len(langs), rounds)
    model.weights = w.astype(np.float32)
    return model


def sample_lines(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> list[tuple[str, str]]:
    """The bounded training sample, from rows with a language that are not held out."""
    rows = docs.select(F.col(id_col).alias("lc_id"), F.col(lang_col).alias("lc_lang"), F.col(text_col).alias("lc_text")).filter(F.col("lc_lang").isNotNull() & ~held_out(F.col("lc_id")) & F.col("lc_text").rlike(LETTER))
    sizes = {r["lc_lang"]: r["n"] for r in rows.groupBy("lc_lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, DOCS_PER_LANG / n))])
    picked = rows.filter(F.pmod(F.xxhash64(F.col("lc_id").cast("string")), F.lit(1_000_000)) < share[F.col("lc_lang")] * 1_000_000)
    # up to the last white space in reach, or so much of a word that has none
    parts = F.lit(rf"(?s)(\S(?:.{{0,{LINE_CHARS - 2}}}\S)?(?!\S)|\S{{1,{LINE_CHARS}}})")
    cut = F.flatten(F.transform(F.split("lc_text", "\n"), lambda x: F.when(F.length(x) <= LINE_CHARS, F.array(x)).otherwise(F.regexp_extract_all(x, parts, 1))))
    lines = picked.select("lc_lang", F.explode(F.filter(cut, lambda x: x.rlike(LETTER))).alias("lc_line")).distinct()
    order = Window.partitionBy("lc_lang", F.pmod(F.xxhash64("lc_line"), F.lit(SALTS))).orderBy(F.length("lc_line") < LEAST_CHARS, F.xxhash64("lc_line", F.lit(1)), "lc_line")
    least = lines.withColumn("lc_rank", F.row_number().over(order)).filter(F.col("lc_rank") <= max(1, LINES_PER_LANG // SALTS))
    got = [(r["lc_lang"], r["lc_line"]) for r in least.select("lc_lang", "lc_line").collect()]
    long = {a for a, x in got if len(x) >= LEAST_CHARS}
    return [(a, x) for a, x in got if len(x) >= LEAST_CHARS or a not in long]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with `lc_lang` and `lc_score`."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    made = [T.StructField("lc_lang", T.StringType()), T.StructField("lc_score", T.DoubleType())]
    names = [f.name for f in made]
    src = packed(docs, keep, names, text=F.col(f"`{text_col}`"))
    if model is None:
        return unpacked(src, F.lit(NONE).alias("lc_lang"), F.lit(0.0).alias("lc_score"))
    schema = T.StructType([src.schema["row"], *made])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in groups(batches, 1):
            got = m.predict([x or "" for x in b.column(1).to_pylist()])
            cols = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *names])

    return unpacked(src.mapInArrow(run, schema), *names)


def learn_and_predict(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """`id_col`, `lc_lang`, `lc_score` for every row of docs."""
    return predict(docs, fit(sample_lines(docs, text_col, lang_col, id_col)), text_col, [id_col])
