"""The text layer: normal forms for matching, and containment of terms.

`tight` folds width, case and kana and drops every other character; `spaced` does the same but
keeps one space where characters were dropped. Only NFKC needs Python, in Arrow batches; all else
is native. Null is the empty text throughout."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The code point range of katakana with a hiragana counterpart, and the shift.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Fixed value: what the tight form keeps, as the inside of a regex class.
KEPT = "0-9a-zぁ-ゖ一-鿿ー々"
#: Fixed value: characters that NFKC leaves as they are, whatever stands beside them, as the inside of
#: a regex class of Java and of Python.
STABLE = "\\x00-\\x7FÀ-ÿ–—‘-„、。ぁ-ゖァ-ヾ一-鿿"
#: Codes of ASCII letters and digits up to this length must stand free of others.
SHORT_CODE = 6


def few_at_once(texts: pa.Array, size: int = 1_000_000) -> Iterator[pa.Array]:
    """Slices of texts, or of lists of texts, of some `size` bytes; a single longer one comes alone. What
    is made of a text can be many times its size, so that a whole Arrow batch of it would not be bounded."""
    sums = lambda n: pc.cumulative_sum(pc.cast(pc.fill_null(n, 0), pa.int64())).to_pylist()
    if pa.types.is_list(texts.type):
        inner = [0, *sums(pc.binary_length(texts.flatten()))]
        ends = [inner[i] for i in sums(pc.list_value_length(texts))]
    else:
        ends = sums(pc.binary_length(texts))
    start, before = 0, 0
    for i, end in enumerate(ends):
        if i > start and end - before > size:
            yield texts.slice(start, i - start)
            start, before = i, ends[i - 1]
    yield texts.slice(start)


@F.arrow_udf(T.StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield from (pa.array([x and unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string()) for texts in few_at_once(b))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        yield from (pa.array([x and [y and unicodedata.normalize("NFKC", y) for y in x] for x in texts.to_pylist()], pa.list_(pa.string())) for texts in few_at_once(b))


def is_odd(text: Column) -> Column:
    """May NFKC change the text? Classes of one range are several times faster than `STABLE`, so that
    is looked for only in what a text has beyond Latin-1."""
    beyond = F.regexp_replace(text, "[\\x00-\\xFF]+", "")
    return text.rlike("[^\\x00-\\x7F]") & (text.rlike("[\\x80-\\xBF]") | beyond.rlike(f"[^{STABLE}]"))


def nfkc(text: Column) -> Column:
    odd = F.when(is_odd(text), text)
    return F.coalesce(_nfkc(odd), text, F.lit(""))


def nfkc_each(texts: list[Column]) -> list[Column]:
    """`nfkc` of several texts of a row in one pass through Python, rather than one worker for each."""
    odd = [F.when(is_odd(x), x) for x in texts]
    some = _nfkc_each(F.when(F.coalesce(*odd).isNotNull(), F.array(*odd)))
    return [F.coalesce(some[i], x, F.lit("")) for i, x in enumerate(texts)]


def kata_to_hira(text: Column) -> Column:
    """Katakana as hiragana; the long-vowel mark and the middle dot stay."""
    return F.when(text.rlike(f"[{KATAKANA[0]}-{KATAKANA[-1]}]"), F.translate(text, KATAKANA, HIRAGANA)).otherwise(text)


def fold(normal: Column) -> Column:
    """Case and kana of a text in NFKC folded."""
    return kata_to_hira(F.lower(normal))


def folded(text: Column) -> Column:
    return fold(nfkc(text))


def _kept(folded_text: Column, instead: str) -> Column:
    """What is not kept replaced, by the short class where a text has no character that only the whole
    class keeps: those lie between 々 and 鿿."""
    whole = F.regexp_replace(folded_text, f"[^{KEPT}]+", instead)
    return F.when(folded_text.rlike("[々-鿿]"), whole).otherwise(F.regexp_replace(folded_text, "[^0-9a-z]+", instead))


def tight_of(folded_text: Column) -> Column:
    return _kept(folded_text, "")


def spaced_of(folded_text: Column) -> Column:
    return F.trim(_kept(folded_text, " "))


def padded_of(folded_text: Column) -> Column:
    """The spaced form with a space on either side."""
    return F.concat(F.lit(" "), spaced_of(folded_text), F.lit(" "))


def tight(text: Column) -> Column:
    return tight_of(folded(text))


def spaced(text: Column) -> Column:
    return spaced_of(folded(text))


def prep(text: Column) -> Column:
    """Struct of the tight form `t` and the spaced form `s`, padded by a space on either side."""
    f = folded(text)
    return F.struct(tight_of(f).alias("t"), padded_of(f).alias("s"))


def is_short_code(term_t: Column) -> Column:
    return term_t.rlike(f"^[0-9a-z]{{1,{SHORT_CODE}}}$")


def codes_of(t: Column, s: Column) -> Column:
    """The letters and digits of a text's two forms, a space for all else between them; null where
    the forms are nothing but letters, digits and spaces. For `contains_term`, worked out once a text."""
    codes = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, "[^0-9a-z]+", " "), F.lit(" "))
    # all else that the forms keep is beyond ASCII
    return F.when(F.octet_length(t) > F.length(t), F.concat(codes(t), codes(s)))


def contains_term(term_t: Column, t: Column, s: Column, codes: Column | None = None) -> Column:
    """Is the tight term in the text? Short codes must not touch another letter or digit, in the
    tight or the spaced form. An empty term is in nothing."""
    # what stands free in the spaced form is contiguous in the tight form too
    there = (F.length(term_t) > 0) & F.contains(t, term_t)
    word = F.concat(F.lit(" "), term_t, F.lit(" "))
    free = F.contains(s, word) | (t == term_t) | F.coalesce(F.contains(codes_of(t, s) if codes is None else codes, word), F.lit(False))
    return F.coalesce(there & (~is_short_code(term_t) | free), F.lit(False))


def contains_literal(term_t: str, t: Column, s: Column) -> Column:
    """`contains_term` for a term known beforehand."""
    if not term_t:
        return F.lit(False)
    there = F.contains(t, F.lit(term_t))
    if re.fullmatch(f"[0-9a-z]{{1,{SHORT_CODE}}}", term_t):
        free = f"(?<![0-9a-z]){term_t}(?![0-9a-z])"
        there = there & (s.rlike(free) | t.rlike(free))
    return F.coalesce(there, F.lit(False))


def contains_any(terms: list[Column], t: Column, s: Column) -> Column:
    """The first of the tight terms that the text contains, or null."""
    return F.coalesce(*[F.when(contains_term(x, t, s), x) for x in terms])


def fingerprint(title_t: Column, price: Column, seller: Column) -> Column:
    """16 hex digits of SHA-1 over tight title, price step of 500 and seller."""
    step = F.coalesce(F.floor(F.when(price != 0, price) / 500), F.lit(0)).cast("string")
    return F.substring(F.sha1(F.concat(title_t, F.lit("|"), step, F.lit("|"), F.coalesce(seller, F.lit("")))), 1, 16)
