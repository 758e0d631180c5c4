"""Lines that many documents share, found by two Bloom filters and confirmed exactly.

A line's key is the line without white space at its ends, A-Z in lower case; only keys of at least
`min_chars` code points count. Each task reads its documents once and keeps two filters of `bits`
bits: one of the keys it has met, one of those it has met again in another document. Filters of two
tasks join as (once | once', twice | twice' | once & once'), so a key of two documents is in the
joint second filter wherever they lie. The filters travel as slices, sparse ones as lists of their
places, and slices are joined in a tree of FAN tasks a step.

Only keys that the second filter knows are shuffled, as SHA-256 digests with their document's id;
they are counted exactly, by distinct ids, so what the filter takes wrongly has no effect. A key of
`least_docs` documents or more stays in that of the largest id only and is dropped elsewhere. A
filter of the ids that lose lines is broadcast too, so that of the texts only those are shuffled.

Memory is 2 * bits / 8 bytes a task and bits / 8 bytes of each filter broadcast, at any size of the
table. With N distinct keys and bits = 2^28 about 5e-7 of the once-seen keys are suspected at
N = 17 million, 0.5 per cent at 67 million and 12 per cent at 134 million. Beyond that more and more
keys are shuffled, all of them at worst; the result is the same at any filling. Give more bits for
larger tables.

Keys of so many documents that one task would feel them, at most HOT of them by their share of all
suspects, meet their documents by broadcast; the others are joined by key.

Defined results: a null or empty text is one empty line. Rows that repeat an id count as one
document, and all rows of the largest id keep their lines. A row without an id is not counted and
keeps its text. Repeated lines of one document are all kept or all dropped. An empty table gives an
empty result. Columns made here start with `ld_`; a caller's column of such a name gives way.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, packed, stored, unpacked

BITS = 1 << 28
HASHES = 4
SLICE = 1 << 20
FAN = 256
HOT = 10_000
MIN_CHARS, LEAST_DOCS = 40, 5
MADE = ["ld_n_lines", "ld_n_dropped", "ld_text"]


def key_of(line: str, min_chars: int) -> bytes | None:
    """The key of a line in UTF-8, None if it is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE_CHARS)
    return key.encode().lower() if len(key) >= min_chars else None  # bytes: A-Z alone


def keys_of(text: str | None, min_chars: int) -> list[bytes]:
    """The distinct keys of a text."""
    found = (key_of(line, min_chars) for line in (text or "").split("\n"))
    return list(dict.fromkeys(k for k in found if k is not None))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places of each 64-bit hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(HASHES, dtype=np.uint64)
    return (hashes[:, None] + turns * step[:, None] * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)


def within(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Are all places of a row set?"""
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def set_bits(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


class Filters:
    """Keys met, and keys met again."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Adds hashes, each standing for one document's key."""
        some, n = np.unique(hashes, return_counts=True)
        at = places(some, self.bits)
        again = within(self.once, at) | (n > 1)
        set_bits(self.twice, at[again])
        set_bits(self.once, at)


def to_bytes(bitmap: np.ndarray) -> bytes:
    """A slice of a bitmap, as a list of places where that is shorter."""
    filled = np.flatnonzero(bitmap)
    if len(filled) * 8 > len(bitmap):
        return b"d" + zstandard.compress(bitmap.tobytes(), 1)
    bit = np.unpackbits(bitmap[filled], bitorder="little").reshape(-1, 8)
    row, col = np.nonzero(bit)
    at = (filled[row] * 8 + col).astype(np.uint32)
    return b"s" + zstandard.compress(np.diff(at, prepend=np.uint32(0)).tobytes(), 1)


def from_bytes(data: bytes, size: int) -> np.ndarray:
    raw = zstandard.decompress(data[1:])
    if data[:1] == b"d":
        return np.frombuffer(raw, np.uint8)
    out = np.zeros(size // 8, np.uint8)
    at = np.cumsum(np.frombuffer(raw, np.uint32), dtype=np.uint64)
    set_bits(out, at)
    return out


_PART = "fan int, slice int, once binary, twice binary"


def _filled(bits: int, hashes_of):
    """Partial filters of the hashes that `hashes_of` makes of a column's batches."""
    size = min(SLICE, bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(bits)
        for b in batches:
            for hashes in hashes_of(b.column(0)):
                f.add(hashes)
        fan = TaskContext.get().partitionId() // FAN
        rows = zip(f.once.reshape(-1, size // 8), f.twice.reshape(-1, size // 8))
        for i, (once, twice) in enumerate(rows):
            if once.any():
                yield pa.record_batch([pa.array([fan], pa.int32()), pa.array([i], pa.int32()), pa.array([to_bytes(once)], pa.binary()), pa.array([to_bytes(twice)], pa.binary())], names=["fan", "slice", "once", "twice"])

    return fill


def _line_hashes(min_chars: int):
    """Of each text the distinct keys, hashed, some texts at a time."""

    def hashes(texts: pa.Array) -> Iterator[np.ndarray]:
        held: list[int] = []
        for text in texts:
            held += map(xxhash.xxh64_intdigest, keys_of(text.as_py(), min_chars))
            if len(held) >= 1 << 16:
                yield np.array(held, np.uint64)
                held = []
        yield np.array(held, np.uint64)

    return hashes


def _as_hashes(longs: pa.Array) -> Iterator[np.ndarray]:
    yield longs.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _joined(parts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """One row for each of the keys: its slices, which come one after another, joined."""

    def out(key: tuple, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([to_bytes(once)], pa.binary()), pa.array([to_bytes(twice)], pa.binary())], names=["fan", "slice", "once", "twice"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, once, twice = None, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        for b in batches:
            for r in b.to_pylist():
                k = (r["fan"], r["slice"])
                o, t = from_bytes(r["once"], size), from_bytes(r["twice"], size)
                if k == key:
                    twice = twice | t | (once & o)
                    once = once | o
                    continue
                if key is not None:
                    yield out(key, once, twice)
                key, once, twice = k, o, t
        if key is not None:
            yield out(key, once, twice)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, _PART)


def _joint(column: DataFrame, hashes_of, which: str, bits: int) -> bytes:
    """The joint filter `which` (once or twice) of a table's only column, compressed."""
    if bits < 8 or bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    size = min(SLICE, bits)
    parts = _joined(column.mapInArrow(_filled(bits, hashes_of), _PART), ["fan", "slice"], size).withColumn("fan", F.lit(0))
    whole = np.zeros(bits // 8, np.uint8)
    for r in _joined(parts, ["slice"], size).select("slice", which).toLocalIterator():  # bits / 8 bytes in all
        whole[r["slice"] * (size // 8) : (r["slice"] + 1) * (size // 8)] = from_bytes(bytes(r[which]), size)
    return zstandard.compress(whole.tobytes(), 1)


def repeat_filter(docs: DataFrame, text: str = "text", bits: int = BITS, min_chars: int = MIN_CHARS) -> bytes:
    """The joint second filter of a table's keys: every key of two rows is in it."""
    return _joint(docs.select(F.col(f"`{text}`").alias("text")), _line_hashes(min_chars), "twice", bits)


_OPENED: dict[str, np.ndarray] = {}


class Known:
    """A broadcast second filter, which a worker opens once."""

    def __init__(self, spark: SparkSession, data: bytes) -> None:
        self.name, self.shared = uuid.uuid4().hex, spark.sparkContext.broadcast(data)

    def bitmap(self) -> np.ndarray:
        if self.name not in _OPENED:
            _OPENED.clear()
            _OPENED[self.name] = np.frombuffer(zstandard.decompress(self.shared.value), np.uint8)
        return _OPENED[self.name]


def _suspected(texts: list[str | None], bitmap: np.ndarray, min_chars: int) -> list[list[bytes]]:
    """Of each text the keys that the filter knows."""
    keys = [keys_of(t, min_chars) for t in texts]
    flat = [k for ks in keys for k in ks]
    if not flat:
        return keys
    hit = iter(within(bitmap, places(np.array([xxhash.xxh64_intdigest(k) for k in flat], np.uint64), len(bitmap) * 8)).tolist())
    return [[k for k in ks if next(hit)] for ks in keys]


def suspects(docs: DataFrame, known: Known, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(digest, id), each once: suspected keys of documents with an id."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.bitmap()
        for b in batches:
            found = _suspected(b.column(1).to_pylist(), bitmap, min_chars)
            at = np.repeat(np.arange(len(found)), [len(ks) for ks in found])
            digests = [hashlib.sha256(k).digest() for ks in found for k in ks]
            yield pa.record_batch([pa.array(digests, pa.binary()), b.column(0).take(pa.array(at, pa.int64()))], names=["digest", "id"])

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id is not null")
    return d.mapInArrow(find, f"digest binary, id {dict(d.dtypes)['id']}").distinct()


def repeated(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(digest, n, keep): keys of at least `least_docs` ids, how many, and the largest."""
    return found.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= least_docs)


def drops(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, digests): the keys that each document loses."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    # shares of 1 / HOT and more: at most HOT keys
    hot = F.broadcast(keys.filter(F.col("n") * HOT >= total).select("digest", "keep"))
    cold = keys.filter(F.col("n") * HOT < total).select("digest", "keep")
    pairs = found.join(hot, "digest").unionByName(found.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return pairs.filter("id != keep").groupBy("id").agg(F.collect_list("digest").alias("digests"))


def _within(known: Known):
    """A test of 64-bit hashes against a filter."""

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(within(known.bitmap(), places(hashes.to_numpy(np.int64).view(np.uint64), len(known.bitmap()) * 8)))

    return test


def _cut(min_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for text, digests in zip(b.column("text"), b.column("digests")):
                lines, out = (text.as_py() or "").split("\n"), set(digests.as_py() or ())
                kept = lines
                if out:
                    keys = (key_of(line, min_chars) for line in lines)
                    kept = [line for line, k in zip(lines, keys) if k is None or hashlib.sha256(k).digest() not in out]
                texts.append("\n".join(kept))
                gone.append(len(lines) - len(kept))
            yield pa.record_batch([b.column("row"), pa.array([t.as_py().count("\n") + 1 if t.is_valid else 1 for t in b.column("text")], pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["row", *MADE])

    return cut


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, bits: int = BITS, min_chars: int = MIN_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The columns `keep` of docs (None: all), ld_n_lines, ld_n_dropped, and ld_text without the lines
    that at least `least_docs` documents share, but for those of the largest id."""
    spark = docs.sparkSession
    known = Known(spark, repeat_filter(docs, text, bits, min_chars))
    found = stored(suspects(docs, known, id_col, text, min_chars), "line-suspects")
    lose = stored(drops(found, stored(repeated(found, least_docs), "line-keys")), "line-drops")
    losers = Known(spark, _joint(lose.select(F.xxhash64("id").alias("h")), _as_hashes, "once", bits))
    d = packed(docs, keep, MADE, id=F.col(f"`{id_col}`"), text=F.col(f"`{text}`"))
    d = d.withColumn("may_lose", F.col("id").isNotNull() & _within(losers)(F.xxhash64("id")))
    plain = F.coalesce("text", F.lit(""))
    clean = d.filter("not may_lose").select("row", (F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("ld_n_lines"), F.lit(0).cast("long").alias("ld_n_dropped"), plain.alias("ld_text"))
    rest = d.filter("may_lose").join(lose.hint("merge"), "id", "left").select("row", "text", "digests")
    return unpacked(clean.unionByName(rest.mapInArrow(_cut(min_chars), clean.schema)), *MADE)


def oracle(least_docs: int = LEAST_DOCS, min_chars: int = MIN_CHARS) -> str:
    """DuckDB SQL for the query's rows."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
k AS (SELECT *, translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {least_docs}),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> keep AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
