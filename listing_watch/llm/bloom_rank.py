"""Ranked lexical search over bit-sliced Bloom signatures.

Index (`build`), made of any documents without knowing the questions:

* blocks of documents of like size. A document's signature is a Bloom filter of its distinct terms;
  a term that occurs more often is entered once more for each LEVEL that its count reaches. The
  signatures of a block are stored by bit, one bitmap over the block's documents for each bit, and
  beside them are the documents' keys and lengths.
* a dictionary (term, df), and the totals N and L.

Search, for a bounded block of items at a time: the bitmaps of a term's HASHES bits, ANDed, name every
document that may have the term, and those of its levels bound its count from above. The bound's
weight goes into the documents' sums, so a document's sum is never below its score. The best sums of
all blocks are scored exactly first; the 50th of those scores is a floor under every item's 50th
document. All documents whose sum reaches the floor are read and scored exactly. A document is left
out only if its sum proves that it can't be among the best.

Scores are whole numbers: w = floor(1000 ln((2N+2)/(2df+1))), m = 50 + (50 n N) div L, and the sum of
w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms.

Memory: a task holds one index block (BLOCK_BITS, more only for a single document's eight rows), the
partial dictionary of at most WORDS words, and a block of about ITEMS items, which also passes through the
driver with the df of its terms; documents never do. Texts that are scored exactly meet their
candidates in a join by id and text hash, which Spark broadcasts only if it has measured the
candidates as small.

Defined results: a null or empty text, or one without terms, is in no result and not in N. Items
without terms, or with a null text, give no rows; a null item id is an item. Rows that repeat an
id are documents of their own; those of equal score are ordered by id, null ids last, and then by
text. An empty table gives an empty result. Columns made here start with `br_`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
LEVELS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024, 1 << 62)
HASHES = 4
BITS_A_KEY = 16
BLOCK_BITS = 1 << 23
BLOCK_DOCS = 1024
WORDS = 300_000
ITEMS = 256
TOP = 50


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, in order and with repeats."""
    return TERM.findall((text or "").translate(UPPER)) if text else []


def hash_of(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode())


def places(hashes: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """HASHES places of each (term hash, level) in a signature of `bits` bits, a power of two."""
    h = (hashes + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def entries(counts: Counter, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, level) entered for a document's terms: level 0 for each, and one for each of LEVELS that
    its count reaches."""
    hashes = np.fromiter((known[t] for t in counts), np.uint64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    n = np.searchsorted(LEVELS, tf, side="right")
    at = np.repeat(np.arange(len(tf)), n + 1)
    level = np.arange(len(at)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    return hashes[at], level.astype(np.uint64)


class Block:
    """Signatures of documents of one size class, being filled."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // bits // 8 * 8))
        self.rows: list[tuple] = []
        self.at: list[np.ndarray] = []

    def add(self, row: tuple, hashes: np.ndarray, levels: np.ndarray) -> None:
        self.rows.append(row)
        self.at.append(places(hashes, levels, self.bits).ravel())

    def slices(self) -> bytes:
        """Bitmap after bitmap: for each bit of the signatures one bit for each document."""
        width = -(-len(self.rows) // 8)
        out = np.zeros(self.bits * width, np.uint8)
        doc = np.repeat(np.arange(len(self.rows), dtype=np.uint64), [len(a) for a in self.at])
        np.bitwise_or.at(out, np.concatenate(self.at) * np.uint64(width) + (doc >> np.uint64(3)), np.uint8(1) << (doc & np.uint64(7)).astype(np.uint8))
        return out.tobytes()


def presence(slices: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, document) places of the documents that may have each term, by term: the bits set in all
    the bitmaps of a term."""
    at = places(hashes, 0, len(slices))
    found = slices[at[:, 0]]
    for i in range(1, HASHES):
        found &= slices[at[:, i]]
    term, byte = np.nonzero(found)
    at, bit = np.nonzero(np.unpackbits(found[term, byte][:, None], axis=1, bitorder="little"))
    return term[at], byte[at] * 8 + bit


def most_often(slices: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, bound): for each term and document that may have it an upper bound of its count."""
    term, doc = presence(slices, hashes)
    bound = np.full(len(term), LEVELS[0] - 1, np.int64)
    live = np.arange(len(term))
    for level in range(1, len(LEVELS)):
        # a level's entry counts only upon all below it
        rows = slices[places(hashes, level, len(slices))[term[live]], (doc[live] >> 3)[:, None]]
        live = live[((rows >> (doc[live] & 7).astype(np.uint8)[:, None]) & 1).all(axis=1)]
        if not len(live):
            break
        bound[live] = LEVELS[level] - 1
    return term, doc, bound


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), which grows with tf; a bound without end counts as 10^6."""
    t = np.minimum(tf, 10**9)
    return np.where(tf > 10**9, 10**6, (10**9 * t) // (1000 * t + 20 * m))


def smoothing(lengths: list[int], total_docs: int, total_terms: int) -> np.ndarray:
    """m of documents of these lengths; whole numbers of Python, which don't overflow on the way."""
    return np.array([100 - 50 + (50 * n * total_docs) // total_terms for n in lengths], np.int64)


INDEX = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("bits", T.LongType()),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("slices", T.BinaryType()),
    ]
)


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """The index: `blocks` (ids, hashes, lengths, bits, slices), `words` (term, df), `totals` (n, l)."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([*INDEX.fields, T.StructField("ids", T.ArrayType(id_type))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        words: Counter = Counter()
        known: dict[str, int] = {}
        open_blocks: dict[int, Block] = {}

        def written(b: Block) -> pa.RecordBatch:
            ids, hashes, lengths = zip(*b.rows)
            cols = [[None], [None], [b.bits], [list(hashes)], [list(lengths)], [b.slices()], [list(ids)]]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.name for f in schema.fields])

        def counted(w: Counter) -> pa.RecordBatch:
            empty = [pa.nulls(len(w), k) for k in kinds[2:]]
            return pa.record_batch([pa.array(list(w), kinds[0]), pa.array(list(w.values()), kinds[1]), *empty], names=[f.name for f in schema.fields])

        for whole in batches:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(whole.schema.field(0).type)]
            for b in groups(iter([whole]), 1):
                for i, x, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    found = terms_of(x.as_py())
                    if not found:
                        continue
                    counts = Counter(found)
                    for t in counts:
                        if t not in known:
                            known[t] = hash_of(t)
                    words.update(counts.keys())
                    hashes, levels = entries(counts, known)
                    bits = 1 << max(6, (BITS_A_KEY * len(hashes) - 1).bit_length())
                    block = open_blocks.setdefault(bits, Block(bits))
                    block.add((i, h, len(found)), hashes, levels)
                    if len(block.rows) == block.room:
                        yield written(open_blocks.pop(bits))
                    if len(words) > WORDS:
                        yield counted(words)
                        words, known = Counter(), {}
        for block in open_blocks.values():
            yield written(block)
        if words:
            yield counted(words)

    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    made = stored(d.select("id", "text", F.xxhash64("text").alias("h")).mapInArrow(index, schema), "signatures")
    words = stored(made.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "words")
    blocks = made.filter("bits is not null").select("ids", "hashes", "lengths", "bits", "slices")
    count = F.sum(F.size("lengths")).cast("long")
    totals = blocks.agg(F.coalesce(count, F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).cast("long").alias("l"))
    return {"blocks": blocks, "words": words, "totals": totals}


class Asked:
    """A block of items: for each its terms' numbers, and the terms with hashes and weights."""

    def __init__(self, items: list[list[str]], weight: dict[str, int], n: int, length: int) -> None:
        self.terms = sorted({t for x in items for t in x if weight.get(t, 0) > 0})
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = [np.array([number[t] for t in x if t in number], np.int64) for x in items]
        self.hashes = np.array([hash_of(t) for t in self.terms], np.uint64)
        self.weights = np.array([weight[t] for t in self.terms], np.int64)
        self.n, self.length = n, length
        self.number = number

    def bounds(self, bits: int, lengths: list[int], slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(item, sums of a block's documents), items that share none of a block's terms left out."""
        rows = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        term, doc, tf = most_often(rows, self.hashes)
        worth = gain(tf, smoothing(lengths, self.n, self.length)[doc]) * self.weights[term]
        first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        for i, at in enumerate(self.items):
            spans = [(first[t], first[t + 1]) for t in at.tolist() if first[t] < first[t + 1]]
            if spans:
                docs = np.concatenate([doc[a:b] for a, b in spans])
                sums = np.concatenate([worth[a:b] for a, b in spans])
                # sums stay below 2^53, where doubles are exact
                yield i, np.bincount(docs, sums, len(lengths)).astype(np.int64)

    def scores(self, text: str, wanted: list[int]) -> list[int]:
        """The exact scores of a text for some of the items."""
        found = terms_of(text)
        m = smoothing([len(found)], self.n, self.length)
        tf = np.zeros(len(self.terms), np.int64)
        for t, k in Counter(found).items():
            if t in self.number:
                tf[self.number[t]] = k
        worth = gain(tf, m) * self.weights
        return [int(worth[self.items[i]].sum()) for i in wanted]


def _best_sums(blocks: DataFrame, asked: Asked, top: int, floors: list[int] | None) -> DataFrame:
    """(item, id, h, bound): of each block the documents of the `top` highest sums of an item, or, with
    floors, all whose sum reaches the item's floor."""
    id_type = blocks.schema["ids"].dataType.elementType

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                lengths = b.column(2)[r].as_py()
                ids, hashes = b.column(0)[r].values, b.column(1)[r].values
                for i, sums in asked.bounds(b.column(3)[r].as_py(), lengths, b.column(4)[r].as_py()):
                    if floors is not None:
                        at = np.flatnonzero(sums >= floors[i])
                    else:
                        at = np.flatnonzero(sums > 0)
                        if len(at) > top:
                            at = at[np.argpartition(-sums[at], top - 1)[:top]]
                    if len(at):
                        take = pa.array(at)
                        yield pa.record_batch([pa.array(np.full(len(at), i, np.int32)), ids.take(take), hashes.take(take), pa.array(sums[at])], names=["item", "id", "h", "bound"])

    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type), T.StructField("h", T.LongType()), T.StructField("bound", T.LongType())])
    return blocks.mapInArrow(find, out)


def _scored(docs: DataFrame, pairs: DataFrame, asked: Asked) -> DataFrame:
    """(item, id, h, score): exact scores of the pairs (item, id, h), by every row of that id and text."""
    wanted = pairs.groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("wanted")).withColumnsRenamed({"id": "_i", "h": "_h"})
    d = docs.join(wanted, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))).select("id", "h", "text", "wanted")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, sums, at = [], [], []
            for r in range(b.num_rows):
                w = b.column(3)[r].as_py()
                items += w
                sums += asked.scores(b.column(2)[r].as_py(), w)
                at += [r] * len(w)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(items, pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(sums, pa.int64())], names=["item", "id", "h", "score"])

    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", docs.schema["id"].dataType), T.StructField("h", T.LongType()), T.StructField("score", T.LongType())])
    return d.mapInArrow(score, out)


def rank(docs: DataFrame, items: DataFrame, index: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(br_item, br_rank, br_id, br_score): the `top` documents of each item with a score above 0."""
    spark = docs.sparkSession
    index = build(docs, id_col, text) if index is None else index
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null").withColumn("h", F.xxhash64("text"))
    totals = index["totals"].first()
    asking = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).filter("text is not null")
    asking = stored(asking.withColumn("k", F.monotonically_increasing_id()), "items")
    n_blocks = -(-asking.count() // ITEMS) if totals["n"] else 0
    out = None
    for block in range(n_blocks):
        rows = asking.filter(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == block).select("item", "text").collect()
        found = _ranked(d, index, rows, totals["n"], totals["l"], top, items.schema[item_col].dataType)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = T.StructType([T.StructField("br_item", items.schema[item_col].dataType), T.StructField("br_rank", T.IntegerType()), T.StructField("br_id", docs.schema[id_col].dataType), T.StructField("br_score", T.LongType())])
        return spark.createDataFrame([], kind)
    return out


def _ranked(d: DataFrame, index: dict[str, DataFrame], rows: list, n: int, length: int, top: int, item_type: T.DataType) -> DataFrame:
    """The ranking of one block of items."""
    spark = d.sparkSession
    items = [sorted(set(terms_of(r["text"]))) for r in rows]
    vocabulary = sorted({t for x in items for t in x})
    asked_words = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string())})))
    df = {r["term"]: r["df"] for r in index["words"].join(asked_words, "term").collect()}  # terms of this block of items
    asked = Asked(items, {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}, n, length)
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "id", "h")
    seeds = _best_sums(index["blocks"], asked, top, None).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= top)
    scored = _scored(d, seeds, asked)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "h")
    fiftieth = scored.withColumn("k", F.row_number().over(place)).filter(F.col("k") == top).select("item", "score").collect()  # one for each item
    floors = [1] * len(items)
    for r in fiftieth:
        floors[r["item"]] = max(1, r["score"])
    exact = _scored(d, _best_sums(index["blocks"], asked, top, floors), asked).filter("score > 0")
    exact = exact.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("br_item", item_type)]))
    return stored(exact.join(F.broadcast(names), "item").select("br_item", F.col("rank").cast("int").alias("br_rank"), F.col("id").alias("br_id"), F.col("score").alias("br_score")), "ranked")


def oracle(top: int = TOP) -> str:
    """DuckDB SQL for the query's rows."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words} AS ts FROM documents),
sized AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN sized USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= {top}"""
