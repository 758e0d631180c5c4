"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprint: 64 majority bits over XXH64 (seed 42) of the text's 3-word shingles, repeats
included. Covering LSH for radius r: every bit position gets one of the 2^(r+1)-1 nonzero
vectors of r+1 bits, and table v keeps the positions whose vector has an odd product with v.
Two fingerprints that differ in at most r places agree on the kept bits of some table, as r
vectors cannot span all r+1 dimensions: no pair within the radius is missed.

Copies collapse first: only distinct fingerprints enter the tables. Those that share a bucket
with another are verified without listing pairs: each emits itself and its one-bit variants
within the bits its bucket leaves free. Two fingerprints have a variant in common exactly if
they differ in at most two bits, and a variant has at most 65 owners, so every group is small
whatever the bucket's size. Owners of a variant are tied to the smallest of them.

Components come from alternating large-star and small-star rounds over the edges between
distinct fingerprints, each written to the shared folder.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are
linked like any other. A text under three words is one shingle. Repeated rows keep their rows.
An empty table gives an empty result. Columns made here start with `sh_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, stored, unpacked

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
HOT_KEYS = 10_000
HOT_ROWS = 500


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    else:
        line = b" ".join(parts)
        starts = np.cumsum([0, *map(len, parts)]) + np.arange(len(parts) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts[: -words].tolist(), starts[words:].tolist())]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits set in over half of the hashes as a signed 64-bit integer; zero where there are none."""
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text by default) and `sh_fp` (long)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    src = packed(docs, keep, ["sh_fp"], text=F.col(f"`{text_col}`"))
    schema = T.StructType([src.schema["row"], T.StructField("sh_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["row", "sh_fp"])

    return unpacked(src.mapInArrow(run, schema), "sh_fp")


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The kept bits of each of the 2^(radius+1)-1 tables, as signed integers."""
    n = 2 ** (radius + 1) - 1
    vectors = [1 + i % n for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _flips(fp: Column, mask: Column) -> Column:
    """fp and its one-bit variants outside the mask."""
    one = F.lit(1).cast("long")
    free = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(mask, i) == 0)
    return F.concat(F.array(fp), F.transform(free, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", one, i))))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (`sh_fp`) -> edges (`a` < `b`) whose components are those of the
    graph of all pairs that differ in at most RADIUS bits. Only for a radius of two."""
    masks = covering_masks()
    tables = F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")
    rows = fps.select("sh_fp", tables).withColumn("kept", F.col("sh_fp").bitwiseAND(F.col("mask")))
    full = rows.groupBy("mask", "kept").agg(F.count("*").alias("n"), F.min("sh_fp").alias("lo"), F.max("sh_fp").alias("hi")).filter("n > 1")
    # a bucket of two is one pair; larger ones go through the variants
    two = full.filter(f"n = 2 and bit_count(lo ^ hi) <= {RADIUS}").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = rows.join(full.filter("n > 2").select("mask", "kept"), ["mask", "kept"])
    variants = more.select("sh_fp", F.explode(_flips(F.col("sh_fp"), F.col("mask"))).alias("variant")).distinct()
    lowest = variants.groupBy("variant").agg(F.min("sh_fp").alias("a"), F.max("sh_fp").alias("top"), F.collect_set("sh_fp").alias("owners")).filter("a < top")
    stars = lowest.select("a", F.explode("owners").alias("b")).filter("a < b")
    return two.union(stars).distinct()


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges (`a`, `b`) -> (`node`, `root`): the smallest node reachable, for every node that
    has an edge. Rounds go on until none changes the edges; each halves the longest way to a
    root or better, so that their number grows with its logarithm.

    The leaves of a large star all have one neighbour; they meet its smallest by `attach`, in
    which nodes of many edges are never one task."""
    edges = stored(edges.select("a", "b").filter("a != b"), "star-edges")
    mark, rounds = _mark(edges), 0
    while mark[0]:
        total = 2 * mark[0]  # at least the rows of each join below
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.count("*").alias("k"), F.min("b").alias("m")).select("a", "k", F.least("a", "m").alias("m"))
        large = attach(both, stored(low, "star-lows"), "a", "m", total).filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = stored(large, "large-stars")
        # small star: each node's smaller neighbours move to the smallest of them
        low = large.groupBy("b").agg(F.count("*").alias("k"), F.min("a").alias("m"))
        small = attach(large, stored(low, "star-lows"), "b", "m", total).select("m", F.explode(F.array("a", "b")).alias("x")).filter("m < x").distinct()
        edges = stored(small.select(F.col("m").alias("a"), F.col("x").alias("b")), "star-edges")
        was, mark = mark, _mark(edges)
        if mark == was:
            break
        rounds += 1
        if max_rounds is not None and rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def _mark(edges: DataFrame) -> tuple:
    """How many edges there are, and what tells a changed set of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first())


def attach(rows: DataFrame, target: DataFrame, key: str, value: str, total: int | None = None) -> DataFrame:
    """rows with `value` of target (key, k, value; k rows have that key), by key.

    Keys of many rows would each be one task of the join. They are those of at least a
    HOT_KEYS-th of all rows (`total`, or a number above it, where it is known), so at most HOT_KEYS,
    and go to their rows by broadcast; only the others are shuffled. Where there are none the join is plain."""
    if total is None:
        total = target.agg(F.sum("k")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = target.filter(F.col("k") >= least).select(key, F.col(value).alias("hot_value"))
    if hot.isEmpty():
        return rows.join(target.select(key, value), key).select(*rows.columns, value)
    d = rows.join(F.broadcast(hot), key, "left")
    done = d.filter("hot_value is not null").select(*rows.columns, F.col("hot_value").alias(value))
    rest = d.filter("hot_value is null").drop("hot_value").join(target.filter(F.col("k") < least).select(key, value), key)
    return done.unionByName(rest.select(*rows.columns, value))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: `id_col`, `sh_fp`, `sh_component` (the smallest id reachable)."""
    fp = stored(fingerprints(docs, text_col, [id_col]), "fingerprints")
    ids = fp.groupBy("sh_fp").agg(F.min(id_col).alias("sh_min"), F.count("*").alias("k"))
    ids = stored(ids, "fingerprint-ids")
    comp = components(links(ids.select("sh_fp")))
    linked = stored(ids.join(comp, ids.sh_fp == comp.node).select("sh_fp", "root", "sh_min"), "linked-fingerprints")
    roots = linked.groupBy("root").agg(F.count("*").alias("k"), F.min("sh_min").alias("sh_component"))
    moved = attach(linked, stored(roots, "component-roots"), "root", "sh_component").select("sh_fp", F.col("sh_component").alias("sh_moved"))
    target = ids.join(moved, "sh_fp", "left").select("sh_fp", "k", F.coalesce("sh_moved", "sh_min").alias("sh_component"))
    return attach(fp, stored(target, "fingerprint-components"), "sh_fp", "sh_component").select(id_col, "sh_fp", "sh_component")


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The row with the smallest id of each component, with the columns of docs.

    Rows that repeat an id stay or go together: they stay if any is the first of its component.
    Rows with a null id stay."""
    ids = near_duplicates(docs, text_col, id_col).groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("sh_component")).alias("first"))
    gone = ids.filter(~F.col("first")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
