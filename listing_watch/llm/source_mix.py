"""Mixing sources to target weights, by blocks.

Each source's words form a stream that is packed into blocks of BLOCK words. A source has a whole
number of slots, its mean rounded so that all sum to the total. Output shards of SHARD_SLOTS slots
draw multinomial source counts, under the condition that each source's counts sum to its number
over all shards (a multivariate hypergeometric law), so that none is above its limit and none is
dropped. Any shard's counts are drawn alone: the range of shards is halved again and again, and
what the lower half gets is drawn with the range as seed. Ranges of WIDE slots and more, where
numpy has no such draw, give each half the whole part of its mean and draw the rest. A source's
slots are numbered over the shards, and slot k reads block perm(k mod blocks), where perm is the
pseudorandom permutation of the source's block numbers for pass k div blocks (a Feistel network
walked until it lands inside). Slots and blocks meet in a join on (source, block), so a source
that holds a third of all rows is spread over its block numbers.

Targets: sources in code point order, null last, weigh WEIGHTS in turn and share `SHARE` times
all words; a source's target stops at LIMIT times its words, and what is cut off goes to the
others by weight until none is above. No block is read more than LIMIT times.

The running sum of where a document begins in its stream is taken in two levels, within buckets
and over the buckets of a source, of which there are as many as the square root of the rows: no
task sees a whole source. The driver holds one row for each source.

Defined results: a null or empty text has no words, and takes none. A source without words has
target 0. Rows that repeat an id are documents of their own. An empty table gives an empty
result. Columns made here start with `mx_`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, stored, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
BLOCK = 64
SHARD_SLOTS = 4096
WIDE = 10**9
SEED = 20_011
WORD = re.compile(r"[^ \t-\r]+[ \t-\r]*")


def targets(words: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Source -> target, from source -> words."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = share * sum(words.values()), set(order)
    out: dict[str | None, float] = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in order if s in open_ and weight[s] * level > limit * words[s]]
        if not above:
            out.update({s: weight[s] * level for s in open_})
            break
        for s in above:
            out[s] = float(limit * words[s])
            left -= out[s]
            open_.discard(s)
    return out


def totals(means: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole numbers that sum to the rounded sum of the means, each its mean rounded down or up, and
    none above `most`."""
    means = np.minimum(means, most)
    out = np.floor(means).astype(np.int64)
    up = np.argsort(out - means, kind="stable")[: int(round(means.sum())) - int(out.sum())]
    out[up] += 1
    return np.minimum(out, most)


def split(have: np.ndarray, n: int, seed: list[int]) -> np.ndarray:
    """How much of each count goes to n of all, drawn without replacement. From WIDE on it is the
    whole part of each mean, and one more for as many as are missing, each with the chance of its
    fraction. Exact, in whole numbers."""
    total = int(have.sum())
    if total < WIDE:
        return np.random.default_rng(seed).multivariate_hypergeometric(have, n, method="marginals")
    share = have.astype(object) * n
    base, rest = share // total, share % total
    ends = np.cumsum(rest) + int(np.random.default_rng(seed).integers(total))
    return (base + ends // total - (ends - rest) // total).astype(np.int64)


def deal(have: np.ndarray, shard: int, shards: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each source's slots in the shards before, in this shard)."""
    lo, hi, before = 0, shards, np.zeros_like(have)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(have, (mid - lo) * slots, [SEED, lo, hi])
        if shard < mid:
            have, hi = left, mid
        else:
            have, before, lo = have - left, before + left, mid
    return before, have


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each k in [0, n) goes under the pseudorandom permutation of [0, n) named by key."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << half) - 1
    out, todo = k.astype(np.int64).copy(), np.arange(len(k))
    while len(todo):
        h, m, q = half[todo], mask[todo], key[todo].astype(np.uint64)
        a, b = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = (b.astype(np.uint64) + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ q
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((x >> np.uint64(32)).astype(np.int64) & m)
        out[todo] = a << h | b
        todo = todo[out[todo] >= n[todo]]
    return out


def running(df: DataFrame, key: str, bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of its key that come before, by bucket and
    then `order`. The window over a key has a row for each bucket only."""
    d = df.withColumn("mx_bucket", bucket)
    w = Window.partitionBy(key, "mx_bucket").orderBy(*order)
    d = d.withColumn("mx_within", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    heads = d.groupBy(key, "mx_bucket").agg(F.sum(value).alias("mx_sum"))
    over = Window.partitionBy(key).orderBy("mx_bucket")
    heads = heads.withColumn("mx_before", F.sum("mx_sum").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mx_sum")).drop("mx_sum")
    heads = heads.withColumnsRenamed({key: "mx_head_key", "mx_bucket": "mx_head_bucket"})
    d = d.join(heads, (F.col(key) == F.col("mx_head_key")) & (F.col("mx_bucket") == F.col("mx_head_bucket")))
    return d.withColumn(out, F.col("mx_within") + F.col("mx_before")).drop("mx_within", "mx_before", "mx_bucket", "mx_head_key", "mx_head_bucket")


def _slots(spark: SparkSession, plan: list[tuple[str | None, int, int, float]], block: int, shard_slots: int, limit: int) -> DataFrame:
    """(mx_shard, mx_slot, mx_of, mx_block, mx_pass): plan has (source, words, blocks, target)."""
    blocks = np.array([b for _, _, b, _ in plan], np.int64)
    mean = np.array([t * b / n if n else 0.0 for _, n, b, t in plan])
    sums = totals(mean, limit * blocks)
    total = int(sums.sum())
    shards = max(1, -(-total // shard_slots))
    keys = np.array([zlib.crc32(b"\x00" if s is None else b"\x01" + s.encode("utf-8", "replace")) for s, *_ in plan], np.int64)

    names = ["mx_shard", "mx_slot", "mx_of", "mx_block", "mx_pass"]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                start, got = deal(sums, shard, shards, shard_slots)
                of = np.repeat(np.arange(len(got)), got)
                slot = np.arange(len(of))
                k = start[of] + slot - (np.cumsum(got) - got)[of]
                turn = k // blocks[of]
                at = permute(k % blocks[of], blocks[of], keys[of] + (turn << 33))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), shard)), pa.array(slot), pa.array(of.astype(np.int32)), pa.array(at), pa.array(turn.astype(np.int32))], names=names)

    return spark.range(shards if total else 0).mapInArrow(draw, "mx_shard long, mx_slot long, mx_of int, mx_block long, mx_pass int")


def mix(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, share: float = SHARE, limit: int = LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks).

    documents: mx_id, mx_source, mx_row (a hash of the text), mx_size, mx_of, mx_start,
    mx_source_size, mx_target, a row for each row of docs. blocks: what each slot of each output
    shard holds, a row for each document in the slot's block: mx_shard, mx_slot, mx_pass, mx_of,
    mx_start, mx_id, mx_row, mx_from (word of the document), mx_n (words)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("mx_id"), F.col(source_col).alias("mx_source"), F.xxhash64(text).alias("mx_row"), size.alias("mx_size")), "mix-sizes")
    got = {r["mx_source"]: (r["n"], r["docs"]) for r in rows.groupBy("mx_source").agg(F.sum("mx_size").alias("n"), F.count("*").alias("docs")).collect()}
    want = targets({s: n for s, (n, _) in got.items()}, share=share, limit=limit)
    plan = [(s, got[s][0], -(-got[s][0] // block), want[s]) for s in sorted(got, key=lambda s: (s is None, s or ""))]
    table = pa.table({"mx_name": pa.array([s for s, *_ in plan], pa.string()), "mx_of": pa.array(range(len(plan)), pa.int32()), "mx_source_size": pa.array([n for _, n, _, _ in plan], pa.int64()), "mx_target": pa.array([t for *_, t in plan], pa.float64())})
    named = F.broadcast(spark.createDataFrame(table, "mx_name string, mx_of int, mx_source_size long, mx_target double"))  # one row a source
    d = rows.join(named, F.col("mx_source").eqNullSafe(F.col("mx_name"))).drop("mx_name")
    buckets = math.isqrt(sum(k for _, k in got.values())) + 1
    d = running(d, "mx_of", F.pmod(F.xxhash64("mx_id", "mx_row", F.lit(1)), F.lit(buckets)), ["mx_id", "mx_row"], "mx_size", "mx_start")
    d = stored(d, "mix-documents")
    first, last = F.floor(F.col("mx_start") / block), F.floor((F.col("mx_start") + F.col("mx_size") - 1) / block)
    pieces = d.filter("mx_size > 0").select("mx_id", "mx_row", "mx_of", "mx_start", "mx_size", F.explode(F.sequence(first, last)).alias("mx_block"))
    begin = F.greatest(F.lit(0), F.col("mx_block") * block - F.col("mx_start"))
    end = F.least(F.col("mx_size"), (F.col("mx_block") + 1) * block - F.col("mx_start"))
    pieces = pieces.withColumn("mx_from", begin).withColumn("mx_n", end - begin).drop("mx_size")
    # Spark takes the slots to be as few as the shards, and would broadcast them
    return d, _slots(spark, plan, block, shard_slots, limit).hint("merge").join(pieces, ["mx_of", "mx_block"])


def taken(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """A row for each row of docs: mx_id, mx_size, mx_source_size, mx_target and mx_taken, the words
    the mix takes of it, repeats counted."""
    d, blocks = mix(docs, text_col, id_col, source_col, **options)
    sums = blocks.groupBy("mx_of", "mx_start").agg(F.sum("mx_n").alias("mx_taken")).withColumnsRenamed({"mx_of": "of", "mx_start": "start"})
    out = d.join(sums, (d.mx_of == sums.of) & (d.mx_start == sums.start) & (d.mx_size > 0), "left")
    return out.select("mx_id", "mx_size", "mx_source_size", "mx_target", F.coalesce("mx_taken", F.lit(0)).cast("long").alias("mx_taken"))


def mixed_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, with the columns of docs: each text holds the words that the mix
    takes of it, in order, one pass after another, with the white space after each word; a
    document of which nothing is taken is left out. n_chars follows the text where docs has it.

    Rows that repeat both id and text are told apart by number, and each holds its own words."""
    _, blocks = mix(docs, text_col, id_col, source_col, **options)
    # a null id is a name of its own
    name = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c.cast("string"), F.lit("")))
    parts = blocks.withColumn("name", name(F.col("mx_id"))).groupBy("name", "mx_row").agg(F.sort_array(F.collect_list(F.struct("mx_start", "mx_pass", "mx_from", "mx_n"))).alias("parts"))
    names = list(docs.columns)
    d = packed(docs, names, [], name=name(F.col(f"`{id_col}`")), mx_row=F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = Window.partitionBy("name", "mx_row").orderBy("name")
    d = d.withColumn("copy", F.row_number().over(same) - 1).join(parts, ["name", "mx_row"])
    d = unpacked(d, "copy", "parts")
    d = d.toDF(*[f"c{i}" for i in range(len(names))], "copy", "parts")
    at, chars_at = names.index(text_col), names.index("n_chars") if "n_chars" in names else None
    if chars_at is not None:
        d = d.withColumn(f"c{chars_at}", F.col(f"c{chars_at}").cast("long"))
    schema = T.StructType(d.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            for text, copy, parts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                starts = sorted({p["mx_start"] for p in parts})
                if copy >= len(starts):
                    texts.append(None)  # this copy is not in the mix
                    continue
                words = WORD.findall(text)
                out = ["".join(words[p["mx_from"] : p["mx_from"] + p["mx_n"]]) for p in parts if p["mx_start"] == starts[copy]]
                texts.append("".join(x if x[-1] in " \t\n\x0b\x0c\r" else x + " " for x in out).rstrip(" "))
            cols = [*b.columns[:-2]]
            cols[at] = pa.array(texts, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            got = pa.RecordBatch.from_arrays(cols, names=schema.names)
            yield got.filter(cols[at].is_valid())

    return d.mapInArrow(run, schema).toDF(*names)
