"""Many terms in many texts that share a key: both are dealt into groups of bounded size.

The texts of a key come in blocks of about BLOCK bytes, by id, so that rows that repeat an id are in
one; its terms go to each of its blocks, as a rule one. A task holds one block and its terms, builds
an automaton of these and reads each text once, so what is shuffled is texts and terms, not their
2-grams or pairs. Keys of more than TERMS terms are given back, for a way that holds no key's terms
in one place."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .automaton import Finder

BLOCK = 4_000_000
TERMS = 100_000


def by_size(terms: DataFrame, keys: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The terms of keys with at most `most` (TERMS) of them, and those of the others, None where there are none."""
    n = stored(terms.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > (TERMS if most is None else most)).select(*keys), "large-keys")
    if n.isEmpty():
        return terms, None
    return terms.join(n, keys, "left_anti"), terms.join(n, keys, "left_semi")


def in_blocks(texts: DataFrame, size: Column, terms: DataFrame, keys: list[str], part: Column, work: Callable[[Finder, pa.Table], dict[str, list]], schema: str, guard: bool = True) -> DataFrame:
    """(keys, schema): what `work` makes of each block. It gets a finder of the terms of the block's key
    and the block's texts, and gives columns of `schema`. part: what keeps rows of texts together."""
    sizes = texts.groupBy(*keys).agg((F.floor(F.sum(size) / BLOCK) + 1).cast("int").alias("_of")).filter("_of > 1")
    sizes = stored(sizes, "block-sizes")
    block = lambda d, of: d.join(sizes, keys, "left").withColumn("_block", of).drop("_of")
    left = block(texts, F.coalesce(F.pmod(F.xxhash64(part), F.col("_of")), F.lit(0).cast("long")))
    right = block(terms.select(*keys, "term_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_of"), F.lit(1)).cast("long") - 1)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    empty = [f.split()[0] for f in schema.split(", ")]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found = dict.fromkeys(empty, [])
        if a.num_rows and b.num_rows:
            found = work(Finder([(t,) for t in b.column("term_t").to_pylist()], guard), a)
        n = len(found[empty[0]])
        return pa.table({**{k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key)}, **{k: pa.array(v, types[k]) for k, v in found.items()}})

    names = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = {f.split()[0]: names[f.split()[1]] for f in schema.split(", ")}
    # both may come of one table, whose columns would be ambiguous: the terms' go by other names
    right = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of_block"), "term_t")
    return left.groupBy(*keys, "_block").cogroup(right.groupBy(*[f"_of_{k}" for k in keys], "_of_block")).applyInArrow(run, f"{kinds}, {schema}")
