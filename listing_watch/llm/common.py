"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regex classes of the word definition `[^\x20\x09-\x0D]+`.
SPACES = r"[ \t-\r]+"
NON_SPACE = r"[^ \t-\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where it is unset, a local session takes a new temporary folder and sets it; on a cluster, whose
    machines would not see such a folder, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage at files that
    outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The path of a file: URI or plain path, as this machine's file system has it."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else uri


def word_array(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column, null as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def packed(docs: DataFrame, keep: list[str] | None, made: list[str], **cols: Column) -> DataFrame:
    """`row`, a struct of the columns `keep` of docs (None: all), and `cols`. Inner columns so never
    meet the caller's, whatever those are named. A column of docs named like one of `made`, in any
    case, gives way to it."""
    taken = {m.lower() for m in made}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    fields = [F.col(f"`{c}`") for c in names] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*fields).alias("row"), *[c.alias(n) for n, c in cols.items()])


def unpacked(df: DataFrame, *made: Column | str) -> DataFrame:
    """The columns that `packed` carried, and then `made`."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    return df.select(*[F.col("row").getField(n).alias(n) for n in names if names != ["none"]], *made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 2_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with bounded text; a single longer text comes alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (held + n > chars or i - start >= rows):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)
