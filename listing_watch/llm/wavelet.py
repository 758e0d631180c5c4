"""Token ids in succinct shards: one wavelet matrix per file.

A shard holds the ids of consecutive documents as `levels` bit-planes, highest bit first. At
each level the ids are split stably by that bit, zeros before ones; a plane with a running count
of its ones every 512 bits gives rank in constant time and select by binary search, and with
them token access, counting and the places of a token without unpacking the rest. Planes are
compressed with zstd; the file is

    magic, header length (little-endian 8 bytes), JSON header, doc ids, document ends, planes

and the header states the first id's place within its writer task, so that shards are read in
any order. Files are written whole under a temporary name and renamed, each under a name that
follows from its place alone: a task that runs again after a lost executor, or twice at once,
puts the same bytes at the same place.

Defined results: a null or empty text is a document with its end id only. Documents are in
ascending id order, null ids first; rows that repeat an id are all kept, by text. A document
longer than a shard gets a shard of its own. An empty table gives no shard and an empty result.
Columns made here start with `wm_`.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, local_path, new_path

MAGIC = b"WAVEMTX1"
BLOCK = 512
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 500_000


class Plane:
    """A bit sequence with rank and select."""

    def __init__(self, packed: bytes, n: int) -> None:
        self.n = n
        self.bytes = np.frombuffer(packed, np.uint8)
        pad = -len(self.bytes) % (BLOCK // 8)
        ones = np.bitwise_count(np.pad(self.bytes, (0, pad)).reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = n - int(self.before[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.bytes, count=self.n, bitorder="little").view(bool)

    def bit(self, i: int) -> int:
        return int(self.bytes[i >> 3] >> (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        b = i // BLOCK
        part = self.bytes[b * BLOCK // 8 : i >> 3]
        r = int(self.before[b]) + int(np.bitwise_count(part).sum())
        return r + int(self.bytes[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else r

    def rank(self, bit: int, i: int) -> int:
        r = self.rank1(i)
        return r if bit else i - r

    def select(self, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rank(bit, mid + 1) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo


class Shard:
    """One file's documents and wavelet matrix."""

    def __init__(self, blob: bytes) -> None:
        if blob[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<q", blob[8:16])
        self.header = h = json.loads(blob[16 : 16 + size])
        at, parts = 16 + size, []
        unpack = zstandard.ZstdDecompressor().decompress
        for k in h["parts"]:
            parts.append(unpack(blob[at : at + k]) if k else b"")
            at += k
        self.n, self.start, self.levels = h["n"], h["start"], h["levels"]
        ids = np.frombuffer(parts[0], "<i8")
        self.doc_ids = [None if m else int(x) for x, m in zip(ids, np.frombuffer(parts[1], np.uint8))]
        self.ends = np.frombuffer(parts[2], "<i8")
        self.planes = [Plane(p, self.n) for p in parts[3:]]

    @staticmethod
    def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, start: int, order: tuple[int, int], levels: int) -> bytes:
        z = zstandard.ZstdCompressor(level=1)
        parts = [
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.cumsum(lengths, dtype="<i8").tobytes(),
        ]
        kind = np.uint16 if levels <= 16 else np.uint32
        a, below = ids.astype(kind), np.empty(len(ids), kind)
        for level in range(levels):
            one = (a & kind(1 << (levels - 1 - level))).astype(bool)
            parts.append(np.packbits(one, bitorder="little").tobytes())
            n = np.count_nonzero(one)
            np.compress(one, a, out=below[len(a) - n :])
            np.compress(np.logical_not(one, out=one), a, out=below[: len(a) - n])
            a, below = below, a
        packed = [z.compress(p) if p else b"" for p in parts]
        head = json.dumps({"n": len(ids), "docs": len(doc_ids), "start": start, "order": order, "levels": levels, "parts": [len(p) for p in packed]}).encode()
        return MAGIC + struct.pack("<q", len(head)) + head + b"".join(packed)

    def tokens(self) -> np.ndarray:
        """All ids: the stable splits undone from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        a, up = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            p = self.planes[level]
            one = p.bits()
            # a holds the lower bits in the order after this level's split
            a[p.zeros :] |= kind(1 << (self.levels - 1 - level))
            up[one] = a[p.zeros :]
            up[np.logical_not(one, out=one)] = a[: p.zeros]
            a, up = up, a
        return a

    def access(self, i: int) -> int:
        v = 0
        for p in self.planes:
            b = p.bit(i)
            v = v << 1 | b
            i = p.zeros + p.rank1(i) if b else i - p.rank1(i)
        return v

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        """Where the occurrences of token among places i to j stand below the last plane."""
        if token < 0 or token >> self.levels:
            return 0, 0
        for level, p in enumerate(self.planes):
            b = token >> (self.levels - 1 - level) & 1
            i, j = p.rank(b, i) + p.zeros * b, p.rank(b, j) + p.zeros * b
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of token among places i to j."""
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of token's k-th occurrence (from 0)."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            b, p = token >> (self.levels - 1 - level) & 1, self.planes[level]
            i = p.select(b, i - p.zeros * b)
        return i


#: Beyond these, letter case and composed forms depend on more than the character itself.
OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]|<[|]")
#: A full stop or comma that ends a word of letters; the pre-split always cuts before it.
MARK = re.compile(r"[.,](?<=[a-zß-öø-ÿ][.,])(?![^ \n])")


def plain_words(text: str) -> str:
    """The text with fewer distinct words and the same ids: lower case, as the normaliser has it,
    and final marks set off. Texts with other than Latin letters, or special strings, stay."""
    if "<|" in text or not text.isascii() and OTHER.search(text):
        return text
    return MARK.sub(r" \g<0>", text.lower())


class Encoder:
    """Whole texts to ids with a tokenizers file whose words never span white space.

    Words between single ASCII spaces and line ends are encoded by the library once and
    remembered in two generations of bounded size, as flat arrays."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.t, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.t, self.bare):
            t.no_padding()
            t.no_truncation()
        # words of small Latin letters are normal already, and one piece
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = cache_words

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or not OTHER.search(w))]
        rest = list(set(words).difference(plain))
        for t, some in ((self.bare, plain), (self.t, rest)):
            for w, e in zip(some, t.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [plain_words(x).replace("\n", " ").split(" ") for x in texts]
        if len(self.cache) > self.limit:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        new = set().union(*cut) - cache.keys()
        todo = []
        for w in new:
            if (got := older.get(w)) is not None:
                cache[w] = got
            else:
                todo.append(w)
        self._learn(todo)
        return [b"".join(map(cache.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _put(folder: str, name: str, blob: bytes) -> None:
    """Writes folder/name whole: through the local file system for file: and plain paths, else
    through the store that pyarrow knows by the scheme."""
    at = local_path(folder)
    if "://" in at:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        part = f"{base}/_{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(blob)
        store.move(part, f"{base}/{name}")
        return
    os.makedirs(at, exist_ok=True)
    part = f"{at}/_{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(blob)
    os.replace(part, f"{at}/{name}")


def write_shards(
    docs: DataFrame, folder: str, vocab: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = 2, levels: int = 16, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encodes docs in ascending id order into shard files; (file, part, n) of what was written.

    Rows are dealt by ranges of ids, so each task writes consecutive documents and holds one
    shard at a time."""
    src = docs.select(F.col(id_col).cast("long").alias("wm_id"), F.coalesce(F.col(text_col), F.lit("")).alias("wm_text"))
    dealt = src.repartitionByRange("wm_id").sortWithinPartitions("wm_id", "wm_text")
    schema = "wm_file string, wm_part int, wm_n long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = encoder(vocab), TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        total, start, seq, out = 0, 0, 0, []

        def flush() -> None:
            nonlocal total, start, seq
            if not doc_ids:
                return
            ids = np.frombuffer(b"".join(held), "<u4")
            name = f"part-{part:06d}-{seq:06d}.wm"
            _put(folder, name, Shard.build(doc_ids, lengths, ids, start, (part, seq), levels))
            out.append((name, part, len(ids)))
            start, seq, total = start + len(ids), seq + 1, 0
            doc_ids.clear(), lengths.clear(), held.clear()

        for b in batches:
            for g in groups(iter([b]), 1):
                for i, ids in zip(g.column(0).to_pylist(), code.encode(g.column(1).to_pylist())):
                    if doc_ids and total + len(ids) // 4 + 1 > shard_tokens:
                        flush()
                    doc_ids.append(i)
                    held += [ids, end]
                    lengths.append(len(ids) // 4 + 1)
                    total += lengths[-1]
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (list(x) for x in zip(*out))], schema=pa.schema([("wm_file", pa.string()), ("wm_part", pa.int32()), ("wm_n", pa.int64())]))

    return dealt.mapInArrow(run, schema)


def read_shards(spark: SparkSession, folder: str, part_starts: dict[int, int]) -> DataFrame:
    """From the files: `wm_id`, `wm_start` (ids of all documents before it), `wm_n` and
    `wm_crc32` (of its ids as little-endian unsigned 32-bit integers).

    part_starts: ids before each writer task's first, one number per task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder).select("content")
    schema = "wm_id long, wm_start long, wm_n long, wm_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                s = Shard(blob.as_py())
                ids, ends = s.tokens().astype("<u4"), s.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                base = part_starts[s.header["order"][0]] + s.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["wm_id", "wm_start", "wm_n", "wm_crc32"]
                )

    return files.mapInArrow(run, schema)


def encode_and_read(docs: DataFrame, vocab: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the shards of docs into `folder` (a new one in the shared folder by default) and
    returns what is read back from them."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    written = write_shards(docs, folder, vocab, **options).groupBy("wm_part").agg(F.sum("wm_n").alias("n"))
    starts, total = {}, 0
    for r in sorted(written.collect()):  # one number per writer task
        starts[r[0]] = total
        total += r[1]
    if not starts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ("wm_id", "wm_start", "wm_n", "wm_crc32")]))
    return read_shards(spark, folder, starts)
