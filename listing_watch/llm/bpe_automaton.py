"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens; a token sequence labels a path exactly if BPE produces it. It starts
as one state with a loop for every byte. Each merge u + v -> w, in order of priority, adds a
gadget: arcs labelled u now lead to a copy of their target that lacks the arc v, and wherever u
then v could be read, an arc w leads to where v led. So the state that a token leads to is known
by what it has lost:

    lost(t) = the (v, merge) of merges y + v where y is t, or where y is on t's right spine and the
              merge came before the token that swallowed y: w takes over what v had lost so far,

and tokens that have lost the same share a state. An arc labelled x is in a state unless that has
lost some z on x's left spine while z was still free, that is by a merge not after the one that
swallowed z. `compile_states` makes the states and, for each, the arcs lost, as flat arrays; the
arcs that are left, some 50,000 in each state, are read from these and kept by (state, label) as
they are met.

Encoding reads a pre-split word's bytes: a double-array trie lists the tokens that start at a
place, and the arc table says which of them continue the path of the prefix. The path of every
prefix is unique, so a pass from left to right settles it. Words of a batch advance together in
numpy. Decoding emits the labels of the arcs, byte strings, one after another.

Defined results: a null or empty text has no tokens. Rows are encoded alone, whole; repeated rows
give repeated results, an empty table an empty one. Columns of the input are carried along,
whatever their names; those made here start with `bpe_`, and an input column of the same name
gives way.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, packed, unpacked

#: Fixed value: the published pre-split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 100_000
#: Characters of the texts that are encoded together.
CHARS = 500_000
#: Words longer than this many bytes are encoded one by one.
LONG = 48
FOREVER = 1 << 30
SLOTS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The published letter of each byte: printable Latin-1 stands for itself, the others follow
    from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.labels[i] = word.encode() if word in self.special else bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.labels[i] = word.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # the gadgets: when each token was made, and of which two
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)
        pair, when = [], []
        for k, (u, v) in enumerate(merges):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            pair.append(a << 20 | b)
            when.append(k)
            if self.made[w] < 0:
                self.left[w], self.right[w], self.made[w] = a, b, k
        order = np.argsort(np.array(pair, np.int64), kind="stable")
        self.pair = np.array(pair, np.int64)[order]
        self.when = np.array(when, np.int64)[order]
        self.compile_states()
        self.keys = np.full(SLOTS, -1, np.int64)
        self.vals = np.zeros(SLOTS, bool)
        # a token is an arc only if its halves could follow one another when it was made
        made = np.flatnonzero(self.made >= 0)
        usable = np.ones(size, bool)
        usable[made] = self.arcs(self.state[self.left[made]], self.right[made], self.made[made])
        self._trie({self.labels[i]: i for w, i in vocab.items() if w not in self.special and usable[i]})

    def compile_states(self) -> None:
        """`state` of each token, and the arcs lost in each state: the places `lost_at[s]` to
        `lost_at[s + 1]` of `lost` (label, ascending) and `lost_by` (the earliest merge)."""
        n = len(self.labels)
        first = np.searchsorted(self.pair, np.arange(n + 1) << 20)
        token, y, until = np.arange(n), np.arange(n), np.full(n, FOREVER)
        found = []
        while len(token):
            count = first[y + 1] - first[y]
            row = np.repeat(np.arange(len(token)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[y][row]
            free = self.when[at] < until[row]  # y was not yet swallowed
            found.append((token[row[free]], self.pair[at[free]] & 0xFFFFF, self.when[at[free]]))
            until, y = self.made[y], self.right[y]
            more = y >= 0
            token, y, until = token[more], y[more], until[more]
        t, z, k = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((k, z, t))
        t, z, k = t[order], z[order], k[order]
        once = np.r_[True, (t[1:] != t[:-1]) | (z[1:] != z[:-1])] if len(t) else np.zeros(0, bool)
        t, z, k = t[once], z[once], k[once]
        start = np.searchsorted(t, np.arange(n + 1))
        states: dict[bytes, int] = {}
        self.state = np.empty(n, np.int64)
        keep = []
        for i in range(n):
            a, b = start[i], start[i + 1]
            key = z[a:b].tobytes() + k[a:b].tobytes()
            if key not in states:
                states[key] = len(states)
                keep.append((a, b))
            self.state[i] = states[key]
        size = np.array([b - a for a, b in keep])
        at = np.concatenate([np.arange(a, b) for a, b in keep]) if keep else np.zeros(0, np.int64)
        self.lost_at = np.concatenate([[0], np.cumsum(size)])
        self.lost, self.lost_by = z[at].astype(np.int32), k[at].astype(np.int32)
        self.lost_key = np.repeat(np.arange(len(keep)), size) << 20 | self.lost

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """A double array: from node s byte c leads to base[s] + c if check there is s."""
        children: dict[bytes, list[int]] = {b"": []}
        for t in tokens:
            for k in range(1, len(t) + 1):
                if t[:k] not in children:
                    children[t[:k]] = []
                    children[t[: k - 1]].append(t[k - 1])
        room = 4 * len(children) + 1024
        used = bytearray(room)
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.token = np.full(room, -1, np.int32)
        slot = {b"": 0}
        used[0] = 1
        low = far = 256  # nodes of one child fill the gaps, others go on from the last of their kind
        todo = [b""]
        while todo:  # by levels, so that a node has its place before its children get theirs
            below = []
            for prefix in sorted(todo, key=lambda p: -len(children[p])):
                kids = sorted(children[prefix])
                if not kids:
                    continue
                low = used.find(0, low)
                at = low if len(kids) == 1 else used.find(0, max(low, far))
                while any(used[at - kids[0] + c] for c in kids[1:]):
                    at = used.find(0, at + 1)
                if len(kids) > 1:
                    far = at
                here, base = slot[prefix], at - kids[0]
                self.base[here] = base
                for c in kids:
                    used[base + c] = 1
                    self.check[base + c] = here
                    slot[prefix + bytes([c])] = base + c
                    below.append(prefix + bytes([c]))
            todo = below
        for t, i in tokens.items():
            self.token[slot[t]] = i
        end = max(slot.values()) + 257
        self.base, self.check, self.token = self.base[:end].copy(), self.check[:end].copy(), self.token[:end].copy()

    def arcs(self, state: np.ndarray, label: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Has the state the arc (once the merges before `until` are in)?"""
        ok = np.ones(len(label), bool)
        until = np.full(len(label), FOREVER) if until is None else until
        rows, z, swallowed = np.arange(len(label)), label, until.copy()
        while len(rows):
            key = state[rows] << 20 | z
            at = np.minimum(np.searchsorted(self.lost_key, key), len(self.lost_key) - 1)
            by = self.lost_by[at]
            ok[rows[(self.lost_key[at] == key) & (by <= swallowed) & (by < until[rows])]] = False
            go = self.left[z] >= 0
            swallowed, z, rows = self.made[z][go], self.left[z][go], rows[go]
        return ok

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where token b may follow token a (a < 0: the start)."""
        a = a.astype(np.int64)
        b = b.astype(np.int64)
        key = self.state[a] << 20 | b
        slot = (key * 0x9E3779B1 >> 12) & (SLOTS - 1)
        out = self.vals[slot]
        new = (self.keys[slot] != key) & (a >= 0)
        if new.any():
            fresh, back = np.unique(key[new], return_inverse=True)
            got = self.arcs(fresh >> 20, fresh & 0xFFFFF)
            out[new] = got[back]
            slot = (fresh * 0x9E3779B1 >> 12) & (SLOTS - 1)
            self.keys[slot], self.vals[slot] = fresh, got
        out[a < 0] = True
        return out

    def _encode_group(self, words: list[bytes]) -> list[list[int]]:
        """Words of at most LONG bytes, together, longest first."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        lens = np.array([len(words[i]) for i in order])
        width = int(lens[0])
        text = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        text[np.arange(width)[None, :] < lens[:, None]] = flat
        last = np.full((len(words), width + 1), -1, np.int64)
        for j in range(width):
            rows = np.arange(np.searchsorted(-lens, -j, side="left"))  # words longer than j
            if j:
                rows = rows[last[rows, j] >= 0]
            node, e = np.zeros(len(rows), np.int32), j
            while len(rows):
                slot = self.base[node] + text[rows, e]
                e += 1
                live = self.check[slot] == node
                rows, node = rows[live], slot[live]
                token = self.token[node]
                has = np.flatnonzero(token >= 0)
                if len(has):
                    good = has if not j else has[self.follows(last[rows[has], j], token[has])]
                    last[rows[good], e] = token[good]
                live = lens[rows] > e
                rows, node = rows[live], node[live]
        size = [len(x) for x in self.labels]
        out: list[list[int]] = [[] for _ in words]
        for r, i in enumerate(order):
            row, e, ids = last[r].tolist(), len(words[i]), []
            while e:
                ids.append(row[e])
                e -= size[row[e]]
            out[i] = ids[::-1]
        return out

    def _encode_long(self, word: bytes) -> list[int]:
        """A word of any length: the frontier of open places is as wide as the longest token."""
        n = len(word)
        last = array("i", [-1]) * (n + 1)
        base, check, token = self.base, self.check, self.token
        for j in range(n):
            if j and last[j] < 0:
                continue
            node, e, ends, ids = 0, j, [], []
            while e < n and check[slot := int(base[node]) + word[e]] == node:
                node = slot
                e += 1
                if (t := int(token[node])) >= 0:
                    ends.append(e)
                    ids.append(t)
            ok = self.follows(np.full(len(ids), last[j] if j else -1), np.array(ids))
            for e, t, good in zip(ends, ids, ok.tolist()):
                if good:
                    last[e] = t
        out, e = [], n
        while e:
            out.append(last[e])
            e -= len(self.labels[last[e]])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-split word."""
        short = [w for w in words if 0 < len(w) <= LONG]
        done = iter(self._encode_group(short) if short else [])
        return [next(done) if 0 < len(w) <= LONG else self._encode_long(w) if w else [] for w in words]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after another; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, built once in each Python worker."""
    return Automaton(path)


class Codec:
    """Whole texts to ids and back, with a bounded cache of words."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.a = automaton(path)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.a.special, key=len, reverse=True))) + ")") if self.a.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text the ids of each of its words; special strings are words of one id."""
        cut, new = [], set()
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        for text in texts:
            parts = [text]
            if self.special and any(s in text for s in self.a.special):
                parts = self.special.split(text)
            words: list[str | int] = []
            for p in parts:
                if p in self.a.special:
                    words.append(self.a.special[p])
                elif p:
                    words += self.split(p)
            cut.append(words)
            new.update(words)
        todo = [w for w in new if isinstance(w, str) and w not in cache]
        for w, ids in zip(todo, self.a.encode_words([w.encode() for w in todo])):
            cache[w] = tuple(ids)
        return [[cache[w] if isinstance(w, str) else (w,) for w in words] for words in cut]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, vocab: str, text_col: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """The columns `keep` of docs with `bpe_n` (tokens), `bpe_ids_sha256` (of the decimal ids joined
    by commas), `bpe_decoded_sha256` and, if asked for, `bpe_ids` and `bpe_decoded`.

    Null is the empty text, which has no tokens. Each row is encoded alone, whole."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    made = [T.StructField("bpe_n", T.LongType()), T.StructField("bpe_ids_sha256", T.StringType()), T.StructField("bpe_decoded_sha256", T.StringType())]
    if with_text:
        made += [T.StructField("bpe_ids", T.ArrayType(T.IntegerType())), T.StructField("bpe_decoded", T.StringType())]
    names = [f.name for f in made]
    src = packed(docs, keep, names, text=F.col(f"`{text_col}`"))
    schema = T.StructType([src.schema["row"], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocab)
        labels, numbers = code.a.labels, [b"%d" % i for i in range(len(code.a.labels))]
        sha = hashlib.sha256
        for b in groups(batches, 1, CHARS):
            texts = [x or "" for x in b.column(1).to_pylist()]
            rows: list[list] = [[] for _ in made]
            for words in code.encode_batch(texts):
                ids = [i for w in words for i in w]
                plain = b"".join([labels[i] for i in ids])
                try:
                    decoded = plain.decode()
                except UnicodeDecodeError:
                    decoded = plain.decode("utf-8", "replace")
                    plain = decoded.encode()
                got = [len(ids), sha(b",".join([numbers[i] for i in ids])).hexdigest(), sha(plain).hexdigest(), ids, decoded]
                for at, x in zip(rows, got):
                    at.append(x)
            cols = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *names])

    return unpacked(src.mapInArrow(run, schema), *names)
