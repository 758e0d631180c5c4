import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listing_watch.llm import bpe_automaton as b

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
FIXED = ["", " ", "a", "aaaa", "a" * 1000, " " * 300 + "x", "\x1c a\x1eb\x85", "日本語 テキスト", "<|endoftext|>x<|endoftext|>", "I'm  don't \n\n x\t\ty\xa0z", "🎉👨‍👩‍👧", "ab" * 60, "-" * 500, "ﬁ½Ⅷ\x00"]


def random_texts(n=400):
    r = random.Random(5)
    chars = [*"ab c'étion 1\n.", *map(chr, range(0x4E00, 0x4E20)), *map(chr, range(160, 300))]
    return ["".join(r.choice(chars) for _ in range(r.randint(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("texts", [FIXED, random_texts()], ids=["fixed", "random"])
def test_ids_and_text_are_the_library_s(texts):
    t = Tokenizer.from_file(VOCAB)
    code = b.Codec(VOCAB, cache_words=50)
    for x, words in zip(texts, code.encode_batch(texts)):
        ids = [i for w in words for i in w]
        want = t.encode(x, add_special_tokens=False).ids
        assert ids == want
        assert code.a.decode(ids) == t.decode(want, skip_special_tokens=False) == x


def test_arcs_follow_gadgets():
    import numpy as np

    a = b.automaton(VOCAB)
    ids = {label: i for i, label in enumerate(a.labels)}
    pairs = [(b"t", b"h", False), (b"th", b"e", False), (b"a", b"aa", False), (b"aa", b"a", False)]
    t = Tokenizer.from_file(VOCAB)
    for x, y, _ in pairs:
        if x in ids and y in ids:
            want = t.encode((x + y).decode(), add_special_tokens=False).ids == [ids[x], ids[y]]
            assert bool(a.follows(np.array([ids[x]]), np.array([ids[y]]))[0]) == want


def test_bytes_that_are_not_utf8():
    a = b.automaton(VOCAB)
    t = Tokenizer.from_file(VOCAB)
    ids = [a.labels.index(bytes([0xE3])), a.labels.index(b"a")]
    assert a.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_query_rows(spark):
    d = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, "", "z")], "doc_id long, text string, bpe_n string")
    rows = sorted(b.round_trip(d, VOCAB, keep=["doc_id"], with_text=True).collect(), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert [r["bpe_n"] for r in rows] == [2, 0, 0]
    assert rows[0]["bpe_ids_sha256"] == hashlib.sha256(",".join(map(str, rows[0]["bpe_ids"])).encode()).hexdigest()
    assert rows[0]["bpe_decoded"] == "hello world" and rows[1]["bpe_ids_sha256"] == rows[1]["bpe_decoded_sha256"] == none
    assert b.round_trip(d.limit(0), VOCAB).count() == 0
