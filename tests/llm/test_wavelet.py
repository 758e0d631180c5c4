import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listing_watch.llm import wavelet

VOCAB = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "the cat", "The cat, the cat. THE CAT!!,", "é é́ Σ ΑΣ. naïve.", "<|endoftext|> a <|STARTOFTEXT|>", "x\ty\x0bz\n\nw", "don't, it's.", "日本語 ｶﾅ", "İI.", "word " * 3000, "the cat"]


@pytest.fixture(scope="module")
def expected():
    t = Tokenizer.from_file(VOCAB)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]


def test_encoder_is_the_library(expected):
    got = wavelet.Encoder(VOCAB, cache_words=2).encode([x or "" for x in TEXTS])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e[:-1] for e in expected]


@pytest.mark.parametrize("n, top, levels", [(0, 5, 16), (1, 1, 1), (1000, 7, 3), (5000, 60_000, 16), (3000, 100_000, 17)])
def test_shard_access_count_and_occurrence(n, top, levels):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    s = wavelet.Shard(wavelet.Shard.build([3, None], [n // 2, n - n // 2], ids, 10, (4, 2), levels))
    assert (s.tokens() == ids).all() and s.doc_ids == [3, None] and s.start == 10
    for i in range(0, n, max(1, n // 50)):
        assert s.access(i) == ids[i]
    for t in {int(x) for x in ids[:20]} | {top + 1}:
        at = np.flatnonzero(ids == t)
        assert s.count(t) == len(at) and s.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        for k in range(0, len(at), max(1, len(at) // 5)):
            assert s.occurrence(t, k) == at[k]
        with pytest.raises(IndexError):
            s.occurrence(t, len(at))


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 20])
def test_files_hold_every_text(spark, expected, shard_tokens, tmp_path):
    rows = [(i * 7 % 12, t, "extra") for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(rows, "doc_id long, text string, wm_id string").repartition(3)
    got = {r["wm_id"]: r for r in wavelet.encode_and_read(d, VOCAB, str(tmp_path / "s"), shard_tokens=shard_tokens).collect()}
    by_id = {i * 7 % 12: e for i, e in enumerate(expected)}
    start = 0
    for i in sorted(by_id):
        assert (got[i]["wm_start"], got[i]["wm_n"]) == (start, len(by_id[i]))
        assert got[i]["wm_crc32"] == zlib.crc32(np.array(by_id[i], "<u4").tobytes())
        start += len(by_id[i])


def test_ties_nulls_and_empty(spark, tmp_path):
    d = spark.createDataFrame([(None, "a b"), (5, "x"), (5, "x"), (5, None)], "doc_id long, text string")
    got = sorted((r["wm_start"], r["wm_id"], r["wm_n"]) for r in wavelet.encode_and_read(d, VOCAB, str(tmp_path / "a")).collect())
    assert got == [(0, None, 3), (3, 5, 1), (4, 5, 2), (6, 5, 2)]
    assert wavelet.encode_and_read(d.limit(0), VOCAB, str(tmp_path / "b")).count() == 0
