import hashlib
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from listing_watch.llm import pii_crf, queries, source_mix, weak_quality

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / str(i)))
        steps.append(spark.read.parquet(str(tmp_path / str(i))))
    raw, good, single, clean, mixed, last = [{r["doc_id"]: r for r in d.collect()} for d in steps]
    # quality: the base checks, and what the labels call clean stays
    for i, r in good.items():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) >= weak_quality.MIN_WORDS and r == raw[i]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = {i for i, r in raw.items() if len(r["text"].split()) >= 60}
    assert sum(i in good for i in long if labels.get(i) == 1) >= 0.98 * sum(labels.get(i) == 1 for i in long)
    assert not any(labels.get(i) == 0 for i in good)
    # near duplicates: the first of each component of the graph of all pairs of texts that share 0.8
    # of their five-word shingles
    ids = sorted(good)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(good[i]["text"]) for i in ids}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert set(single) == {i for i in ids if root(i) == i}
    # personal data
    assert set(clean) == set(single)
    for i, r in clean.items():
        text = single[i]["text"]
        assert r["text"] == pii_crf.redact(text, pii_crf.find([text])[0][1]) and r["n_chars"] == len(r["text"])
        assert not pii_crf.base_spans(r["text"])
    # the mix
    sizes = {}
    for r in clean.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want = source_mix.targets(sizes)
    got = {}
    for i, r in mixed.items():
        n = len(r["text"].split())
        assert n <= 2 * len(clean[i]["text"].split())
        got[r["source"]] = got.get(r["source"], 0) + n
    assert all(abs(got.get(s, 0) - t) <= max(80, 0.05 * t) for s, t in want.items())
    # tokens
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(last) == set(mixed)
    for i, r in last.items():
        ids = t.encode(mixed[i]["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(mixed[i]["text"].encode()).hexdigest()
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_query_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
