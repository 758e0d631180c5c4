import math
import random
import re
from collections import Counter

import numpy as np

from listing_watch.llm import bloom_rank as br

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    """Sorted (item, rank, id, score) by scoring every document for every item."""
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, length = len(counted), sum(k for _, _, k in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, k in counted:
            m = 50 + (50 * k * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def rows_of(d):
    return sorted(((r["br_item"], r["br_rank"], r["br_id"], r["br_score"]) for r in d.collect()), key=repr)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.6))}" for _ in range(2000)] + ["Éa", "éa", "ß", "日本", "A1"]
    docs = [(i, r.choice([" ", ", ", "-"]).join(r.choice(vocab) for _ in range(int(r.paretovariate(0.7)) % 700))) for i in range(n)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 30)))) for i in range(30)]
    return docs, items


def test_against_scoring_everything(spark):
    docs, items = corpus(1)
    docs += [(1000, None), (1001, ""), (1002, "... !"), (None, docs[0][1] + " w1"), (7, "w1 w2 w3"), *[(2000 + i, docs[5][1]) for i in range(80)]]
    items += [(100, None), (101, "!?"), (102, docs[5][1]), (103, "nowhere"), (None, "w1 w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(br.rank(d, q)) == plain(docs, items)
    assert rows_of(br.rank(d, q, top=3)) == plain(docs, items, 3)


def test_blocks_of_items_and_a_kept_index(spark, monkeypatch):
    docs, items = corpus(2, 150)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = br.build(d)
    monkeypatch.setattr(br, "ITEMS", 7)
    assert rows_of(br.rank(d, q, index)) == plain(docs, items)


def test_signatures_never_underestimate():
    r = random.Random(3)
    block, texts = br.Block(512), []
    for _ in range(50):
        c = Counter(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 400)))
        known = {t: br.hash_of(t) for t in c}
        block.add((0, 0, 0), *br.entries(c, known))
        texts.append(c)
    rows = np.frombuffer(block.slices(), np.uint8).reshape(512, -1)
    terms = list("abcdefghijklmnopqrstuvwxyz")
    bound = np.zeros((len(terms), 50), np.int64)
    term, doc, most = br.most_often(rows, np.array([br.hash_of(t) for t in terms], np.uint64))
    bound[term, doc] = most
    assert (np.diff(term) >= 0).all()
    for j, c in enumerate(texts):
        for i, t in enumerate(terms):
            assert bound[i, j] >= c[t]
    exact = [bound[i, j] <= 2 * c[t] for j, c in enumerate(texts) for i, t in enumerate(terms)]
    assert sum(exact) > 0.9 * len(exact)


def test_few_documents_are_scored(spark):
    docs, items = corpus(4, 1500)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = br.build(d)
    n, length = index["totals"].first()
    df = {r["term"]: r["df"] for r in index["words"].collect()}
    asked = br.Asked([sorted(set(words(t))) for _, t in items], {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}, n, length)
    best = plain(docs, items)
    floors = [min((s for i, k, _, s in best if i == item and k == 50), default=1) for item, _ in items]
    left = br._best_sums(index["blocks"], asked, 50, floors).count()
    assert left < 0.5 * len(docs) * len(items)


def test_smoothing_beyond_a_long():
    assert br.smoothing([10**9], 10**12, 10**15).tolist() == [50 + (50 * 10**9 * 10**12) // 10**15]


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", "x")], "doc_id long, text string, h string")
    none = spark.createDataFrame([], "item_id long, text string")
    q = spark.createDataFrame([(5, "two", 1)], "item_id long, text string, br_rank int")
    assert br.rank(docs, none).count() == 0 and br.rank(docs.limit(0), q).count() == 0
    assert br.rank(docs, q).columns == ["br_item", "br_rank", "br_id", "br_score"]
    assert rows_of(br.rank(docs, q)) == plain([(1, "one two")], [(5, "two")])
