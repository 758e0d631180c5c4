import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_watch.llm import ann_stable, source_mix


def vectors(n, clusters, dims=32, seed=1, scale=False):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    x = centres[r.integers(0, clusters, n)] + 0.2 * r.normal(size=(n, dims))
    return x * r.uniform(0.5, 2, (n, 1)) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, clusters, scale", [(3000, 10, False), (3000, 3000, False), (2000, 20, True)])
def test_recall(spark, monkeypatch, n, clusters, scale):
    monkeypatch.setattr(ann_stable, "CELL", 400)
    monkeypatch.setattr(ann_stable, "PART", 300)
    x = vectors(n, clusters, scale=scale).astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann_stable.nearest(d, F.col("vec_id") % 20 == 0).toPandas()
    q = np.arange(0, n, 20)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :20]
    found = {k: set(g["an_id"]) for k, g in got.groupby("an_query")}
    assert np.mean([len(found[int(a)] & set(b.tolist())) / 20 for a, b in zip(q, top)]) >= 0.95
    one = got[got["an_query"] == 20].sort_values("an_rank")
    assert one["an_rank"].tolist() == list(range(1, 21)) and one["an_score"].is_monotonic_decreasing
    assert np.allclose(one["an_score"], x[20] @ x[one["an_id"].to_numpy()].T, atol=1e-12)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [0.5, 0.5]), (40, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["an_query"], r["an_rank"], r["an_id"]) for r in ann_stable.nearest(d, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann_stable.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def plain_targets(words):
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e12
    for _ in range(200):  # the level at which the capped shares use all
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * words[s], mid * weight[s]) for s in order) < 1.5 * sum(words.values()) else (lo, mid)
    return {s: min(2 * words[s], lo * weight[s]) for s in order}


@pytest.mark.parametrize("words", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 5, "c": 0}, {None: 7}, {}])
def test_targets(words):
    assert source_mix.targets(words) == pytest.approx(plain_targets(words))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 777])
def test_permutation(n):
    k = np.arange(n)
    for key in (0, 5, 1 << 40):
        assert sorted(source_mix.permute(k, np.full(n, n), np.full(n, key))) == k.tolist()


def docs(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1 + i * 37 % 200)), ["hot", "hot", "b", None][i % 4], i, 1) for i in range(300)]
    rows += [(1000, None, "b", 0, 1), (1001, " \n", "b", 0, 1), (1002, "twice twice", "c", 0, 1), (1002, "twice twice", "c", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, mx_size int")


def test_mix(spark):
    d = docs(spark)
    rows = source_mix.taken(d, block=8, shard_slots=100).collect()
    assert len(rows) == 304 and all(0 <= r["mx_taken"] <= 2 * r["mx_size"] for r in rows)
    src = {r["doc_id"]: r["source"] for r in d.collect()}
    words, got = {}, {}
    for r in rows:
        s = src[r["mx_id"]]
        words[s] = words.get(s, 0) + r["mx_size"]
        got[s] = got.get(s, 0) + r["mx_taken"]
    want = plain_targets(words)
    for s in words:
        assert abs(got[s] - want[s]) <= max(16, 0.02 * want[s])
    again = source_mix.taken(d.repartition(5), block=8, shard_slots=100).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert source_mix.taken(d.limit(0)).count() == 0


def test_mixed_texts_hold_what_is_taken(spark):
    d = docs(spark)
    out = source_mix.mixed_texts(d, block=8, shard_slots=100)
    assert out.columns == d.columns
    rows = out.collect()
    taken = {}
    for r in source_mix.taken(d, block=8, shard_slots=100).collect():
        taken.setdefault(r["mx_id"], []).append(r["mx_taken"])
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(len(r["text"].split()))
        assert set(r["text"].split()) <= set(texts[r["doc_id"]].split()) and r["n_chars"] == len(r["text"])
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(x for x in v if x) for k, v in taken.items() if any(v)}
    assert source_mix.mixed_texts(d.limit(0)).count() == 0


def test_small_sources_get_all_their_slots(spark):
    sizes = [40_000, 1, 4, 16, 3]  # blocks of 8 words
    plan = [(f"s{i}", 8 * b, b, 8.0 * b * (2 if i else 1.4)) for i, b in enumerate(sizes)]
    rows = source_mix._slots(spark, plan, 8, 50, 2).toPandas()
    assert rows.groupby("mx_of").size().tolist() == [56_000, 2, 8, 32, 6]
    assert set(rows.groupby(["mx_of", "mx_block"]).size()[1:]) <= {1, 2} and (rows[rows.mx_of > 0].groupby(["mx_of", "mx_block"]).size() == 2).all()
    assert (rows.groupby("mx_shard").size().iloc[:-1] == 50).all() and not rows.duplicated(["mx_shard", "mx_slot"]).any()


def test_shards_draw_without_replacement():
    have = np.array([5, 0, 9000, 40_000, 1])
    shards, slots = 12, 4096
    firsts, counts = zip(*[source_mix.deal(have, i, shards, slots) for i in range(shards)])
    counts = np.array(counts)
    assert (counts.sum(axis=0) == have).all() and (counts.sum(axis=1)[:-1] == slots).all()
    assert (np.array(firsts) == np.cumsum(counts, axis=0) - counts).all()
    # spread as a draw is, not as means are
    got = np.array([source_mix.split(np.array([3000, 5000]), 1000, [i])[0] for i in range(400)])
    want = 1000 * 0.375 * 0.625 * 7000 / 7999
    assert abs(got.mean() - 375) < 3 and 0.75 * want < got.var() < 1.3 * want
    wide = np.array([10**11, 3 * 10**11 + 1, 7])
    part = source_mix.split(wide, 10**11, [1])
    assert part.sum() == 10**11 and (abs(part - wide * (10**11 / wide.sum())) < 1.01).all()
