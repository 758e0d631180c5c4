import random

from listing_watch.llm import covering_simhash as c
from listing_watch.llm import near_copies as n


def test_keys_of_the_same_texts_are_one(spark):
    # (key, node, size, shingles left from the key on): 1 to 3 are of nodes 1 and 2, 4 of three nodes, 5 of 2 and 3
    rows = [(k, node, 50, 50 - place) for k, nodes, place in ((1, (1, 2), 4), (2, (1, 2), 2), (3, (1, 2), 3), (4, (1, 2, 3), 0), (5, (2, 3), 9)) for node in nodes]
    live = spark.createDataFrame(rows, "nc_key long, nc_node long, nc_s int, nc_r int")
    got = sorted(tuple(r) for r in n._once(live).select("nc_key", "nc_node", "nc_s", "nc_r").collect())
    assert got == sorted(r for r in rows if r[0] in (2, 4, 5))
    assert n._once(live.limit(0)).count() == 0


def test_a_shared_passage_costs_a_key(spark, monkeypatch):
    r = random.Random(6)
    rows = []
    for k in range(10):
        passage = [f"p{k}x{i}" for i in range(60)]
        rows += [" ".join([f"w{r.randrange(10**9)}" for _ in range(20)] + passage) for _ in range(4)]
        rows += [" ".join([*passage, f"end{k}"]), " ".join([f"start{k}", *passage])]
    kept, real = {}, n.stored
    monkeypatch.setattr(n, "stored", lambda d, name: kept.update({name: real(d, name)}) or kept[name])
    got = {x["doc_id"]: x["nc_component"] for x in n.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    sets = [set(n.shingles(t).tolist()) for t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            assert 10 * len(a & b) < 8 * len(a | b) or got[i] == got[j]
    assert len(set(got.values())) == 50
    assert kept["copy-first-keys"].count() < kept["copy-keys"].count() / 3


def test_no_broadcast_without_a_hot_key(spark):
    edges = c.stored(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), "edges")
    low = edges.groupBy("b").agg(c.F.count("*").alias("k"), c.F.min("a").alias("m"))
    d = c.attach(edges, c.stored(low, "lows"), "b", "m", 100)
    assert "Union" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(x) for x in d.select("a", "b", "m").collect()) == [(i, i + 1, i) for i in range(50)]


def test_sketches_in_the_join_lose_no_near_copy(spark):
    r = random.Random(2)
    rows, want = [], []
    for size in (1, 30, 62, 66, 130, 700, 3900, 4200, 9000):
        for share in (0.0, 0.05, 0.1, 0.2, 0.5, 1.0):
            a = {r.getrandbits(64) for _ in range(size)}
            b = set(list(a)[int(share * size / 2) :]) | {r.getrandbits(64) for _ in range(int(share * size))}
            x, y = (n.np.array(sorted(s), n.np.uint64) for s in (a, b))
            p, q = n.sketch(x), n.sketch(y)
            rows.append((len(rows), n.folded(p).tolist(), n.folded(q).tolist()))
            want.append((len(a) + len(b), len(a ^ b), len(p), len(q), n.may_be_similar(p, len(a), q, len(b))))
    d = spark.createDataFrame(rows, "i int, x array<long>, y array<long>")
    got = {z["i"]: z["d"] for z in d.select("i", n._differ(c.F.col("x"), c.F.col("y")).alias("d")).collect()}
    assert all(got[i] <= apart for i, (_, apart, *_) in enumerate(want))
    # where neither was folded, nor one more than twice as long, the verdict is that of whole sketches
    for i, (both, _, p, q, may) in enumerate(want):
        if max(p, q) <= 8 * n.LONGS and max(p, q) <= 2 * min(p, q):
            assert (180 * got[i] <= 20 * both) == may
    assert sum(180 * got[i] > 20 * w[0] for i, w in enumerate(want)) > len(want) / 4
