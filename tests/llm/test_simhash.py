import random

import xxhash

from listing_watch.llm import covering_simhash as c


def plain(text):
    lowered = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    r = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "É é x", *[" ".join(r.choice(["ab", "c,", "Dé", "\x0bq"]) for _ in range(r.randint(1, 40))) for _ in range(50)]]
    assert all(c.fingerprint(t) == plain(t) for t in texts)


def test_masks_cover_the_radius():
    r = random.Random(2)
    masks = c.covering_masks()
    assert len(masks) == 7
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 2)))
        assert any(diff & (m % (1 << 64)) == 0 for m in masks)


def test_links_lose_nothing(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    vals = set(base)
    for b in base[:20]:
        for _ in range(25):  # crowded buckets
            vals.add(b ^ sum(1 << x for x in r.sample(range(64), r.randint(1, 3))))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in vals)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    d = spark.createDataFrame([(v,) for v in signed], "sh_fp long")
    edges = [tuple(x) for x in c.links(d).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in edges)
    assert roots(edges, signed) == roots(pairs, signed)
    got = {x["node"]: x["root"] for x in c.components(c.links(d)).collect()}
    assert {n: got.get(n, n) for n in signed} == roots(pairs, signed)


def test_long_chain_of_links(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {x["root"] for x in c.components(d).collect()} == {0}


def test_a_star_and_its_like_have_no_hot_task(spark):
    from pyspark.sql import functions as F

    n = 40_000
    star = spark.range(1, n).select((F.col("id") + 10).alias("a"), F.lit(n).cast("long").alias("b"))  # the middle is not the least
    tail = spark.createDataFrame([(5, 11), (n + 50, n + 60), (7, 7), (None, 3)], "a long, b long")
    got = {x["node"]: x["root"] for x in c.components(star.union(tail)).collect()}
    assert len(got) == n + 2 and got[n] == got[12] == got[11] == got[5] == 5 and got[n + 60] == got[n + 50] == n + 50
    # rows of the star's middle meet its smallest neighbour by broadcast
    low = spark.createDataFrame([(n, n, 5)], "b long, k long, m long")
    plan = c.attach(star, low, "b", "m", 2 * n)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert c.components(tail.limit(0)).count() == 0


def test_rows(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    rows = [(7, text, 1), (3, text.upper(), 2), (9, text, 3), (4, None, 4), (2, "", 5), (8, "other words here", 6), (8, "other words here", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sh_text int")
    got = sorted((x["doc_id"], x["sh_component"]) for x in c.near_duplicates(d).collect())
    assert got == [(2, 2), (3, 3), (4, 2), (7, 3), (8, 8), (8, 8), (9, 3)]
    assert sorted(x["doc_id"] for x in c.keep_first(d).collect()) == [2, 3, 8, 8]
    assert c.near_duplicates(d.limit(0)).count() == 0
