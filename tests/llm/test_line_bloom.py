import random
from collections import defaultdict

import numpy as np

from listing_watch.llm import line_bloom as lb

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, least=5, chars=40):
    """(id, n_lines, n_dropped, text) of (id, text) rows, by the plain rule."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= chars:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = lambda line: i is not None and len(held.get(key(line), ())) >= least and i != max(held[key(line)])
        kept = [line for line in lines if not gone(line)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of(d):
    return sorted(((r["doc_id"], r["ld_n_lines"], r["ld_n_dropped"], r["ld_text"]) for r in d.collect()), key=repr)


def random_rows(seed, n=120):
    r = random.Random(seed)
    shared = [" ".join(r.choice(["Word", "éé", "text", "x1"]) for _ in range(14)) for _ in range(25)]
    dress = lambda s: r.choice(["", " ", "\t\x0b"]) + (s.upper() if r.random() < 0.3 else s) + r.choice(["", "\r", "  "])
    rows = []
    for i in range(n):
        lines = [dress(r.choice(shared)) if r.random() < 0.4 else f"own line {i} {j} " + "z" * r.randint(0, 60) for j in range(r.randint(0, 9))]
        rows.append((i, "\n".join(lines)))
    return rows


def test_against_the_plain_rule(spark):
    rows = random_rows(1) + [(500, None), (501, ""), (502, "\n"), (503, "a" * 39), (None, random_rows(1)[3][1]), (3, random_rows(2)[5][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(lb.drop_shared_lines(d)) == sorted(plain(rows), key=repr)


def test_a_crowded_filter_changes_nothing(spark):
    rows = random_rows(4)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bits in (8, 64, 4096):
        assert rows_of(lb.drop_shared_lines(d, bits=bits)) == sorted(plain(rows), key=repr)


def test_few_suspects_and_none_missed():
    r = np.random.default_rng(5)
    bits = 1 << 20
    some = r.integers(0, 2**63, 40_000).astype(np.uint64)
    parts = []
    for i in range(4):  # the first 500 lie in two parts each
        f = lb.Filters(bits)
        f.add(np.concatenate([some[i * 10_000 : (i + 1) * 10_000], some[500 * ((i + 1) % 4) * 20 : 500 * ((i + 1) % 4) * 20 + 500]]))
        parts.append(f)
    once, twice = parts[0].once, parts[0].twice
    for f in parts[1:]:
        twice = twice | f.twice | (once & f.once)
        once = once | f.once
    hit = lb.within(twice, lb.places(some, bits))
    again = np.concatenate([some[500 * k * 20 : 500 * k * 20 + 500] for k in range(4)])
    assert lb.within(twice, lb.places(again, bits)).all()
    assert hit.sum() < len(again) + 0.01 * len(some)


def test_slices_survive():
    r = np.random.default_rng(6)
    for share in (0.0, 0.001, 0.2, 1.0):
        bitmap = np.packbits(r.random(8192) < share, bitorder="little")
        assert (lb.from_bytes(lb.to_bytes(bitmap), 8192) == bitmap).all()


def test_a_line_of_every_document_and_names_that_clash(spark):
    line = "this very long line stands in each and every document"
    rows = [(i, f"{line}\nown {i}\n{line.upper()}", f"t{i}", i) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ld_text string, row int")
    out = lb.drop_shared_lines(d)
    assert out.columns == ["doc_id", "text", "row", "ld_n_lines", "ld_n_dropped", "ld_text"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["ld_text"] == f"own {i}" and got[i]["ld_n_dropped"] == 2 for i in range(299))
    assert got[299]["ld_text"] == rows[299][1] and all(got[i]["row"] == i and got[i]["text"] == rows[i][1] for i in range(300))


def test_empty_table_and_long_text(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert lb.drop_shared_lines(d).count() == 0
    long = "\n".join(f"line number {i} of a text that is very long indeed" for i in range(50_000))
    rows = [(i, long) for i in range(5)]
    got = rows_of(lb.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(i, n, gone) for i, n, gone, _ in got] == [(i, 50_000, 50_000 if i < 4 else 0) for i in range(5)]
