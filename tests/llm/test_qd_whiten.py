import numpy as np
import pytest

from listing_watch.llm import qd_whiten as qw

g = np.random.default_rng(0)
CASES = {
    "equal spread": g.normal(size=(3000, 64)),
    "graded": g.normal(size=(3000, 64)) * np.logspace(0, -6, 64),
    "all values equal": np.eye(64)[np.arange(640) % 64] * 100.0,
    "rank 8": g.normal(size=(3000, 8)) @ g.integers(-3, 3, size=(8, 64)),
    "fewer rows than dimensions": g.normal(size=(20, 64)),
    "repeated dimensions": np.repeat(g.normal(size=(1000, 16)), 4, axis=1),
    "dimensions without variance": np.hstack([g.normal(size=(1000, 32)), np.zeros((1000, 32))]),
    "one dimension": g.normal(size=(300, 1)),
    "two": g.normal(size=(300, 2)),
}
CASES["nearly equal pairs"] = (lambda a: np.hstack([a, a[::-1] * (1 + 1e-9)]))(np.linalg.qr(g.normal(size=(2000, 32)))[0] * 64)


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    x = CASES[name]
    n, d = x.shape
    c = x - x.mean(axis=0)
    r = np.linalg.qr(c, mode="r")
    values, z, total = qw.principal(np.vstack([r, np.zeros((d - len(r), d))]), 32)
    cov = c.T @ c / n
    e = np.linalg.eigvalsh(cov)[::-1]
    assert len(values) == min(32, np.linalg.matrix_rank(c))
    assert np.allclose(values / n, e[: len(values)], rtol=1e-10, atol=0)
    assert np.isclose(total / n, np.trace(cov))
    assert np.abs(cov @ z - z * (values / n)).max() < 1e-12 * e[0]
    assert np.abs(z.T @ z - np.eye(len(values))).max() < 1e-10


def test_no_variance_at_all():
    values, z, total = qw.principal(np.zeros((4, 4)), 32)
    assert len(values) == 0 and z.shape == (4, 0) and total == 0


def whole(vectors):
    return np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000


def test_rows(spark):
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=6).tolist(), f"p{i}") for i in range(200)] + [(7, r.normal(size=6).tolist(), "again"), (None, r.normal(size=6).tolist(), "no id")]
    bad = [(900, None, "a"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "b"), (902, [float("nan")] * 6, "c"), (903, [float("inf")] * 6, "d"), (904, [1.0] * 5, "e"), (905, [], "f")]
    d = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, qw_n string").repartition(9)
    out = qw.whiten(d)
    assert out.columns == ["vec_id", "embedding", *qw.MADE]
    rows = out.collect()
    x = whole([v for _, v, _ in good])
    n, s = len(x), x.sum(axis=0)
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    w = c @ v / np.sqrt(e)
    want = {tuple(vec): (((n * a - s) ** 2).sum(), y) for (_, vec, _), a, y in zip(good, x, w)}
    assert len(rows) == 6 * n and {r["qw_n"] for r in rows} == {n}
    signs = {}
    for r in rows:
        deviation, y = want[tuple(r["embedding"])]
        k = r["qw_component"] - 1
        signs.setdefault(k, np.sign(r["qw_whitened"] * y[k]))
        assert r["qw_deviation"] == deviation and abs(r["qw_whitened"] * signs[k] - y[k]) < 1e-9
        assert abs(r["qw_explained"] - e[k] / e.sum()) < 1e-10 and r["qw_identity_error"] < 1e-9
    assert sorted(repr(r["vec_id"]) for r in rows if r["qw_component"] == 1) == sorted(repr(i) for i, _, _ in good)


def test_edges(spark):
    kind = "vec_id long, embedding array<double>"
    assert qw.whiten(spark.createDataFrame([], kind)).count() == 0
    assert qw.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert qw.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0  # no variance, no component
    line = qw.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], kind)).collect()
    assert sorted(round(abs(r["qw_whitened"]), 12) for r in line) == [1, 1] and {r["qw_component"] for r in line} == {1}
    far = qw.whiten(spark.createDataFrame([(1, [2.0**45]), (2, [-(2.0**45)])], kind)).collect()
    assert [r["qw_deviation"] for r in far] == [None, None]


def test_many_parts(spark):
    d = spark.range(3000).selectExpr("id AS vec_id", "array(sin(id), cos(id * 3), id % 7, id % 2) AS embedding")
    a = {(r["vec_id"], r["qw_component"]): r for r in qw.whiten(d.repartition(70)).collect()}
    b = {(r["vec_id"], r["qw_component"]): r for r in qw.whiten(d.repartition(1)).collect()}
    assert a.keys() == b.keys() and len(a) == 12_000
    for k in a:
        assert abs(abs(a[k]["qw_whitened"]) - abs(b[k]["qw_whitened"])) < 1e-9 and a[k]["qw_deviation"] == b[k]["qw_deviation"]
