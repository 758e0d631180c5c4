"""Approximate nearest neighbours from low-dimensional stable projections and kd-trees.

Nearness is the inner product. Vectors are lengthened by sqrt(M^2 - |x|^2), M the greatest norm,
and queries by 0, which makes the order by inner product that by distance. DIMS Gaussian
(2-stable) projections map them to a small space, where the squared distance over the true one
follows a chi-square law with DIMS degrees.

Index: a shallow kd-tree over the projections, fitted on a sample of at most SAMPLE vectors,
cuts the space into cells; every vector goes to its cell. A cell is stored in parts of at most
about PART vectors, picked by a hash of the id, so that a cell with any number of copies is read
in bounded pieces. Each part is a kd-tree of its own whose leaves hold about LEAF vectors.

Search: a chunk of queries meets the parts of a cell. Leaves are visited in order of projected
distance; a visit computes true inner products. A query stops when the chance that a vector
nearer than its k-th best lies beyond the next leaf's projected distance is small: when
chi2_DIMS(leaf distance^2 / k-th distance^2) is at least CONFIDENCE. Queries first search the
cell that holds them; the k-th distance found there tells which other cells the same test
leaves open, and only those are searched.

Scores are computed in double precision on the original vectors; ties go to the smaller id.
Vectors that are null, zero, of another length than most, or that hold a null or a non-finite
component take no part. Rows that repeat an id are vectors of their own; an empty table gives an
empty result. Columns made here start with `an_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

DIMS = 8
CONFIDENCE = 0.9
SAMPLE = 20_000
CELL = 4_000
MAX_CELLS = 1_024
PART = 8_000
LEAF = 256
CHUNK = 1024
SEED = 7


def valid(vec: Column) -> Column:
    """Not null, not zero, every component finite."""
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def chi2_below(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees."""
    h, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, dims // 2):
        term = term * h / i
        total += term
    return 1 - np.exp(-h) * total


def project(vectors: np.ndarray, top: float, query: bool, basis: np.ndarray) -> np.ndarray:
    """Projections of the lengthened vectors; basis has a row more than the vectors' length."""
    out = vectors @ basis[:-1]
    if not query:
        out += np.sqrt(np.maximum(0.0, top * top - (vectors * vectors).sum(axis=1)))[:, None] * basis[-1]
    return out


def kd_cells(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits (dimension, value) of a complete kd-tree in heap order."""
    splits: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for p in level:
            d = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
            v = float(np.median(p[:, d])) if len(p) else 0.0
            splits.append((d, v))
            below += [p[p[:, d] < v], p[p[:, d] >= v]]
        level = below
    return splits


def descend(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point."""
    node = np.zeros(len(points), np.int64)
    dims, vals = np.array([d for d, _ in splits], np.int64), np.array([v for _, v in splits])
    depth = (len(splits) + 1).bit_length() - 1
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= vals[node])
    return node - len(splits)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """The leaves of a kd-tree over the points: places, halved by the widest dimension."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        p = points[at]
        d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        cut = np.argpartition(p[:, d], len(at) // 2)
        todo += [at[cut[: len(at) // 2]], at[cut[len(at) // 2 :]]]
    return out


def search_part(
    ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, q_points: np.ndarray, worst: np.ndarray, k: int, top: float, confidence: float = CONFIDENCE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score) of each query's best in one part, at most k each.

    worst: squared distance of each query's k-th best so far (infinite if none)."""
    cells = leaves(points)
    low = np.array([points[c].min(axis=0) for c in cells])
    high = np.array([points[c].max(axis=0) for c in cells])
    gap = np.maximum(0, np.maximum(low[None] - q_points[:, None], q_points[:, None] - high[None]))
    dist = (gap * gap).sum(axis=2)
    order = np.argsort(dist, axis=1, kind="stable")
    n = len(q_ids)
    best = np.full((n, k), -np.inf)  # the k greatest scores so far, the least first
    norm = top * top + (q_vectors * q_vectors).sum(axis=1)
    live = np.arange(n)
    rows_found, at_found, score_found = [], [], []
    for step in range(len(cells)):
        d = dist[live, order[live, step]]
        # squared distance of lengthened vectors: M^2 + |q|^2 - 2 <x, q>
        kth = np.minimum(worst[live], np.maximum(norm[live] - 2 * best[live, 0], 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(np.isfinite(kth), np.where(kth > 0, d / kth, np.where(d > 0, np.inf, 0.0)), 0.0)
        live = live[chi2_below(ratio) < confidence]
        if not len(live):
            break
        leaf = order[live, step]
        for c in np.unique(leaf):
            rows, at = live[leaf == c], cells[c]
            score = q_vectors[rows] @ vectors[at].T
            a, b = np.nonzero((score >= best[rows, :1]) & (q_ids[rows][:, None] != ids[at][None]))
            if not len(a):
                continue
            rows_found.append(rows[a])
            at_found.append(at[b])
            score_found.append(score[a, b])
            hit = np.unique(a)
            own = q_ids[rows[hit]][:, None] == ids[at][None]
            both = np.concatenate([best[rows[hit]], np.where(own, -np.inf, score[hit])], axis=1)
            both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            best[rows[hit]] = both
    if not rows_found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    r, at, sc = np.concatenate(rows_found), np.concatenate(at_found), np.concatenate(score_found)
    keep = sc >= best[r, 0]
    r, at, sc = r[keep], at[keep], sc[keep]
    pick = np.lexsort((ids[at], -sc, r))
    r, at, sc = r[pick], at[pick], sc[pick]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], at[place < k], sc[place < k]


PACKED = "an_cell long, an_part int, an_ids binary, an_vecs binary, an_ats binary"


def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """One part as three flat arrays."""
    flat = lambda c: np.array(p[c].tolist(), float).tobytes()
    return pd.DataFrame({"an_cell": [key[0]], "an_part": [key[1]], "an_ids": [p["an_id"].to_numpy(np.int64).tobytes()], "an_vecs": [flat("an_vec")], "an_ats": [flat("an_at")]})


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """an_query, an_rank (from 1), an_id, an_score: the k nearest of every row for which `queries`
    holds, among all other rows."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("an_id"), F.col(vec_col).cast("array<double>").alias("an_vec"), F.coalesce(queries, F.lit(False)).alias("an_is_query")).filter(valid(F.col(vec_col)) & F.col(id_col).isNotNull())
    size = v.groupBy(F.size("an_vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = "an_query long, an_rank int, an_id long, an_score double"
    if not size:
        return spark.createDataFrame([], out)
    width = size[0]["n"]
    v = v.filter(F.size("an_vec") == width)
    stats = v.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("an_vec", F.lit(0.0), lambda a, x: a + x * x))).alias("top")).first()
    n, top = stats["n"], stats["top"]
    basis = np.random.default_rng(SEED).standard_normal((width + 1, DIMS))
    share = min(1.0, SAMPLE / n)
    drawn = v.filter(F.pmod(F.xxhash64("an_id"), F.lit(1_000_000)) < share * 1_000_000).select("an_vec").limit(SAMPLE).toPandas()
    depth = max(0, int(np.ceil(np.log2(max(1, min(MAX_CELLS, n / CELL))))))
    sample = project(np.array(drawn["an_vec"].tolist()).reshape(-1, width), top, False, basis) if len(drawn) else np.zeros((0, DIMS))
    splits = kd_cells(sample, depth)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            x = np.array(p["an_vec"].tolist())
            at = project(x, top, False, basis)
            yield pd.DataFrame({"an_id": p["an_id"], "an_vec": p["an_vec"], "an_is_query": p["an_is_query"], "an_at": list(at), "an_cell": descend(at, splits)})

    rows = stored(v.mapInPandas(index, "an_id long, an_vec array<double>, an_is_query boolean, an_at array<double>, an_cell long"), "ann-vectors")
    # one row for each cell: how many vectors it has, and the box of their projections
    box = rows.groupBy("an_cell").agg(F.count("*").alias("n"), *[f(F.col("an_at")[i]).alias(f"{s}{i}") for i in range(DIMS) for s, f in (("lo", F.min), ("hi", F.max))]).toPandas()
    parts = F.create_map(*[F.lit(x) for c, m in zip(box["an_cell"], box["n"]) for x in (int(c), -(-int(m) // PART))])
    kept = rows.withColumn("an_part", F.pmod(F.xxhash64("an_id"), parts[F.col("an_cell")]).cast("int"))
    kept = stored(kept.groupBy("an_cell", "an_part").applyInPandas(pack, PACKED), "ann-index")
    asked = rows.filter("an_is_query").select("an_id", "an_vec", "an_cell")
    low, high = box[[f"lo{i}" for i in range(DIMS)]].to_numpy(), box[[f"hi{i}" for i in range(DIMS)]].to_numpy()
    names = box["an_cell"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row in p.itertuples(index=False):
                ids, x, at = (np.frombuffer(b).reshape(-1, w) if w else np.frombuffer(b, np.int64) for b, w in ((row.an_ids, 0), (row.an_vecs, width), (row.an_ats, DIMS)))
                q_ids, q, worst = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.q_vecs).reshape(-1, width), np.frombuffer(row.q_worst)
                a, b, s = search_part(ids, x, at, q_ids, q, project(q, top, True, basis), worst, k, top, confidence)
                yield pd.DataFrame({"an_query": q_ids[a], "an_id": ids[b], "an_score": s})

    def pack_asked(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        worst = p["an_worst"].astype(float).fillna(np.inf)
        return pd.DataFrame({"an_cell": [key[0]], "q_ids": [p["an_id"].to_numpy(np.int64).tobytes()], "q_vecs": [np.array(p["an_vec"].tolist()).tobytes()], "q_worst": [worst.to_numpy().tobytes()]})

    def meet(ask: DataFrame) -> DataFrame:
        """ask: an_id, an_vec, an_worst, an_cell -> candidates of the queries in those cells."""
        salt = F.pmod(F.xxhash64("an_id", F.lit(3)), F.lit(max(1, n // (20 * CHUNK)))).alias("an_salt")
        g = ask.groupBy("an_cell", salt).applyInPandas(pack_asked, "an_cell long, q_ids binary, q_vecs binary, q_worst binary")
        return g.join(kept, "an_cell").mapInPandas(run, "an_query long, an_id long, an_score double")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells, other than its own, that the stopping test leaves open for a query."""
        for p in batches:
            if not len(p):
                continue
            q = np.array(p["an_vec"].tolist())
            at = project(q, top, True, basis)
            worst = np.where(p["an_kth"].isna(), np.inf, np.maximum(0, top * top + (q * q).sum(axis=1) - 2 * p["an_kth"].fillna(0).to_numpy()))
            gap = np.maximum(0, np.maximum(low[None] - at[:, None], at[:, None] - high[None]))
            dist = (gap * gap).sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(np.isfinite(worst)[:, None], np.where(worst[:, None] > 0, dist / worst[:, None], np.where(dist > 0, np.inf, 0.0)), 0.0)
            a, b = np.nonzero((chi2_below(ratio) < confidence) & (names[None] != p["an_cell"].to_numpy()[:, None]))
            yield pd.DataFrame({"an_id": p["an_id"].to_numpy()[a], "an_vec": p["an_vec"].to_numpy()[a], "an_worst": np.where(np.isfinite(worst[a]), worst[a], np.nan), "an_cell": names[b]})

    home = stored(meet(asked.withColumn("an_worst", F.lit(None).cast("double"))), "ann-home")
    kth = home.groupBy("an_query").agg(F.slice(F.sort_array(F.collect_list("an_score"), asc=False), k, 1).alias("s")).select("an_query", F.get("s", F.lit(0)).alias("an_kth"))
    wide = asked.join(kth, asked.an_id == kth.an_query, "left").select("an_id", "an_vec", "an_cell", "an_kth").mapInPandas(reach, "an_id long, an_vec array<double>, an_worst double, an_cell long")
    wide = wide.withColumn("an_worst", F.when(~F.isnan("an_worst"), F.col("an_worst")))
    order = Window.partitionBy("an_query").orderBy(F.desc("an_score"), "an_id")
    found = home.union(meet(wide)).withColumn("an_rank", F.row_number().over(order)).filter(F.col("an_rank") <= k)
    return found.select("an_query", F.col("an_rank").cast("int"), "an_id", "an_score")
