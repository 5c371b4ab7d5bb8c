"""Embedding operators against brute force: odd vectors, ties, repeated rows, full cells, empty tables."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from spendlake.llm import collisions, feast, heap_kmeans, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, salt int, cls long, node long, s double, cluster int, n long"
NAN, INF = float("nan"), float("inf")


def odd_vectors(dim, families=6):
    """Near and exact copies, null labels and ids, unusable vectors, another length, repeated ids, clashing columns."""
    rng = np.random.default_rng(3)
    unit = lambda: (v := rng.normal(size=dim)) / np.linalg.norm(v)
    rows = [(k, unit().tolist(), k % 3) for k in range(80)]
    for f in range(families):
        base = unit()
        rows += [(1000 + 50 * f + k, (base + rng.normal(size=dim) * 0.17 / math.sqrt(dim)).tolist(), f % 3) for k in range(25)]
    rows += [(3000 + k, rows[5][1], 5 % 3) for k in range(6)] + [(3010, rows[5][1], 1), (3011, [2 * x for x in rows[5][1]], 5 % 3)]
    rows += [(4000, None, 1), (4001, [0.0] * dim, 1), (4002, [None] + [0.1] * (dim - 1), 1), (4003, [NAN] * dim, 1), (4004, [INF] * dim, 1)]
    rows += [(4005, rows[5][1], None), (None, rows[5][1], 5 % 3), (4006, [], 1), (4007, [1.0, 2.0], 1), (4008, [1.0, 2.0], 1)]
    rows += [(1001, rows[7][1], 7 % 3), (7, rows[7][1], 7 % 3)]
    random.Random(1).shuffle(rows)
    return [(*r, 1, 2, 3, 0.5, 4, 5) for r in rows]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, cosine):
    up = {}

    def top(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and usable(v) and any(v)]
    count = defaultdict(int)
    m = {k: np.array(rows[k][1], dtype=np.float32).astype(float) for k in good}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(m[a]) == len(m[b]):
                if m[a] @ m[b] / (np.sqrt(m[a] @ m[a]) * np.sqrt(m[b] @ m[b])) >= cosine:
                    count[a] += 1
                    count[b] += 1
                    x, y = top(rows[a][0]), top(rows[b][0])
                    up[max(x, y)] = min(x, y)
    return sorted(((i, count[k], None if i is None else top(i)) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell, part", [(2048, 4096), (8, 16), (4, 5)])
def test_near_vectors_against_all_pairs(spark, cell, part):
    """Small cells and parts take the paths of large tables: more directions, and full cells cut into parts."""
    rows = odd_vectors(32)
    assert (collisions.cells_for(32, 100, 0.98, cell) > 0) == (cell < 2048)
    got = collisions.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), cell=cell, part=part).collect()
    want = brute_links([r[:3] for r in rows], 0.98)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_calibrated_count_is_met_by_pairs_at_the_threshold():
    dim, cells = 64, 3
    orders, needed = collisions.calibrated(dim, cells, 0.98, 0.01)
    assert needed >= 2
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = rng.normal(size=x.shape)
    t -= (t * x).sum(axis=1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * t / np.linalg.norm(t, axis=1)[:, None]
    (hx, sx), (hy, sy) = collisions.projected(x, cells, orders), collisions.projected(y, cells, orders)
    met = ((hx == hy) & (np.abs(sx - sy) <= collisions.half_window(dim, 0.98))).sum(axis=1)
    assert (met < needed).mean() < 0.02
    far = ((hx == np.roll(hy, 1, axis=0)) & (np.abs(sx - np.roll(sy, 1, axis=0)) <= collisions.half_window(dim, 0.98))).sum(axis=1)
    assert (far >= needed).mean() < 0.05


@pytest.mark.parametrize("operator", [collisions.near_vectors, heap_kmeans.clusters, feast.whitened])
def test_empty_tables_and_tables_without_a_usable_vector(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, 1, 1, 2, 3, 0.5, 4, 5), (2, [None, 1.0], 1, 1, 2, 3, 0.5, 4, 5)], SCHEMA)
    got = operator(none).collect()
    assert len(got) == (2 if operator is collisions.near_vectors else 0)


# --- clustering

def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if usable(v) and len(v) == dim]
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    mids = [v for _, v in sorted(kept, key=name)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, m), c) for c, m in enumerate(mids)) for _, v in kept]
    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, c), (_, v) in zip(assign(), kept):
            groups[c].append(v)
        mids = [[sum(x) // len(x) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(mids)]
    own, sums = assign(), defaultdict(int)
    for d, c in own:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(kept, own)), key=str)


@pytest.mark.parametrize("k, rounds, block", [(7, 5, 2048), (7, 5, 16), (40, 3, 64), (1, 2, 50), (1000, 2, 30)])
def test_clusters_against_plain_loops(spark, k, rounds, block):
    rows = odd_vectors(8)
    got = heap_kmeans.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dim=8, block=block).collect()
    as_rows = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got]
    assert sorted(as_rows, key=str) == brute_clusters(rows, k, rounds, 8)


def test_only_used_up_gaps_are_scanned():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-2000, 2000, (9, 12))
    x = centroids[rng.integers(0, 9, 500)] + rng.integers(-700, 700, (500, 12))
    ids = np.zeros(500, dtype=[("id", "<i8"), ("null", "<i8")])
    ids["id"] = np.arange(500)
    sizes = np.zeros(9, dtype=np.int64)
    sizes[0] = 500
    block = heap_kmeans.Block(ids.view("V16"), x, np.full(500, -np.inf), sizes)
    drift, scanned = np.zeros(9), []
    for _ in range(6):
        block, _, n = block.advance(centroids, drift)
        scanned.append(n)
        own = np.repeat(np.arange(9), block.sizes)
        assert (own == heap_kmeans.squared(block.x, centroids).argmin(axis=1)).all()
        new = centroids + rng.integers(-15, 15, centroids.shape)
        drift = drift + heap_kmeans.moved(centroids, new)
        centroids = new
    assert scanned[0] == 500 and max(scanned[1:]) < 250


def test_distances_of_large_components_are_exact():
    x = np.array([[1 << 26, -(1 << 26), 3], [5, 6, 7]])
    c = np.array([[-(1 << 26), 1 << 26, 1], [5, 6, 8]])
    assert heap_kmeans.squared(x, c).tolist() == [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x]
    with pytest.raises(ArithmeticError):
        heap_kmeans.whole(np.array([[1e30]]), 256)


# --- whitening

def brute_whitened(rows, dim, count):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v, *_ in rows if usable(v) and len(v) == dim])
    n, y = len(x), x - x.mean(axis=0)
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:count], q[:, ::-1][:, :count]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return [i for i, v, *_ in rows if usable(v) and len(v) == dim], y @ q / np.sqrt(e), deviation, e / np.trace(y.T @ y / n)


def check_whitened(got, rows, dim, count=8):
    ids, w, deviation, explained = brute_whitened(rows, dim, count)
    assert len(got) == len(ids) * count and {r.n for r in got} == {len(ids)}
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(count):
        mine = sorted(((r.vec_id, r.deviation, r.whitened, r.explained) for r in got if r.component == c + 1), key=lambda r: (str(r[0]), r[1], abs(r[2])))
        want = sorted(zip(ids, deviation, w[:, c]), key=lambda r: (str(r[0]), r[1], abs(r[2])))
        assert [m[:2] for m in mine] == [v[:2] for v in want]
        a, b = np.array([m[2] for m in mine]), np.array([v[2] for v in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert abs(mine[0][3] / explained[c] - 1) < 1e-9


def test_whitened_odd_vectors(spark):
    rows = odd_vectors(12)
    check_whitened(feast.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), rows, 12)


def test_whitening_query_against_dense_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(queries.QUERIES["op13_feast_whitening"](spark, SF).collect(), rows, 64)


def test_whitening_of_lower_rank(spark):
    rows = [(k, [float(k % 5), float(k % 3), 1.0, float(k % 5)], 0, 1, 2, 3, 0.5, 4, 5) for k in range(30)]
    got = feast.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    same = spark.createDataFrame([(k, [1.0, 2.0], 0, 1, 2, 3, 0.5, 4, 5) for k in range(4)], SCHEMA)
    assert feast.whitened(same).count() == 0


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), np.r_[1e6, np.linspace(1, 1.01, 30)], np.r_[5, 5, 5, 5, np.linspace(1, 2, 20)],
    np.r_[np.full(3, 7.0), np.full(12, 2.0), 1.0], np.r_[np.geomspace(1, 1e-9, 20), np.zeros(6)], np.array([3.0]),
    2 - np.arange(30) * 1e-7,
])
def test_contour_pairs_are_eigenpairs(values):
    v = spectrum(values)
    e, x = feast.principal(v, 8)
    want = np.sort(values)[::-1][: len(e)]
    assert len(e) == min(8, (values > feast.LEAST * values.sum()).sum())
    assert np.allclose(e, want, rtol=0, atol=1e-12 * values.max())
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12
    assert np.abs(v @ x - x * e).max() < 1e-11 * values.max()


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    for _ in range(30):
        values = rng.integers(-3, 4, 25) + 0.5
        assert [feast.inertia(spectrum(values), s) for s in (-2.0, 0.0, 1.0)] == [int((values > s).sum()) for s in (-2.0, 0.0, 1.0)]
    assert feast.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_deviation_beyond_a_long_is_null():
    x = np.array([[3, 4], [1 << 40, 0]])
    sums = [int(s) for s in x.sum(axis=0)]
    got = feast.deviations(x, 2, sums)
    assert got == [None, None]
    assert feast.deviations(np.array([[3, 4], [5, 0]]), 2, [8, 4]) == [(6 - 8) ** 2 + (8 - 4) ** 2, (10 - 8) ** 2 + 16]
