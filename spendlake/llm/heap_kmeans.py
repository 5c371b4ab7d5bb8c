"""Exact centroid clustering with heap-ordered bounds.

Components become integers, so every distance, sum and mean is exact. Vectors travel in blocks. A block holds one heap
per cluster, ordered by the gap between the distance to the nearest other centroid and that to its own (a lower and an
upper bound), offset by the drift its cluster had accumulated when the bound was taken. A gap is used up once the
drift since then reaches it: only these vectors are popped, scanned against all centroids and pushed back. A heap
whose smallest key lies beyond its cluster's drift is not looked at. Blocks return the sums of vectors that moved,
so a round shuffles a few numbers per block and centroid and no vectors.

The heaps are kept as sorted arrays, whose expired part is a prefix.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, staged, tuned
from spendlake.llm.vectors import finite, matrices

CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Vectors of one block.
BLOCK = 2048
#: Components up to this size have exact distances in a long.
LARGEST = 1 << 27
_EXACT = 1 << 20  # up to here all partial sums of a product of two vectors are exact in a double

_STATE = "ids binary, vectors binary, width int, keys binary, sizes binary, moved binary"
_SCHEMA = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in _STATE.split(", ")])
_SUMS = pa.schema([("cluster", pa.int32()), ("axis", pa.int32()), ("total", pa.int64())])


def whole(m: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    x = np.floor(m * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ArithmeticError(f"components above {LARGEST / scale} have no exact distances in a long")
    return x.astype(np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        dot = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * dot + (centroids * centroids).sum(axis=1)[None, :]
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance and a lower bound of the next distance."""
    d = squared(x, centroids)
    own = d.argmin(axis=1)
    best = d[np.arange(len(x)), own]
    if len(centroids) == 1:
        return own, best, np.full(len(x), np.inf)
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    return own, best, np.sqrt(d.min(axis=1).astype(np.float64))


class Block:
    """Vectors in the order of their clusters' heaps."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keys: np.ndarray, sizes: np.ndarray):
        self.ids, self.x, self.keys, self.sizes = ids, x, keys, sizes

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[Block, np.ndarray, int]:
        """The block after one assignment, sums and counts that changed per cluster, and how many vectors were scanned.

        ``drift`` is what each cluster has accumulated: its own moves and, per round, the largest move of the others.
        """
        k, ends = len(centroids), np.cumsum(self.sizes)
        starts = ends - self.sizes
        popped = []
        for c in range(k):
            heap = self.keys[starts[c] : ends[c]]
            # A gap that is used up but for rounding counts as used up.
            n = int(np.searchsorted(heap, drift[c] * (1 + 1e-12) + 1e-9, side="right"))
            if n:
                popped.append(np.arange(starts[c], starts[c] + n))
        change = np.zeros((k, self.x.shape[1] + 1), dtype=np.int64)
        if not popped:
            return self, change, 0
        at = np.concatenate(popped)
        was = np.repeat(np.arange(k), self.sizes)
        own, best, next_ = nearest(self.x[at], centroids)
        gap = next_ - np.sqrt(best.astype(np.float64))
        now, keys = was.copy(), self.keys.copy()
        now[at], keys[at] = own, gap + drift[own]
        ones = np.concatenate((self.x[at], np.ones((len(at), 1), dtype=np.int64)), axis=1)
        moved = own != was[at]
        np.add.at(change, own[moved], ones[moved])
        np.subtract.at(change, was[at][moved], ones[moved])
        order = np.lexsort((keys, now))
        return Block(self.ids[order], self.x[order], keys[order], np.bincount(now, minlength=k)), change, len(at)


def _row(block: Block, moved: np.ndarray) -> pa.RecordBatch:
    top = int(np.abs(block.x).max(initial=0))
    width = 2 if top < 1 << 15 else 8
    values = [block.ids.tobytes(), block.x.astype(f"<i{width}").tobytes(), width, block.keys.tobytes(), block.sizes.astype("<i8").tobytes(), moved.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)


def _block(row: dict, dim: int) -> Block:
    x = np.frombuffer(row["vectors"], dtype=f"<i{row['width']}").astype(np.int64).reshape(-1, dim)
    return Block(np.frombuffer(row["ids"], dtype="V16"), x, np.frombuffer(row["keys"], dtype=np.float64), np.frombuffer(row["sizes"], dtype="<i8"))


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _first(batches, centroids, scale, block):
    """Blocks of new vectors, all of them scanned."""
    known, x = [], []

    def close():
        ids, m = np.concatenate(known), np.concatenate(x)
        own, best, next_ = nearest(m, centroids)
        order = np.lexsort((gap := next_ - np.sqrt(best.astype(np.float64)), own))
        sums = np.zeros((len(centroids), m.shape[1] + 1), dtype=np.int64)
        np.add.at(sums, own, np.concatenate((m, np.ones((len(m), 1), dtype=np.int64)), axis=1))
        return _row(Block(ids[order], m[order], gap[order], np.bincount(own, minlength=len(centroids))), sums)

    for batch in batches:
        for rows, m in matrices(batch.column("v")):
            # An id and whether there is one.
            ids = np.zeros(len(rows), dtype=[("id", "<i8"), ("null", "<i8")])
            column = batch.column("id").take(pa.array(rows))
            ids["id"], ids["null"] = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            for a in range(0, len(m), block):
                known.append(ids[a : a + block].view("V16"))
                x.append(whole(m[a : a + block], scale))
                if sum(map(len, x)) >= block:
                    yield close()
                    known.clear()
                    x.clear()
    if x:
        yield close()


def _next(batches, centroids, drift, dim):
    for row in _rows(batches):
        block, change, _ = _block(row, dim).advance(centroids, drift)
        yield _row(block, change)


def _moves(batches, k, dim):
    """Sums of what moved in this task's blocks: one row per centroid and axis that changed."""
    total = np.zeros((k, dim + 1), dtype=np.int64)
    for row in _rows(batches):
        total += np.frombuffer(row["moved"], dtype=np.int64).reshape(total.shape)
    c, a = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(a, pa.int32()), pa.array(total[c, a])], schema=_SUMS)


_OUT = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _assigned(batches, centroids, dim):
    for row in _rows(batches):
        block = _block(row, dim)
        own = np.repeat(np.arange(len(centroids)), block.sizes)
        ids = block.ids.view([("id", "<i8"), ("null", "<i8")])
        distance = ((block.x - centroids[own]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids["id"], mask=ids["null"] != 0), pa.array(own, pa.int32()), pa.array(distance)], schema=_OUT
        )


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Drift of every cluster by one round: its own move and the largest move of another centroid, rounded up."""
    step = np.sqrt(((old - new).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
    others = np.array([np.delete(step, c).max(initial=0.0) for c in range(len(step))])
    return step + others


def clusters(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    dim: int = DIM, scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x counts as floor(scale * x).
    The start centroids are the kept vectors with the smallest SHA-256 of ``2:<id>`` in that order (fewer, if fewer are
    kept; of rows that share an id the smaller vector comes first, and rows without an id come last). Every round assigns
    each vector to the nearest centroid, ties to the smaller number, and moves every non-empty centroid to the floor of
    its mean; a last assignment follows. Rows without an id are clustered as well. Components beyond LARGEST / scale raise an error, because
    their distances have no exact long. Other columns are not read; an empty table gives an empty result.
    """
    spark = tuned(rows.sparkSession)
    vector = F.col(vector_col)
    kept = rows.where(finite(vector) & (F.size(vector) == dim)).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    name = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    start = kept.orderBy(name.asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    centroids = whole(np.array([r["v"] for r in start], dtype=np.float64), scale)
    k = len(centroids)
    sums, drift = np.zeros((k, dim + 1), dtype=object), np.zeros(k)
    state = staged(arrow_map(kept, partial(_first, centroids=centroids, scale=scale, block=block), _STATE), "heap-blocks")
    for _ in range(rounds):
        changes = arrow_map(state.select("moved"), partial(_moves, k=k, dim=dim), "cluster int, axis int, total long")
        for r in changes.groupBy("cluster", "axis").agg(F.sum("total").alias("total")).collect():
            sums[r["cluster"], r["axis"]] += r["total"]
        new = centroids.copy()
        for c in range(k):
            if sums[c, dim]:
                new[c] = [s // sums[c, dim] for s in sums[c, :dim]]
        drift += moved(centroids, new)
        centroids = new
        state = staged(arrow_map(state, partial(_next, centroids=centroids, drift=drift.copy(), dim=dim), _STATE), "heap-blocks")
    out = staged(arrow_map(state, partial(_assigned, centroids=centroids, dim=dim), "id long, cluster int, distance long"), "clusters")
    # One row per centroid.
    totals = {r["cluster"]: r["total"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, t, digest[c]) for c, t in sorted(totals.items())]
    known = spark.createDataFrame(facts, "c int, cluster_inertia long, centroid_sha256 string")
    # At most k rows, whatever the input.
    joined = out.join(F.broadcast(known), F.col("cluster") == F.col("c"))
    return joined.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
        F.lit(sum(totals.values())).cast("long").alias("inertia"), "centroid_sha256",
    )

