"""Whitening with eigenvectors found by contour integration (FEAST).

Spark gathers exact sums first and the covariance of the centred vectors second; both are as large as one vector and
its square, whatever the number of rows. The eigenvalues wanted lie in intervals of the spectrum. An interval's
eigenvectors are what a rational filter leaves of a random block: the filter is the quadrature of the resolvent along
a circle around the interval, one solve with a complex shift of the covariance per node. A Rayleigh-Ritz step on the
filtered block gives eigenvalues and vectors, and filtering repeats until their residuals vanish. Counts of
positive pivots at both ends of an interval (Sylvester's law of inertia) say how many eigenvalues it holds; a block
that found fewer is enlarged and filtered again.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, tuned
from spendlake.llm.vectors import finite, matrices

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Nodes on the upper half of a circle.
NODES = 8
#: Eigenvalues below this share of the trace are noise of rounding; they are no components.
LEAST = 1e-13
_EXACT = 1 << 62


def shifted(m: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) + SHIFT as integers."""
    x = np.floor(m * scale) + SHIFT
    if len(x) and np.abs(x).max() > 1 << 50:
        raise ArithmeticError(f"components above {(1 << 50) / scale} have no exact sums")
    return x.astype(np.int64)


# --- inertia and intervals

def inertia(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above ``shift``: positive ones among the pivots of its elimination.

    Pivots are the largest diagonal entry, or a pair of rows around the largest other entry where that is far
    larger; such a pair has one eigenvalue of each sign.
    """
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, 0)
        p = int(diagonal.argmax())
        i, j = divmod(int(size.argmax()), len(a))
        if diagonal[p] >= 0.64 * size[i, j]:
            if not diagonal[p]:
                break
            positive += int(a[p, p] > 0)
            pivot = [p]
        else:
            positive += 1
            pivot = [i, j]
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return positive


def bound(v: np.ndarray) -> float:
    """No eigenvalue is larger: the largest row sum of absolute values."""
    return float(np.abs(v).sum(axis=1).max(initial=0.0))


def lower_end(v: np.ndarray, wanted: int) -> float:
    """A shift with at least ``wanted`` eigenvalues above it, and as few more as bisection can tell apart.

    It lies between two eigenvalues, away from both, where they differ.
    """
    high = bound(v) * (1 + 1e-9)
    low = -high * 1e-3
    for _ in range(60):
        middle = (low + high) / 2
        if inertia(v, middle) >= wanted:
            low = middle
        else:
            high = middle
    # ``low`` is just below the last wanted eigenvalue; the next smaller one ends the free room below it.
    count, room = inertia(v, low), max(1e-12 * bound(v), high - low)
    while low - 2 * room > -bound(v) * 1e-3 and inertia(v, low - 2 * room) == count:
        room *= 2
    return low - room


def intervals(v: np.ndarray, low: float, high: float, most: int = 4) -> list[tuple[float, float, int]]:
    """Parts of (low, high] and their eigenvalue counts, cut until each is narrow and holds few, or cannot be told apart.

    Cuts keep away from eigenvalues, where rounding would decide on which side one lies.
    """
    clear = 1e-12 * bound(v)
    out, todo = [], [(low, high, inertia(v, low), inertia(v, high))]
    while todo:
        a, b, above_a, above_b = todo.pop()
        count = above_a - above_b
        if not count:
            continue
        if b - a <= 1e4 * clear or count <= most and b - a <= 0.2 * abs(b):
            out.append((a, b, count))
            continue
        for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
            middle = a + part * (b - a)
            above = inertia(v, middle - clear)
            if above == inertia(v, middle + clear):
                break
        todo += [(a, middle, above_a, above), (middle, b, above, above_b)]
    return sorted(out)


# --- contour integration

def nodes(a: float, b: float, count: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes of the upper half circle over (a, b) and their weights in the filter."""
    x, w = np.polynomial.legendre.leggauss(count)
    angle = np.pi / 2 * (1 - x)
    radius = (b - a) / 2
    return (a + b) / 2 + radius * np.exp(1j * angle), w / 2 * radius * np.exp(1j * angle)


def filtered(v: np.ndarray, block: np.ndarray, a: float, b: float) -> np.ndarray:
    """The block projected onto eigenvectors with eigenvalues in (a, b): the real part of the contour integral."""
    out = np.zeros_like(block)
    for z, w in zip(*nodes(a, b)):
        out += (w * np.linalg.solve(z * np.eye(len(v)) - v, block.astype(complex))).real
    return out


def rayleigh_ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best eigenvalues and unit vectors within the span of the block."""
    q, r = np.linalg.qr(block)
    values, vectors = np.linalg.eigh(q.T @ v @ q)
    return values, q @ vectors


def interval_pairs(v: np.ndarray, a: float, b: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with eigenvalues in (a, b]; the block grows until none is missing."""
    rng, d, size = np.random.default_rng(seed), len(v), bound(v)
    # The circle is a little wider than its interval, so that an eigenvalue at an end is well inside.
    pad = (b - a) * 0.05
    width = min(d, 2 * count + 4)
    while True:
        block, settled = rng.normal(size=(d, width)), False
        for _ in range(60):
            values, vectors = rayleigh_ritz(v, filtered(v, block, a - pad, b + pad))
            inside = (values > a) & (values <= b)
            residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if settled and inside.sum() == count:
                return values[inside], vectors[:, inside]
            # Once residuals are down to rounding, one more step takes off what is left.
            settled = inside.sum() == count and bool((residual <= 1e-14 * d * size).all())
            block = vectors
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues expected in an interval, {int(inside.sum())} settled")
        width = min(d, 2 * width)


def principal(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; fewer where the rank is lower."""
    d, trace = len(v), float(np.trace(v))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    wanted = min(wanted, d, inertia(v, LEAST * trace))
    if not wanted:
        return np.zeros(0), np.zeros((d, 0))
    low, high = max(lower_end(v, wanted), LEAST * trace / 2), bound(v) * (1 + 1e-9)
    parts = [interval_pairs(v, a, b, n, seed=k) for k, (a, b, n) in enumerate(intervals(v, low, high))]
    found = sum(len(e) for e, _ in parts)
    if found != inertia(v, low) - inertia(v, high):
        raise ArithmeticError("the intervals miss eigenvalues")
    # Vectors of neighbouring intervals are made orthogonal to rounding by one more step over all of them.
    values, vectors = rayleigh_ritz(v, np.concatenate([x for _, x in parts], axis=1))
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# --- passes over the rows

def _sums(batches, dim, scale):
    total, n = np.zeros(dim, dtype=object), 0
    for batch in batches:
        for _, m in matrices(batch.column("v")):
            total, n = total + shifted(m, scale).sum(axis=0).astype(object), n + len(m)
    if n:
        yield pa.RecordBatch.from_pydict({"axis": list(range(dim)), "total": [str(t) for t in total], "n": [n] * dim})


def _products(batches, middle, rest, scale):
    """Sums of products of centred components: exact integers are centred at an integer, then the rest is taken off."""
    total = None
    for batch in batches:
        for _, m in matrices(batch.column("v")):
            y = (shifted(m, scale) - middle).astype(np.float64) - rest
            total = y.T @ y + (0 if total is None else total)
    if total is not None:
        for k, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"axis": [k], "row": pa.array([row.tolist()], pa.list_(pa.float64()))})


def _projection(m, middle, rest, axes, scale):
    x = shifted(m, scale)
    return x, ((x - middle).astype(np.float64) - rest) @ axes


def _second(batches, **fit):
    """Sums and products of whitened components over this task's rows."""
    count = fit["axes"].shape[1]
    total, products, n = np.zeros(count), np.zeros((count, count)), 0
    for batch in batches:
        for _, m in matrices(batch.column("v")):
            w = _projection(m, **fit)[1]
            total, products, n = total + w.sum(axis=0), products + w.T @ w, n + len(w)
    if n:
        yield pa.RecordBatch.from_pydict(
            {"axis": list(range(count)), "total": total.tolist(), "row": pa.array(products.tolist(), pa.list_(pa.float64()))}
        )


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 over the components of every row, exactly; null where it has no long."""
    low, high = x.min(axis=0, initial=0).astype(object), x.max(axis=0, initial=0).astype(object)
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums))
    if most < _EXACT and max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0)) < _EXACT:
        y = x * n - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


_OUT = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
     ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def _whitened(batches, n, sums, explained, error, **fit):
    count = len(explained)
    for batch in batches:
        for rows, m in matrices(batch.column("v")):
            x, w = _projection(m, **fit)
            ids = batch.column("id").take(pa.array(np.repeat(rows, count)))
            far = np.repeat(np.arange(len(rows)), count)
            values = [
                ids, pa.array(np.tile(np.arange(1, count + 1), len(rows)), pa.int32()), pa.array(np.full(len(far), n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(far)), pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(far), error)),
            ]
            yield pa.RecordBatch.from_arrays(values, schema=_OUT)


def _added(parts: DataFrame, name: str, size: int) -> np.ndarray:
    """Rows of a matrix, each the sum over all tasks; ``size`` rows reach the driver."""
    sums = [F.sum(F.get(name, F.lit(k))).alias(str(k)) for k in range(size)]
    out = np.zeros((size, size))
    for r in parts.groupBy("axis").agg(*sums).collect():
        out[r["axis"]] = r[1:]
    return out


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    A component x of a vector counts as floor(scale * x) + SHIFT. Usable are vectors that are not null or empty and
    hold no null or non-finite component; of several lengths the commonest (the longer of equally common ones) is used,
    since no covariance joins two. Rows without an id and repeated rows count as rows. Where the covariance has a lower
    rank, there are fewer components; with one distinct vector there is none and the result is empty, as it is for an
    empty table. ``deviation`` is null where its exact value has no long. Other columns are not read.
    """
    spark = tuned(rows.sparkSession)
    vector = F.col(vector_col)
    usable = rows.where(finite(vector)).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = int(lengths["d"]), int(lengths["count"])
    fit_rows = usable.where(F.size("v") == dim)
    parts = arrow_map(fit_rows, partial(_sums, dim=dim, scale=scale), "axis long, total string, n long")
    sums = [0] * dim
    for r in parts.groupBy("axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        sums[r["axis"]] = int(r["total"])
    middle = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    products = arrow_map(fit_rows, partial(_products, middle=middle, rest=rest, scale=scale), "axis long, row array<double>")
    v = _added(products, "row", dim) / n
    v = (v + v.T) / 2
    values, vectors = principal(v, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    fit = {"middle": middle, "rest": rest, "axes": vectors / np.sqrt(values), "scale": scale}
    second = arrow_map(fit_rows, partial(_second, **fit), "axis long, total double, row array<double>")
    count = len(values)
    moments = second.groupBy("axis").agg(F.sum("total").alias("total"), *[F.sum(F.get("row", F.lit(k))).alias(f"p{k}") for k in range(count)])
    mean, products = np.zeros(count), np.zeros((count, count))
    for r in moments.collect():
        mean[r["axis"]], products[r["axis"]] = r["total"] / n, r[2:]
    error = float(np.abs(products / n - np.outer(mean, mean) - np.eye(count)).max())
    explained = values / np.trace(v)
    return arrow_map(fit_rows, partial(_whitened, n=n, sums=sums, explained=explained, error=error, **fit), schema)
