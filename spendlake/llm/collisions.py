"""Near duplicates among embeddings by counting collisions of one-dimensional projections.

Vectors are sorted along many random directions. Two vectors collide on an order if one lies in the window that is
centred on the other. Linked vectors are close, so they collide on most orders; the number of collisions a pair has
to reach is calibrated so that a pair at the very threshold is missed less often than ``miss``.

One window of a single direction holds a fifth of all vectors whatever their number. Each order therefore runs within
cells of a few further random directions, more of them the larger the largest label is, and calibration counts the
cells in. No pair is listed: a task that holds two vectors knows their collisions on all orders from their
projections, and the first order on which they collide decides about them. It verifies passing pairs by their cosine
and returns one count per vector and links that span what it found.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from spendlake.llm.bloom import held, may_hold
from spendlake.llm.common import arrow_map, spread_join, staged, tuned
from spendlake.llm.components import components
from spendlake.llm.vectors import finite, matrices
from spendlake.llm.words import mix

COSINE = 0.98
#: Share of the pairs at the threshold that may be missed, and vectors of a cell that the number of cells aims at.
MISS, CELL = 1e-6, 1024
#: Vectors of one label and cell that are compared at once, about; larger cells are cut into parts that meet two by two.
PART = 1024
#: Width of a cell and half a window, in units of 1 / sqrt(dimensions) and of the largest distance over that.
WIDTH, WINDOW = 2.0, 2.0

_SEED = 20240611
_POINT = pa.schema(
    [("key", pa.int64()), ("s", pa.float64()), ("ord", pa.int32()), ("cls", pa.int64()), ("node", pa.int64()),
     ("mult", pa.int64()), ("v", pa.binary())]
)
_FOUND = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def reach(cosine: float) -> float:
    """Largest distance of linked unit vectors."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


@lru_cache(maxsize=64)
def chances(dim: int, cells: int, cosine: float) -> tuple[float, float]:
    """Chance that a pair at the threshold collides on an order, and that unrelated vectors share one cell interval."""
    rng = np.random.default_rng(_SEED)
    axes = min(cells + 1, dim)
    g = rng.normal(size=(50_000, axes))
    rest = rng.chisquare(dim - axes, size=len(g)) if dim > axes else 0.0
    unit = np.abs(g) / np.sqrt((g**2).sum(axis=1) + rest)[:, None]
    width = WIDTH / math.sqrt(dim)
    near = unit * reach(cosine)
    stay = np.prod(np.maximum(0, 1 - near[:, : axes - 1] / width), axis=1) * (near[:, -1] <= half_window(dim, cosine))
    apart = np.maximum(0, 1 - unit[:, 0] * math.sqrt(2) / width)
    return float(stay.mean()), float(apart.mean())


def half_window(dim: int, cosine: float) -> float:
    return WINDOW * reach(cosine) / math.sqrt(dim)


def calibrated(dim: int, cells: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Fewest orders, and the most collisions to ask for (two at least), that miss a pair at the threshold no oftener."""
    p, _ = chances(dim, cells, cosine)
    orders = 2
    while True:
        total, needed = 0.0, 0
        for k in range(orders):
            total += math.comb(orders, k) * p**k * (1 - p) ** (orders - k)
            if total > miss:
                break
            needed = k + 1
        if needed >= 2:
            return orders, needed
        orders += 1


def cells_for(dim: int, vectors: int, cosine: float, cell: int = CELL) -> int:
    """Directions that cut ``vectors`` unrelated vectors into cells of about ``cell``."""
    _, shared = chances(dim, 0, cosine)
    k = math.ceil(math.log(max(1.0, vectors / cell)) / -math.log(shared))
    return min(k, max(0, dim - 1))


@lru_cache(maxsize=8)
def directions(dim: int, cells: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (dim, orders, cells + 1) and the shifts of the cells."""
    rng = np.random.default_rng((_SEED, dim))
    axes = np.stack([np.linalg.qr(rng.normal(size=(dim, cells + 1)))[0] for _ in range(orders)], axis=1)
    return axes, rng.random((orders, cells)) * WIDTH / math.sqrt(dim)


def projected(unit: np.ndarray, cells: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and order the hash of its cell and its place along the order."""
    dim = unit.shape[1]
    axes, shifts = directions(dim, cells, orders)
    at = np.einsum("nd,dok->nok", unit, axes, optimize=True)
    cut = np.floor((at[:, :, :-1] + shifts) / (WIDTH / math.sqrt(dim))).astype(np.int64).astype(np.uint64)
    h = np.zeros(at.shape[:2], dtype=np.uint64)
    for k in range(cells):
        h = mix(h * np.uint64(3) + cut[:, :, k] + np.uint64(1))
    return h, at[:, :, -1]


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a length at all; huge and tiny components are scaled first."""
    top = np.abs(m).max(axis=1, initial=0.0)
    ok = top > 0
    m = m[ok] / top[ok][:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None], ok


def _shape(dim: int, largest: int, cosine: float, miss: float, cell: int) -> tuple[int, int, int]:
    cells = cells_for(dim, largest, cosine, cell)
    return cells, *calibrated(dim, cells, cosine, miss)


def _placed(batches, **shape):
    """Per batch, vector length and order: (order, batch, rows, matrix, keys of their cells, places)."""
    for batch in batches:
        label = batch.column("label").to_numpy().astype(np.int64).astype(np.uint64)
        for rows, m in matrices(batch.column("v")):
            unit, ok = unit_rows(m)
            rows, m = rows[ok], m[ok]
            cells, orders, _ = _shape(m.shape[1], **shape)
            h, s = projected(unit, cells, orders)
            for o in range(orders):
                key = mix(mix(mix(h[:, o] + np.uint64(o)) ^ label[rows]) + np.uint64(m.shape[1])).astype(np.int64)
                yield o, batch, rows, m, key, s[:, o]


def _keys(batches, **shape):
    for _, _, _, _, key, _ in _placed(batches, **shape):
        yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])


def _points(batches, bits, hot, dtype, **shape):
    """Every vector once per order: those whose cell may be a full one, or those whose cell cannot."""
    for o, batch, rows, m, key, s in _placed(batches, **shape):
        keep = np.flatnonzero(held(bits.value, key) == hot)
        if len(keep):
            at = rows[keep]
            cols = [key[keep], s[keep], np.full(len(keep), o), *(batch.column(c).to_numpy()[at] for c in ("cls", "node", "mult")),
                    [x.tobytes() for x in m[keep].astype(dtype)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _POINT)], schema=_POINT)


class _Group:
    """Vectors of one label and cell (or of two parts of it), sorted along the order."""

    def __init__(self, order: int, s, cls, node, mult, v, part, cross: bool, dtype: str, **shape):
        self.order, self.cls, self.node, self.mult, self.part, self.cross = order, cls, node, mult, part, cross
        self.raw = np.frombuffer(b"".join(v), dtype=dtype).reshape(len(v), -1).astype(np.float64)
        self.unit, _ = unit_rows(self.raw)
        self.cosine = cosine = shape["cosine"]
        dim = self.raw.shape[1]
        cells, orders, self.needed = _shape(dim, **shape)
        self.window = half_window(dim, cosine)
        self.h, self.s = projected(self.unit, cells, orders)

    def links(self, step: int = 256):
        """Pairs (rows) that reach the count, collide here first, and are close enough."""
        n, along = len(self.s), self.s[:, self.order]
        for a in range(0, n, step):
            b = min(n, a + step)
            # Rows up to the far end of the last row's window; earlier rows have met these already.
            end = int(np.searchsorted(along, along[b - 1] + self.window + 1e-12, side="right"))
            q, c = slice(a, b), slice(a, end)
            count = np.zeros((b - a, end - a), dtype=np.uint8 if self.s.shape[1] < 256 else np.uint16)
            first = np.full(count.shape, True)
            for o in range(self.s.shape[1]):
                met = self.h[q, o][:, None] == self.h[c, o][None, :]
                met &= np.abs(self.s[q, o][:, None] - self.s[c, o][None, :]) <= self.window
                count += met
                if o < self.order:
                    first &= ~met
                elif o == self.order:
                    first &= met
            pass_ = first & (count >= self.needed)
            pass_ &= np.arange(a, end)[None, :] > np.arange(a, b)[:, None]
            if self.cross:
                pass_ &= self.part[q][:, None] != self.part[c][None, :]
            if not pass_.any():
                continue
            cos = self.unit[q] @ self.unit[c].T
            i, j = np.nonzero(pass_ & (cos >= self.cosine - 1e-9))
            close, i, j = cos[i, j], i + a, j + a
            edge = np.flatnonzero(close < self.cosine + 1e-9)
            if len(edge):
                x, y = self.raw[i[edge]], self.raw[j[edge]]
                close[edge] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            keep = close >= self.cosine
            yield i[keep], j[keep]

    def found(self):
        """Links per vector, weighted by copies, and links that span the components of this group."""
        count, up, span = np.zeros(len(self.cls), dtype=np.int64), {}, []

        def top(v):
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        for i, j in self.links():
            np.add.at(count, i, self.mult[j])
            np.add.at(count, j, self.mult[i])
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = top(x), top(y)
                if p != q:
                    up[p] = q
                    span.append((int(self.node[x]), int(self.node[y])))
        return count, span


def _counted(batches, dtype, **shape):
    """Rows sorted by group and place: counts per vector and spanning links."""
    held_rows, key = [], None

    def close():
        if len(held_rows) < 2:
            return None
        s, order, cls, node, mult, v, lo, hi, part = zip(*held_rows)
        whole = lambda x: np.array(x, dtype=np.int64)
        group = _Group(order[0], s, whole(cls), whole(node), whole(mult), v, whole(part), lo[0] != hi[0], dtype, **shape)
        count, span = group.found()
        at = np.flatnonzero(count)
        if not len(at):
            return None
        pad = [None] * len(span)
        return pa.RecordBatch.from_arrays(
            [pa.array([*group.cls[at].tolist(), *pad], pa.int64()), pa.array([*count[at].tolist(), *pad], pa.int64()),
             pa.array([None] * len(at) + [x for x, _ in span], pa.int64()),
             pa.array([None] * len(at) + [y for _, y in span], pa.int64())],
            schema=_FOUND,
        )

    names = ("s", "ord", "cls", "node", "mult", "v", "lo", "hi", "part")
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *names))):
            if (own := (k, row[1], row[6], row[7])) != key:
                if (out := close()) is not None:
                    yield out
                key, held_rows = own, []
            held_rows.append(row)
    if (out := close()) is not None:
        yield out


def _parted(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Rows of full cells, once per pair of parts that theirs belongs to; other rows as they are."""
    out = spread_join(rows, full, ["key"], F.xxhash64("cls"), "left")
    part = F.pmod(F.xxhash64("cls", F.lit(7)), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    out = out.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return out.select(*[f.name for f in _POINT], F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, miss: float = MISS, cell: int = CELL, part: int = PART,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors with equal labels, both not null, link when their cosine in double precision is at least ``cosine``.
    ``n_links`` counts the other vectors linked directly, ``component_id`` is the smallest id reachable, ``kept``
    marks the row that stands for its component. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id or a label, link with nothing and are kept; so do vectors of different lengths.
    Equal vectors of a label are one class with a number of copies. Rows that share an id are one node of the
    graph and each count as a link. Other columns are not read; an empty table gives an empty result.
    """
    spark = tuned(rows.sparkSession)
    vector = F.col(vector_col)
    usable = finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    slim = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("v"),
        F.coalesce(usable, F.lit(False)).alias("ok"),
    )
    named = slim.where("ok").select("id", "label", "v", F.xxhash64("label", "v").alias("cls"))
    classes = staged(
        named.groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("mult"), F.first("cls").alias("cls")),
        "vector-classes",
    )
    sizes = classes.groupBy("label").count().agg(F.max("count").alias("most")).first()
    shape = {"largest": int(sizes["most"] or 0), "cosine": cosine, "miss": miss, "cell": cell}
    points = "key long, s double, ord int, cls long, node long, mult long, v binary"
    dtype = "<f4" if isinstance(rows.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    keys = arrow_map(classes, partial(_keys, **shape), "key long")
    full = keys.groupBy("key").count().where(F.col("count") > part)
    full = staged(full.select("key", F.ceil(2 * F.col("count") / part).cast("int").alias("parts")), "vector-cells")
    bits = spark.sparkContext.broadcast(may_hold(full.select("key")))
    common = arrow_map(classes, partial(_points, bits=bits, hot=False, dtype=dtype, **shape), points)
    hot = arrow_map(classes, partial(_points, bits=bits, hot=True, dtype=dtype, **shape), points)
    zero = F.lit(0).alias
    dealt = common.select("*", zero("lo"), zero("hi"), zero("part")).unionByName(_parted(hot, full))
    dealt = dealt.repartition("key", "ord", "lo", "hi").sortWithinPartitions("key", "ord", "lo", "hi", "s")
    found = staged(arrow_map(dealt, partial(_counted, dtype=dtype, **shape), "cls long, links long, a long, b long"), "vector-links")

    counts = found.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    repeated = named.groupBy("id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("id")
    same = named.join(repeated, "id").join(classes.select("cls", "node"), "cls").select(F.col("id").alias("a"), F.col("node").alias("b"))
    graph = components(found.where("a IS NOT NULL").select("a", "b").unionByName(same))
    state = classes.select("cls", "node", "mult").join(counts, "cls", "left")
    state = state.join(graph.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("root", "node").alias("root")
    )
    keyed = slim.select("id", F.when(F.col("ok"), F.xxhash64("label", "v")).alias("cls"), "ok")
    linked = spread_join(keyed, state, ["cls"], F.xxhash64("id"), "left")
    root = F.coalesce("root", "id")
    return linked.select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
        F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"),
    )
