"""Removal of long repeated byte strings by sparse prefix doubling.

Ranking every byte position at 1, 2, 4, ... bytes moves the corpus once per byte and round. Here positions are first
sampled: every 200-byte window has one anchor, the place in it with the smallest hash of 32 bytes, which equal windows
share. Spark ranks anchors by their 32 bytes; those with a unique rank leave with all windows they anchor. Windows of
an anchor share the bytes between the last start and the first end, so a range of windows is ranked by that core. Each
round re-ranks what is left by a longer core, which halves the range: cores grow from 32 towards 200 bytes, unique
ranks leave, and at 200 bytes the rank is the window's. Ranks that few distinct contexts share are settled at once, in
one task, by the hashes of all their windows; only larger ones go on to the next round, so no task gathers a hot rank.
Copies of one context are one row from the start.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.anchors import SEGMENT, ByteHasher, window_anchors
from spendlake.llm.bloom import held, may_hold
from spendlake.llm.common import arrow_map, scratch_path, staged, text_hash, tuned

WINDOW, GRAM = 200, 32
#: Distinct contexts of one rank that a task settles at once; larger ranks are ranked again.
SETTLED = 4096


def _segments(text: bytes, window: int):
    """(offset, bytes) of a text, cut so that every window lies in one segment."""
    data = np.frombuffer(text, dtype=np.uint8)
    at = 0
    while at == 0 or at + window <= len(data):
        yield at, data[at : at + SEGMENT]
        at += SEGMENT - window + 1


_GRAMS = pa.schema([("gram", pa.int64())])


def _grams(batches, window, gram):
    """Gram hashes of all anchors, in chunks."""
    for batch in batches:
        out = []
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text and len(text) >= window:
                for _, data in _segments(text, window):
                    out.append(window_anchors(ByteHasher(data), window, gram)[3])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], schema=_GRAMS)


_ANCHORS = pa.schema(
    [("gram", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()),
     ("reach", pa.int32()), ("bytes", pa.binary())]
)


def _anchors(batches, window, gram, bits):
    """Anchors whose gram may repeat, each with the bytes of its windows."""
    known = bits.value
    for batch in batches:
        columns, size = [[] for _ in _ANCHORS], 0
        ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, th, text in zip(ids, hashes, batch.column(2).cast(pa.binary()).to_pylist()):
            if not text or len(text) < window:
                continue
            for at, data in _segments(text, window):
                hasher = ByteHasher(data)
                anchor, first, last, g = window_anchors(hasher, window, gram)
                g = g.view(np.int64)
                ok = held(known, g)
                if not ok.any():
                    continue
                anchor, first, last, g = anchor[ok], first[ok], last[ok], g[ok]
                reach = anchor - first
                with np.errstate(over="ignore"):
                    context = (hasher.of(first, last + window) * np.uint64(2 * window + 1) + reach.astype(np.uint64)).view(np.int64)
                raw = data.tobytes()
                n = len(g)
                for c, v in zip(columns, (g, context, [doc] * n, [th] * n, first + at, last - first + 1, reach)):
                    c.extend(v if isinstance(v, list) else v.tolist())
                columns[-1].extend([raw[a:b] for a, b in zip(first.tolist(), (last + window).tolist())])
                size += n
            if size > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANCHORS)], schema=_ANCHORS)
                columns, size = [[] for _ in _ANCHORS], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANCHORS)], schema=_ANCHORS)


def _picked(batches, bits):
    for batch in batches:
        ok = held(bits.value, batch.column(0).to_numpy())
        if ok.any():
            yield batch.filter(pa.array(ok))


_UNIT = pa.schema(
    [("rank", pa.int64()), ("context", pa.int64()), ("lead", pa.int32()), ("windows", pa.int32()), ("skip", pa.int32()), ("copies", pa.int64()),
     ("bytes", pa.binary())]
)


def _ranked(batches, width, window):
    """Rows of (context, lead, windows, skip, copies, bytes), cut by distance to the anchor, with their core's rank.

    ``lead`` is the distance from a row's first window to the anchor and ``skip`` its place among the windows of the
    context. A piece holds the windows whose distance lies in one multiple of ``width``; its core is what all windows
    of that multiple share.
    """
    for batch in batches:
        columns = [[] for _ in _UNIT]
        rows = zip(*(batch.column(k).to_pylist() for k in ("context", "lead", "windows", "skip", "copies", "bytes")))
        for context, lead, windows, skip, copies, data in rows:
            low = lead - windows + 1
            for part in range(low // width, lead // width + 1):
                far, near = min(lead, part * width + width - 1), max(low, part * width)
                # Windows from distance `far` down to `near`; the core of the whole multiple lies inside each.
                start = lead - far
                core_start = lead - part * width
                core_stop = lead - (part * width + width - 1) + window
                core = hashlib.blake2b(data[core_start:core_stop] + part.to_bytes(4, "little"), digest_size=8).digest()
                piece = data[start : lead - near + window]
                values = (int.from_bytes(core, "little", signed=True), context, far, far - near + 1, skip + start, copies, piece)
                for c, v in zip(columns, values):
                    c.append(v)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNIT)], schema=_UNIT)


_RANGES = pa.schema([("context", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32())])


def _settle(batches, window):
    """Units sorted by rank: windows of each rank that occur in two contexts or copies."""

    def ranks():
        rank, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("rank", "context", "lead", "windows", "skip", "copies", "bytes"))):
                if row[0] != rank:
                    if rows:
                        yield rows
                    rank, rows = row[0], []
                rows.append(row[1:])
        if rows:
            yield rows

    out: list[tuple[int, int, int]] = []
    held_rows, held_bytes = [], 0

    def close():
        """One pass over many ranks: windows are equal only within a rank."""
        data = np.frombuffer(b"".join(r[5] for rows in held_rows for r in rows), dtype=np.uint8)
        flat = [(k, r) for k, rows in enumerate(held_rows) for r in rows]
        lengths = np.array([len(r[5]) for _, r in flat])
        counts = np.array([r[2] for _, r in flat])
        base = np.repeat(np.r_[0, lengths.cumsum()[:-1]], counts)
        step = np.arange(counts.sum()) - np.repeat(np.r_[0, counts.cumsum()[:-1]], counts)
        row = np.repeat(np.arange(len(flat)), counts)
        start = base + step
        h = ByteHasher(data).of(start, start + window)
        with np.errstate(over="ignore"):
            h = h ^ (np.array([k for k, _ in flat], dtype=np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15))
        distance = np.array([r[1] for _, r in flat])[row] - step
        with np.errstate(over="ignore"):
            h = h + distance.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        copies = np.array([r[4] for _, r in flat])
        seen = np.bincount(at, weights=np.minimum(copies, 2)[row], minlength=len(n))
        again = (seen[at] >= 2) & (copies[row] == 1)
        edge = np.flatnonzero(again[1:] & again[:-1] & (row[1:] == row[:-1]))
        head = np.setdiff1d(np.flatnonzero(again), edge + 1, assume_unique=True)
        tail = np.setdiff1d(np.flatnonzero(again), edge, assume_unique=True)
        for a, b in zip(head.tolist(), tail.tolist()):
            context, skip = flat[row[a]][1][0], flat[row[a]][1][3]
            out.append((context, skip + int(step[a]), skip + int(step[b]) + 1))

    for rows in ranks():
        size = sum(len(r[5]) for r in rows)
        if held_rows and held_bytes + size >= SEGMENT:
            close()
            held_rows, held_bytes = [], 0
        # A rank too large for one pass goes through in slices by window distance, which equal windows share.
        if size >= SEGMENT:
            for piece in _slices(rows, window):
                held_rows, held_bytes = [piece], 0
                close()
            held_rows = []
        else:
            held_rows.append(rows)
            held_bytes += size
        if len(out) > 20_000:
            yield _range_batch(out)
            out.clear()
    if held_rows:
        close()
    if out:
        yield _range_batch(out)


def _slices(rows, window):
    """Parts of a large rank's rows in which all windows stand equally far from the anchor, cut to fit one pass."""
    top = max(r[1] for r in rows)
    fit = max(1, SEGMENT // len(rows) - window)
    for low in range(0, top + 1, fit):
        part = []
        for context, lead, windows, skip, copies, data in rows:
            far, near = min(lead, low + fit - 1), max(lead - windows + 1, low)
            if far >= near:
                part.append((context, far, far - near + 1, skip + lead - far, copies, data[lead - far : lead - near + window]))
        if part:
            yield part


def _range_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RANGES)], schema=_RANGES)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, th, spans``: per document with repeated windows the byte ranges they cover, unmerged."""
    spark = docs.sparkSession
    grams = arrow_map(docs.select("text"), partial(_grams, window=window, gram=gram), "gram long")
    again = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    bits = spark.sparkContext.broadcast(may_hold(again))
    fields = "gram long, context long, doc_id long, th long, first long, windows int, reach int, bytes binary"
    anchors = arrow_map(docs.select("doc_id", "th", "text"), partial(_anchors, window=window, gram=gram, bits=bits), fields)
    path = scratch_path(spark, "repeat-anchors")
    anchors.write.option("compression", "zstd").parquet(path)
    anchors = spark.read.schema(fields).parquet(path)
    # One occurrence stands for each context; its bytes are fetched only if another context shares its gram.
    keyed = anchors.withColumn("key", F.xxhash64("context", "doc_id", "th", "first"))
    contexts = staged(
        keyed.groupBy("context").agg(
            F.first("gram").alias("gram"), F.first("reach").alias("lead"), F.first("windows").alias("windows"), F.min("key").alias("key"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "repeat-contexts",
    )
    shared = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least")).where("n > 1 AND least = 1")
    asked = contexts.join(shared.select("gram"), "gram", "left_semi").select("key", "context", "lead", "windows", F.lit(0).alias("skip"), "copies")
    asked = staged(asked, "repeat-asked")
    chosen = spark.sparkContext.broadcast(may_hold(asked.select("key")))
    picked = arrow_map(keyed.select("key", "bytes"), partial(_picked, bits=chosen), "key long, bytes binary")
    units = picked.join(asked, "key").select("context", "lead", "windows", "skip", "copies", "bytes")
    found = [contexts.where("copies > 1").select("context", F.lit(0).alias("begin"), F.col("windows").alias("stop"))]
    width, unit = (window - gram + 2) // 2, "rank long, context long, lead int, windows int, skip int, copies long, bytes binary"
    while True:
        ranked = staged(arrow_map(units, partial(_ranked, width=width, window=window), unit), "repeat-units")
        sizes = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"))
        sizes = staged(sizes.where("n > 1 AND least = 1").select("rank", "n"), "repeat-ranks")
        if width == 1:
            # The core is the window: sharing the rank is being equal.
            whole = ranked.where("copies = 1").join(sizes, "rank", "left_semi")
            found.append(whole.select("context", F.col("skip").alias("begin"), (F.col("skip") + 1).alias("stop")))
            break
        small = ranked.join(sizes.where(F.col("n") <= SETTLED).select("rank"), "rank", "left_semi")
        small = small.repartition("rank").sortWithinPartitions("rank", "context")
        found.append(staged(arrow_map(small, partial(_settle, window=window), "context long, begin int, stop int"), "repeat-ranges"))
        large = sizes.where(F.col("n") > SETTLED)
        if not large.limit(1).count():
            break
        units = ranked.join(large.select("rank"), "rank", "left_semi").drop("rank")
        width = (width + 1) // 2
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    ranges = ranges.groupBy("context").agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))
    # A context of many copies is a hot key on the left only; the join splits it.
    spans = anchors.select("context", "doc_id", "th", "first").join(ranges, "context")
    spans = spans.select(
        "doc_id", "th",
        F.explode(
            F.transform(
                "ranges", lambda r: F.struct((F.col("first") + r["begin"]).alias("a"), (F.col("first") + r["stop"] - 1 + window).alias("b"))
            )
        ).alias("s"),
    )
    return spans.groupBy("doc_id", "th").agg(F.collect_list("s").alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    """Union of byte ranges as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_CUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
)


def _cut(batches):
    for batch in batches:
        rows, size = [], 0
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            text, runs = text or b"", _merged(spans)
            edges = [0, *(e for r in runs for e in r), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc, len(text), len(text) - len(kept), [list(r) for r in runs], kept))
            size += len(kept) + 64
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, removed, kept``.

    ``removed`` lists the maximal runs [begin, stop) of bytes that lie in a string of ``window`` bytes which also
    starts anywhere else in the corpus, in the same document too; ``kept`` are the other bytes. Texts are UTF-8; null
    and shorter texts lose nothing. Repeated rows repeat each other. Other columns are not read; an empty table gives
    no rows.
    """
    tuned(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("th", text_hash(F.col("text")))
    spans = repeated_windows(base, window, gram).withColumnsRenamed({"doc_id": "sd", "th": "st"})
    rows = base.join(spans, base["doc_id"].eqNullSafe(spans["sd"]) & (base["th"] == spans["st"]), "left")
    out = "doc_id long, n_bytes long, n_removed long, removed array<array<long>>, kept binary"
    return arrow_map(rows.select("doc_id", "text", "spans"), _cut, out)


def removal_digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
