"""Harmonic sequence packing of tokenised documents.

Lengths fall into reciprocal-capacity classes: class i holds pieces of at most capacity / i tokens, and a sequence of
that class always takes exactly i of them. A document is cut into full sequences, then into the powers of two of what
is left, down to ``SMALLEST``, and the rest; so the large classes fill their sequences completely. Which sequence a
piece goes to follows from its number within its class, and that from its number within its worker and the class
counts of the workers before: workers number their pieces independently, and nothing travels but those counts. The
last, incomplete sequence of each class is at most i - 1 pieces; these few are laid end to end.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, staged, tuned
from spendlake.llm.tokens import encoded, vocabulary_path

CAPACITY, SMALLEST, END_ID = 2048, 64, 1

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
     ("part", pa.int32()), ("at", pa.int64())]
)


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    full, rest = divmod(n, capacity)
    out, size = [capacity] * full, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def _cut(batches, path, end_id, capacity, smallest):
    from pyspark import TaskContext

    part, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
    seen: dict[int, int] = {}
    rows, size = {f.name: [] for f in _PIECES}, 0

    def batch_of():
        out = pa.RecordBatch.from_pydict({k: pa.array(v, _PIECES.field(k).type) for k, v in rows.items()}, schema=_PIECES)
        for v in rows.values():
            v.clear()
        return out

    for batch in batches:
        for doc, ids in zip(batch.column(0).to_pylist(), encoded(path, batch.column(1).to_pylist())):
            ids += end
            n, start = len(ids) // 4, 0
            for length in cuts(n, capacity, smallest):
                at = seen.get(length, 0)
                seen[length] = at + 1
                for k, v in zip(rows, (doc, start, length, n, ids[4 * start : 4 * (start + length)], part, at)):
                    rows[k].append(v)
                start += length
            size += len(ids)
            if size > 4 << 20:
                yield batch_of()
                size = 0
    if rows["doc_id"]:
        yield batch_of()


def pack(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, smallest: int = SMALLEST,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers, ``start`` its place in the document,
    ``offset`` its place in the sequence. Every document ends with ``end_id``, so null and empty texts give that one
    token. Repeated rows are packed once each, null ids stay null, other columns are not read, and an empty table
    gives no pieces.
    """
    tuned(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = partial(_cut, path=path or vocabulary_path(), end_id=end_id, capacity=capacity, smallest=smallest)
    pieces = staged(
        arrow_map(slim, cut, "doc_id long, start long, length int, doc_tokens long, ids binary, part int, at long"), "pieces"
    )
    # Rows of this table: workers times lengths, of which there are fewer than SMALLEST + log2(CAPACITY).
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c"))
    in_class = W.partitionBy("length")
    counts = staged(
        counts.select(
            F.col("part").alias("p"), F.col("length").alias("len"),
            (F.sum("c").over(in_class.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(in_class).alias("total"),
        ),
        "piece-counts",
    )
    numbered = pieces.join(counts, (F.col("part") == F.col("p")) & (F.col("length") == F.col("len"))).withColumn(
        "number", F.col("before") + F.col("at")
    )
    each = F.floor(F.lit(capacity) / F.col("length"))
    full = F.col("number") < F.floor(F.col("total") / each) * each
    out = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    # Sequences of a class are interleaved with those of the others: class lengths are at most the capacity.
    whole = numbered.where(full).select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        (F.floor(F.col("number") / each) * (capacity + 1) + F.col("length")).alias("sequence_id"),
        ((F.col("number") % each) * F.col("length")).cast("long").alias("offset"),
    )
    rest = _rest(numbered.where(~full), capacity)
    return whole.unionByName(rest.select(*out)).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", "sequence_id", "offset"
    )


def _rest(rest: DataFrame, capacity: int) -> DataFrame:
    """The pieces of all incomplete sequences, end to end; a piece that crosses a sequence's end is cut there.

    Fewer than ``capacity * (ln(SMALLEST) + 1)`` pieces whatever the input, so one ordered window is bounded.
    """
    order = W.orderBy(F.col("length").desc(), "number")
    placed = rest.withColumn("stop", F.sum("length").over(order)).withColumn("begin", F.col("stop") - F.col("length"))
    first, last = F.floor(F.col("begin") / capacity), F.floor((F.col("stop") - 1) / capacity)
    placed = placed.withColumn("seq", F.explode(F.sequence(first, last)))
    begin, stop = F.greatest("begin", F.col("seq") * capacity), F.least("stop", (F.col("seq") + 1) * capacity)
    skip, length = begin - F.col("begin"), stop - begin
    return placed.select(
        "doc_id", (F.col("start") + skip).alias("start"), length.cast("int").alias("length"), "doc_tokens",
        F.substring("ids", (4 * skip + 1).cast("int"), (4 * length).cast("int")).alias("ids"),
        (F.col("seq") * (capacity + 1)).alias("sequence_id"), (begin - F.col("seq") * capacity).alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, lengths``: the packed sequences, documents in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select(
        "sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"),
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    crc: Column = F.crc32("ids")
    return pieces.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
