"""Token ids in wavelet-matrix shards.

A shard stores the ids of a run of documents as bit planes, highest bit first, each plane ordered by the bits above it.
Every plane is cut into frames that are compressed on their own and carry the number of ones before them, so one token
is read, counted or found by touching one frame per plane. File layout, all integers little-endian:

    8 bytes   magic
    4 bytes   length of the header, then the header as JSON: tokens, documents, planes, bits per frame, zeros per
              plane, and per plane the ones before each frame and the byte offset of each frame
    documents int64 ids, uint8 null marks, int64 lengths, compressed
    frames    the planes' bits, eight to a byte, lowest first
"""

from __future__ import annotations

import io
import json
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, open_output, scratch_path, tuned
from spendlake.llm.tokens import encoded, vocabulary_path

MAGIC = b"WVLTMTX1"
END_ID = 2
#: Bits of a frame, and tokens after which a shard is closed at the end of a document.
FRAME, SHARD_TOKENS = 1 << 16, 1 << 21


#: Bits that are parted or merged at once, so that their places stay in the processor's cache.
RUN = 1 << 14


def part(level: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The values with bit 0, then those with bit 1, each in their order."""
    out, zero = np.empty_like(level), 0
    one = len(bits) - int(np.count_nonzero(bits))
    for k in range(0, len(bits), RUN):
        own, values = bits[k : k + RUN], level[k : k + RUN]
        for places, start in (((~own).nonzero()[0], zero), (own.nonzero()[0], one)):
            values.take(places, out=out[start : start + len(places)], mode="clip")
        ones = len(places)
        zero, one = zero + len(own) - ones, one + ones
    return out


def merged(below: np.ndarray, bits: np.ndarray, zero_count: int) -> np.ndarray:
    """Undoes ``part``."""
    out, zero, one = np.empty_like(below), 0, zero_count
    for k in range(0, len(bits), RUN):
        own, values = bits[k : k + RUN], out[k : k + RUN]
        zeros, ones = (~own).nonzero()[0], own.nonzero()[0]
        values[zeros] = below[zero : zero + len(zeros)]
        values[ones] = below[one : one + len(ones)]
        zero, one = zero + len(zeros), one + len(ones)
    return out


def build(ids: np.ndarray, docs: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of one shard."""
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    level = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, ones, offsets, frames, at = [], [], [], [], 0
    pack = zstandard.ZstdCompressor(level=1)
    for plane in range(planes - 1, -1, -1):
        bits = (level & level.dtype.type(1 << plane)) != 0
        packed, starts, sums = np.packbits(bits, bitorder="little"), [], [0]
        for k in range(0, len(bits), FRAME):
            raw = packed[k // 8 : (k + FRAME) // 8]
            sums.append(sums[-1] + int(np.bitwise_count(raw).sum(dtype=np.int64)))
            frame = pack.compress(raw)
            starts.append(at)
            frames.append(frame)
            at += len(frame)
        ones.append(sums)
        offsets.append([*starts, at])
        level = part(level, bits)
        zeros.append(int(len(bits) - ones[-1][-1]))
    table = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
    table = pack.compress(table + np.array(lengths, "<i8").tobytes())
    head = json.dumps(
        {"tokens": len(ids), "documents": len(docs), "planes": planes, "frame": FRAME, "zeros": zeros, "ones": ones, "offsets": offsets,
         "table": len(table)}
    ).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, table, *frames])


class Shard:
    """Reads a shard from a seekable file; frames are loaded when a question needs them."""

    def __init__(self, file, kept_frames: int = 64):
        self.file, self.kept_frames, self.kept = file, kept_frames, {}
        file.seek(0)
        if file.read(8) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(file.read(4), "little")
        self.head = json.loads(file.read(size))
        self.tokens, self.planes = self.head["tokens"], self.head["planes"]
        self._table = file.read(self.head["table"])
        self.base = 12 + size + len(self._table)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        n = self.head["documents"]
        raw = zstandard.ZstdDecompressor().decompress(self._table)
        if len(raw) != 17 * n:
            raise ValueError("document table has a wrong length")
        null = np.frombuffer(raw, np.uint8, n, 8 * n)
        ids = [None if gone else d for d, gone in zip(np.frombuffer(raw, "<i8", n).tolist(), null)]
        return ids, np.frombuffer(raw, "<i8", n, 9 * n)

    def _packed(self, plane: int, k: int) -> np.ndarray:
        at = self.head["offsets"][plane]
        self.file.seek(self.base + at[k])
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(at[k + 1] - at[k])), np.uint8)

    def _frame(self, plane: int, k: int) -> np.ndarray:
        bits = self.kept.get((plane, k))
        if bits is None:
            frame = self.head["frame"]
            bits = np.unpackbits(self._packed(plane, k), bitorder="little")[: min(frame, self.tokens - k * frame)]
            if len(self.kept) >= self.kept_frames:
                self.kept.pop(next(iter(self.kept)))
            self.kept[plane, k] = bits
        return bits

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, self.head["frame"])
        return self.head["ones"][plane][k] + (int(self._frame(plane, k)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of a plane."""
        ones, frame = self.head["ones"][plane], self.head["frame"]
        before = ones if bit else [min(k * frame, self.tokens) - v for k, v in enumerate(ones)]
        k = int(np.searchsorted(before, j, side="right")) - 1
        return k * frame + int(np.flatnonzero(self._frame(plane, k) == bit)[j - before[k]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for plane in range(self.planes):
            k, rest = divmod(i, self.head["frame"])
            bit = int(self._frame(plane, k)[rest])
            out = out << 1 | bit
            ones = self._rank(plane, i)
            i = self.head["zeros"][plane] + ones if bit else i - ones
        return out

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._rank(plane, start), self._rank(plane, stop)
            if token >> (self.planes - 1 - plane) & 1:
                start, stop = self.head["zeros"][plane] + a, self.head["zeros"][plane] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token among the ids from ``start`` to ``stop``."""
        stop = self.tokens if stop is None else min(stop, self.tokens)
        a, b = self._range(token, min(start, stop), stop)
        return b - a

    def find(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.tokens)
        if not 0 <= j < b - a:
            raise IndexError(j)
        at = a + j
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self._select(plane, bit, at - self.head["zeros"][plane] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """All ids: the planes' partitions undone, from the last to the first."""
        ids = np.zeros(self.tokens, dtype=np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            parts = [self._packed(plane, k) for k in range(len(self.head["offsets"][plane]) - 1)]
            bits = np.unpackbits(np.concatenate(parts), bitorder="little")[: self.tokens].astype(bool) if parts else np.zeros(0, bool)
            ids = merged(ids, bits, self.head["zeros"][plane])
            ids |= bits.astype(ids.dtype) << ids.dtype.type(self.planes - 1 - plane)
        return ids.astype(np.uint32)


_SHARDS = pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("tokens", pa.int64()), ("documents", pa.int64())])


def _write(batches, folder, path, end_id, shard_tokens):
    from pyspark import TaskContext

    part, file = TaskContext.get().partitionId(), 0
    docs, ids, size, end = [], [], 0, end_id.to_bytes(4, "little")

    def close():
        nonlocal file, docs, ids, size
        name = f"{folder}/shard-{part:06d}-{file:06d}.wm"
        data = build(np.frombuffer(b"".join(ids), "<u4"), docs, [len(v) // 4 for v in ids])
        open_output(name, lambda out: out.write(data))
        row = pa.RecordBatch.from_pydict(dict(zip(_SHARDS.names, ([name], [part], [file], [size], [len(docs)]))), schema=_SHARDS)
        file, docs, ids, size = file + 1, [], [], 0
        return row

    for batch in batches:
        for doc, row in zip(batch.column(0).to_pylist(), encoded(path, batch.column(1).to_pylist())):
            docs.append(doc)
            ids.append(row + end)
            size += len(row) // 4 + 1
            if size >= shard_tokens:
                yield close()
    if docs:
        yield close()


def write_shards(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode whole texts, end each with ``end_id``, and write them in ascending id order as shards under ``folder``.

    Returns ``path, part, file, tokens, documents`` of the shards in order of (part, file). Null and empty texts have
    the end id alone; null ids come first; rows that repeat an id stay together in any order; an empty table writes no
    shard. A task that runs again replaces its files by equal ones.
    """
    tuned(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Equal ids are ordered by their text, so a task that runs again writes the same files.
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write = partial(_write, folder=folder, path=path or vocabulary_path(), end_id=end_id, shard_tokens=shard_tokens)
    return arrow_map(ordered, write, "path string, part int, file int, tokens long, documents long")


_READ = pa.schema(
    [("path", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)


def _read(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard(io.BytesIO(memoryview(content.as_buffer())))
            docs, lengths = shard.documents()
            ids, stops = shard.all(), lengths.cumsum()
            if stops[-1] != shard.tokens:
                raise ValueError(f"{path}: documents and tokens disagree")
            begins = stops - lengths
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [path] * len(docs), "place": list(range(len(docs))), "doc_id": docs, "begin": begins, "n_tokens": lengths,
                    "ids": [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), stops.tolist())],
                },
                schema=_READ,
            )


def read_shards(spark, folder: str) -> DataFrame:
    """``path, place, doc_id, begin, n_tokens, ids`` of every document in the shards under ``folder``.

    ``begin`` is its place in the shard, ``ids`` are little-endian unsigned 32-bit integers.
    """
    files = tuned(spark).read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    return arrow_map(files.select("path", "content"), _read, "path string, place long, doc_id long, begin long, n_tokens long, ids binary")


def token_shards(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the shards it was written to."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "wavelet")
    written = write_shards(docs, folder, **options)
    listing = f"{folder}-list"
    written.write.parquet(listing)
    shards = spark.read.schema(written.schema).parquet(listing)
    if not shards.limit(1).count():
        empty = spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        return empty
    # One row per part and then per file: the offsets need no ordering of all shards in one task.
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("t"))
    parts = parts.select("part", (F.sum("t").over(W.orderBy("part")) - F.col("t")).alias("ahead"))
    inside = F.sum("tokens").over(W.partitionBy("part").orderBy("file")) - F.col("tokens")
    offsets = shards.withColumn("inside", inside).join(parts, "part").select(
        F.substring_index("path", "/", -1).alias("name"), (F.col("ahead") + F.col("inside")).alias("base")
    )
    rows = read_shards(spark, folder).select(
        F.substring_index("path", "/", -1).alias("name"), "doc_id", "begin", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return rows.join(offsets, "name").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
