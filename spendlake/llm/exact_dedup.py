"""Exact deduplication by recursive hash partitioning to spill files.

Every input split first reduces its own copies, so that a text which makes up a third of the corpus leaves each
split once. The survivors travel by digest, and the receiving task groups them again. Both steps are one Grace hash
grouping: records go to spill files by digest bits, a file that is too large for a table is split by the next bits,
and a file that fits is grouped in an open-addressing table whose probes compare the complete content. Members
follow their split's survivor by a join on slim rows.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import arrow_map, fold_case, free_name, staged, tuned

#: Content bytes that one table may hold; larger buckets are partitioned again.
TABLE_BYTES = 16 << 20
FAN_BITS = 4
MEMBERS = 4096

_HEAD = struct.Struct("<32sqqqI")


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the whole content is equal."""

    def __init__(self, expected: int):
        size = 16
        while size < 2 * expected:
            size *= 2
        self.mask = size - 1
        self.slots = np.full(size, -1, dtype=np.int64)
        self.content: list[bytes] = []

    def group(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """Group number of the content, and whether it is new."""
        at = int.from_bytes(digest[8:16], "little") & self.mask
        while (g := self.slots[at]) >= 0:
            if self.content[g] == content:
                return int(g), False
            at = (at + 1) & self.mask
        if 2 * (len(self.content) + 1) > self.mask + 1:
            raise MemoryError("table sized for fewer groups")
        self.slots[at] = len(self.content)
        self.content.append(content)
        return len(self.content) - 1, True


class GraceGrouper:
    """Records (digest, a, b, c, content) in, groups of equal content out."""

    def __init__(self, table_bytes: int = TABLE_BYTES, fan_bits: int = FAN_BITS):
        self.table_bytes, self.fan = table_bytes, 1 << fan_bits
        self.fan_bits = fan_bits

    def groups(self, records: Iterator[tuple]) -> Iterator[tuple[bytes, bytes, list[tuple]]]:
        """(digest, content, [(a, b, c), ...]) per distinct content."""
        held, size = [], 0
        for r in records:
            held.append(r)
            size += len(r[4]) + 96
            if size > self.table_bytes:
                with tempfile.TemporaryDirectory(prefix="grace-") as folder:
                    yield from self._partition(held, records, Path(folder), 0)
                return
        yield from self._table(held)

    def _partition(self, held: list, rest: Iterator[tuple], folder: Path, depth: int):
        shift = depth * self.fan_bits
        names = [folder / f"{depth}-{k}" for k in range(self.fan)]
        files = [n.open("wb") for n in names]
        try:
            for source in (held, rest):
                for digest, a, b, c, content in source:
                    k = (int.from_bytes(digest[16:24], "little") >> shift) & (self.fan - 1)
                    files[k].write(_HEAD.pack(digest, a, b, c, len(content)))
                    files[k].write(content)
        finally:
            for f in files:
                f.close()
        held.clear()
        for k, name in enumerate(names):
            if name.stat().st_size > self.table_bytes and shift + self.fan_bits < 64 and self._several(name):
                below = folder / f"{depth}.{k}"
                below.mkdir()
                yield from self._partition([], self._read(name), below, depth + 1)
            else:
                yield from self._table(self._read(name))
            name.unlink()

    @staticmethod
    def _several(name: Path) -> bool:
        """Whether a file holds more than one digest; copies of one text need no further split."""
        first = None
        with name.open("rb") as f:
            while head := f.read(_HEAD.size):
                digest, *_, n = _HEAD.unpack(head)
                if first is None:
                    first = digest
                elif digest != first:
                    return True
                f.seek(n, 1)
        return False

    @staticmethod
    def _read(name: Path) -> Iterator[tuple]:
        with name.open("rb") as f:
            while head := f.read(_HEAD.size):
                digest, a, b, c, n = _HEAD.unpack(head)
                yield digest, a, b, c, f.read(n)

    @staticmethod
    def _table(records) -> Iterator[tuple[bytes, bytes, list[tuple]]]:
        table, found = ContentTable(64), []
        for digest, a, b, c, content in records:
            if 2 * (len(found) + 2) > table.mask + 1:
                wider = ContentTable(2 * len(found) + 64)
                for d, content_, _ in found:
                    wider.group(d, content_)
                table = wider
            g, new = table.group(digest, content)
            if new:
                found.append((digest, content, []))
            found[g][2].append((a, b, c))
        yield from found


def _flush(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, schema.field(k).type) for k, v in rows.items()}, schema=schema)
    for v in rows.values():
        v.clear()
    return batch


_LOCAL = pa.schema(
    [("digest", pa.binary()), ("rep", pa.int64()), ("rep_null", pa.bool_()), ("part", pa.int32()), ("copies", pa.int64()),
     ("content", pa.binary()), ("members", pa.list_(pa.int64()))]
)
_GLOBAL = pa.schema(
    [("digest", pa.binary()), ("rep", pa.int64()), ("rep_null", pa.bool_()), ("part", pa.int32()), ("keep_id", pa.int64()),
     ("group_size", pa.int64())]
)
_LOWEST = -(1 << 63)


def _local(batches):
    """Groups of one input split. Null ids are held as the lowest long."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def records():
        for batch in batches:
            ids = batch.column(0).fill_null(_LOWEST).to_numpy(zero_copy_only=False)
            for i, text in zip(ids.tolist(), batch.column(1).cast(pa.binary()).to_pylist()):
                content = (text or b"").lower()
                yield hashlib.sha256(content).digest(), i, 0, 0, content

    rows, size = {f.name: [] for f in _LOCAL}, 0
    for digest, content, found in GraceGrouper().groups(records()):
        ids = [a for a, _, _ in found]
        rep = max(ids)
        for k in range(0, len(ids), MEMBERS):
            chunk = ids[k : k + MEMBERS]
            for name, v in zip(rows, (digest, rep, rep == _LOWEST, part, 0 if k else len(ids), None if k else content, chunk)):
                rows[name].append(v)
        size += len(content) + 64
        if size > 4 << 20:
            yield _flush(rows, _LOCAL)
            size = 0
    if rows["digest"]:
        yield _flush(rows, _LOCAL)


def _global(batches):
    """Groups of all splits' survivors with equal content."""

    def records():
        for batch in batches:
            d, r, p, n, c = (batch.column(k).to_pylist() for k in ("digest", "rep", "part", "copies", "content"))
            for row in zip(d, r, p, n, c):
                yield row

    rows = {f.name: [] for f in _GLOBAL}
    for digest, _, found in GraceGrouper().groups(records()):
        keep, size = max(a for a, _, _ in found), sum(c for _, _, c in found)
        for rep, part, _ in found:
            for name, v in zip(rows, (digest, rep, rep == _LOWEST, part, keep, size)):
                rows[name].append(v)
        if len(rows["digest"]) > 20_000:
            yield _flush(rows, _GLOBAL)
    if rows["digest"]:
        yield _flush(rows, _GLOBAL)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest id
    stays; if rows with that id repeat, every one of them is marked kept, and null ids order below all others. Other
    columns are not read. An empty table gives an empty result.
    """
    tuned(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "digest binary, rep long, rep_null boolean, part int, copies long, content binary, members array<long>"
    local = staged(arrow_map(slim, _local, schema), "exact-local")
    survivors = local.where(F.col("content").isNotNull()).select("digest", "rep", "part", "copies", "content")
    grouped = arrow_map(
        survivors.repartition("digest"), _global,
        "digest binary, rep long, rep_null boolean, part int, keep_id long, group_size long",
    )
    found = grouped.select("digest", "rep", "part", "keep_id", "group_size")
    lists = local.select("digest", "rep", "part", "members")
    rows = lists.join(found, ["digest", "rep", "part"]).select("digest", "keep_id", "group_size", F.explode("members").alias("doc_id"))
    return rows.select(
        F.nullif("doc_id", F.lit(_LOWEST)).alias("doc_id"), F.nullif("keep_id", F.lit(_LOWEST)).alias("keep_id"), "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that repeat with one id and equal text stay once; null ids are compared like any other id.
    """
    kept = exact_groups(docs).where("kept").select(
        F.coalesce("doc_id", F.lit(_LOWEST)).alias("keep_key"), F.col("text_sha256").alias("keep_sha")
    )
    key, sha = free_name(docs, "key_"), free_name(docs, "sha_")
    own = docs.withColumn(key, F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST)))
    own = own.withColumn(sha, F.sha2(fold_case(F.coalesce(docs["text"], F.lit(""))).cast("binary"), 256))
    rows = own.join(kept, (own[key] == kept["keep_key"]) & (own[sha] == kept["keep_sha"]), "left_semi")
    # Clustered by the join's keys already: no further shuffle.
    return rows.dropDuplicates([key, sha]).drop(key, sha)
