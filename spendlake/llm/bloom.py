"""A Bloom filter of fixed size, built by all tasks and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlake.llm.common import arrow_map

#: Bits of the filter, whatever it holds: with more keys it lets more through, and nothing is lost.
BITS = 1 << 25
BLOCK = 1 << 16

_PART = pa.schema([("block", pa.int32()), ("bits", pa.binary())])


def _probes(keys: np.ndarray):
    with np.errstate(over="ignore"):
        v = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
        w = v * np.uint64(0x94D049BB133111EB)
    for h in (v, v >> np.uint64(30), w >> np.uint64(33)):
        yield (h & np.uint64(BITS - 1)).astype(np.int64)


def _fill(batches):
    bits, any_key = np.zeros(BITS // 8, dtype=np.uint8), False
    for batch in batches:
        any_key |= len(batch) > 0
        for at in _probes(batch.column(0).to_numpy(zero_copy_only=False)):
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    if any_key:
        for k in range(0, len(bits), BLOCK):
            part = bits[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [k // BLOCK], "bits": [part.tobytes()]}, schema=_PART)


def _join(batches):
    joined: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(part, dtype=np.uint8)
            joined[block] = joined[block] | part if block in joined else part
    if joined:
        yield pa.RecordBatch.from_pydict({"block": list(joined), "bits": [v.tobytes() for v in joined.values()]}, schema=_PART)


def may_hold(keys: DataFrame) -> np.ndarray:
    """The filter of a column of longs; BITS bits reach the driver."""
    parts = arrow_map(keys, _fill, "block int, bits binary").repartition("block")
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for row in arrow_map(parts, _join, "block int, bits binary").collect():
        bits[row["block"] * BLOCK :][: len(row["bits"])] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; no key that is in it is missed."""
    ok = np.ones(len(keys), dtype=bool)
    for at in _probes(keys):
        ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok
