"""Helpers shared by the corpus operators."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.session import scratch_path, staged

__all__ = [
    "BATCH_BYTES", "BATCH_ROWS", "arrow_map", "fold_case", "free_name", "open_output", "scratch_path", "spread_join",
    "staged", "table", "text_hash", "tuned",
]

#: Bounds of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tuned(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tuned(df.sparkSession)
    return df.mapInArrow(fn, schema)


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: Column, how: str = "left", ways: int = 16) -> DataFrame:
    """Equi-join of many rows with slim rows that are unique per key.

    One key may hold a third of ``left``: its rows are dealt out by ``by`` over ``ways`` copies of the
    right row, so no task gets them all. Keys compare null-safe.
    """
    salt = free_name(left, "salt")
    a = left.withColumn(salt, F.pmod(by, F.lit(ways)).cast("int"))
    b = right.select(
        *[F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns],
        F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("r_salt"),
    )
    # Estimates do not see the copies: without the hint Spark may broadcast what it takes for a small table.
    b = b.hint("merge")
    match = a[salt] == b["r_salt"]
    for c in on:
        match = match & a[c].eqNullSafe(b[f"r_{c}"])
    return a.join(b, match, how).drop(salt, "r_salt", *[f"r_{c}" for c in on])


def open_output(uri: str, write: Callable[[pa.NativeFile], None]) -> int:
    """Write a file through its file system: under a name of its own first, then moved in place.

    A task that runs twice leaves one complete file. Returns its size.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, path)
    return system.get_file_info(path).size
