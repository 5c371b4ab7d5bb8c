"""CSV files as cell rows, with one large file read by many tasks.

Quoted cells may hold line ends, so where a byte range starts inside a file says nothing about whether it starts inside
a cell. A first pass reduces every range to what it does to that question: whatever the start, its end is outside a
quoted cell, or inside, or as the start was, or the opposite. These four compose, so a running sum over the ranges of a
file gives the state each one starts with. The second pass reads the ranges with their states. A record that crosses
ranges leaves a piece in each; the pieces meet by file and by the range the record starts in.

The delimiter of a file is found in its first range; ranges are reduced for every delimiter it may have.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS_SCHEMA = "file string, row_no long, cells array<string>"
MARKS = (",", ";", "\t")
#: What a range does to the question whether a position is inside a quoted cell.
OUT, IN, SAME, SWAP = range(4)

_STOPS = {mark: re.compile(f"[{mark}\r]") for mark in MARKS}


def inside_after(line: str, mark: str, inside: bool) -> bool:
    """Whether the end of a line is inside a quoted cell.

    Quotes count where a cell begins; a doubled one is part of its cell, and text after a closing one is plain.
    """
    if '"' not in line:
        return inside
    at, stops = 0, _STOPS[mark]
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        stop = stops.search(line, at)
        if stop is None:
            return False
        at = stop.end()


def effect(ends: tuple[bool, bool]) -> int:
    """The effect of a range from its ends after an outside and an inside start."""
    return {(False, False): OUT, (True, True): IN, (False, True): SAME, (True, False): SWAP}[ends]


def records(text: str, mark: str) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=mark) if r]


def delimiter(text: str) -> str:
    """Semicolon or tab where the first record is a single cell that holds one, else comma."""
    first = next(iter(records(text, ",")), [])
    only = first[0] if len(first) == 1 else ""
    return ";" if ";" in only else "\t" if "\t" in only else ","


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Neighbouring lines of one range, with its file and place."""
    files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ranges = batch.column("range").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (ranges[1:] != ranges[:-1])) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > start:
            yield (batch.column("file")[start].as_py(), int(ranges[start])), batch.slice(start, end - start)


def _texts(lines: pa.Array) -> Iterator[str]:
    return (line.decode("utf-8", errors="replace") for line in lines.to_pylist())


_EFFECTS = pa.schema([("file", pa.string()), ("range", pa.int64()), ("mark", pa.string()), ("effects", pa.list_(pa.int32()))])


def _effects_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: its effect for every delimiter, and the delimiter of the file in a first range."""
    key, ends, opening, mark = None, [], [], None

    def row():
        found = mark if mark or key[1] else delimiter("".join(opening))
        return pa.RecordBatch.from_pydict(
            {"file": [key[0]], "range": [key[1]], "mark": [found], "effects": [[effect(tuple(e)) for e in ends]]}, schema=_EFFECTS
        )

    for batch in batches:
        for own, run in _runs(batch):
            if own != key:
                if key is not None:
                    yield row()
                key, ends, opening, mark = own, [[False, True] for _ in MARKS], [], None
            lines = run.column("line")
            if not key[1] and mark is None:
                # Only the first record is kept, until it is complete.
                inside = ends[0][0]
                for line in _texts(lines):
                    opening.append(line + "\n")
                    inside = inside_after(line, ",", inside)
                    if line.strip("\r") and not inside:
                        mark = delimiter("".join(opening))
                        break
            # A line without a quote changes nothing.
            for line in _texts(lines.filter(pc.match_substring(lines, '"'))):
                for k, m in enumerate(MARKS):
                    ends[k] = [inside_after(line, m, e) for e in ends[k]]
    if key is not None:
        yield row()


def _starts(effects: DataFrame) -> DataFrame:
    """``file, range, mark, inside``: the delimiter of every range's file and the state it starts with."""
    whole = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    marked = effects.withColumn("mark", F.first("mark", ignorenulls=True).over(whole))
    number = F.array_position(F.array(*[F.lit(m) for m in MARKS]), F.col("mark"))
    one = marked.withColumn("e", F.get("effects", (number - 1).cast("int")))
    swaps = F.coalesce(F.sum(F.when(F.col("e") == SWAP, 1).otherwise(0)).over(before), F.lit(0))
    one = one.withColumn("swaps", swaps)
    # The last range with a fixed end decides, and the swaps after it turn it around.
    fixed = F.when(F.col("e").isin(OUT, IN), F.struct((F.col("e") == IN).cast("int").alias("end"), "swaps"))
    one = one.withColumn("last", F.last(fixed, ignorenulls=True).over(before))
    turns = F.coalesce("last.end", F.lit(0)) + F.col("swaps") - F.coalesce("last.swaps", F.lit(0))
    return one.select("file", "range", "mark", (turns % 2 == 1).alias("inside"))


_PARTS = pa.schema(
    [("file", pa.string()), ("range", pa.int64()), ("seq", pa.int64()), ("cells", pa.list_(pa.string())), ("piece", pa.string()),
     ("mark", pa.string())]
)
_PART = "file string, range long, seq long, cells array<string>, piece string, mark string"
#: Places of pieces among the records of a range: what a record of an earlier range left, and one that does not end here.
HEAD, TAIL = -1, 1 << 62


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in their range, in which a scan hands them over."""
    key, n = None, 0
    for batch in batches:
        places = [np.empty(0, "int64")]
        for own, run in _runs(batch):
            key, n = own, n if own == key else 0
            places.append(np.arange(n, n + run.num_rows, dtype="int64"))
            n += run.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(places))], names=[*batch.schema.names, "n"])


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every range, whose lines come in order, and the pieces at its ends."""
    key, inside, first, held, ready, seq, mark = None, False, False, [], [], 0, ","

    def rows(places, cells, pieces):
        n = len(places)
        return pa.RecordBatch.from_pydict(
            {"file": [key[0]] * n, "range": [key[1]] * n, "seq": places, "cells": cells, "piece": pieces, "mark": [mark] * n}, schema=_PARTS
        )

    def piece():
        return rows([HEAD if first else TAIL], [None], ["".join(held)])

    def take():
        """The complete records so far, read together: each of them ends outside a quoted cell."""
        nonlocal seq
        found = records("".join(ready), mark)
        ready.clear()
        seq += len(found)
        return rows(range(seq - len(found) + 1, seq + 1), found, [None] * len(found))

    for batch in batches:
        for own, run in _runs(batch):
            if own != key:
                if ready:
                    yield take()
                if held:
                    yield piece()
                inside = first = run.column("inside")[0].as_py()
                key, held, seq, mark = own, [], 0, run.column("mark")[0].as_py()
            for text in _texts(run.column("line")):
                held.append(text + "\n")
                inside = inside_after(text, mark, inside)
                if not inside:
                    if first:
                        yield piece()
                        first = False
                    else:
                        ready += held
                    held.clear()
                    if len(ready) >= 5_000:
                        yield take()
    if ready:
        yield take()
    if held:
        yield piece()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that crossed ranges, from their joined pieces."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for k, cells in enumerate(records(r["piece"], r["mark"])):
                out.append({**r, "seq": TAIL + k, "cells": cells, "piece": None})
        yield pa.RecordBatch.from_pylist(out, _PARTS)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every CSV file as (file, row_no, cells); the delimiter is sniffed per file.

    Records are numbered from 1 in the order of their file, without empty ones. Bytes that are no UTF-8 are replaced.
    A task holds the records of one range and at most one record that crosses ranges.
    """
    scan = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line")
    )
    starts = _starts(scan.mapInArrow(_effects_of, "file string, range long, mark string, effects array<int>"))
    lines = scan.mapInArrow(_numbered, "file string, range long, line binary, n long")
    told = lines.join(starts, ["file", "range"]).select("file", "range", "n", "line", "mark", "inside")
    told = told.repartition("file", "range").sortWithinPartitions("file", "range", "n")
    parts = told.mapInArrow(_parts_of, _PART)
    # A piece at a range's start belongs to the last record that was open before it.
    order = Window.partitionBy("file").orderBy("range", "seq")
    pieces = parts.where(F.col("piece").isNotNull()).withColumn("record", F.sum(F.when(F.col("seq") == TAIL, 1).otherwise(0)).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "piece"))), lambda p: p["piece"]), "")
    crossing = pieces.groupBy("file", "record").agg(
        F.min("range").alias("range"), F.lit(TAIL).alias("seq"), F.lit(None).cast("array<string>").alias("cells"), text.alias("piece"),
        F.first("mark").alias("mark"),
    )
    crossing = crossing.select("file", "range", "seq", "cells", "piece", "mark").mapInArrow(_joined, _PART)
    rows = parts.where(F.col("piece").isNull()).unionByName(crossing)
    return _row_numbers(rows)


def _row_numbers(rows: DataFrame) -> DataFrame:
    """Rows numbered through their file: those of earlier ranges, then the place in their own.

    A record that crosses ranges is the last of the range it starts in.
    """
    whole = F.col("seq") < TAIL
    counts = rows.groupBy("file", "range").agg(F.count(F.lit(1)).alias("c"), F.count_if(whole).alias("own"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    place = F.when(whole, F.col("seq")).otherwise(F.col("own") + F.col("seq") - TAIL + 1)
    return rows.join(counts, ["file", "range"]).select("file", (F.col("before") + place).alias("row_no"), "cells")
