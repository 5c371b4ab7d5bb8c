"""Saved results: query fingerprints, daily snapshots and run checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.calendar import local_day
from spendlake.functions.text import _col, collapse_spaces
from spendlake.session import staged
from spendlake.streaming.commits import CommittedTable

# Order of the parts of a fingerprint.
PARTS = ("company", "agency", "keyword", "source", "dateType", "lookback", "start", "end")


def normal_part(c: Column | str) -> Column:
    return F.lower(collapse_spaces(F.coalesce(_col(c).cast("string"), F.lit(""))))


def fingerprint(day: Column, **parts: Column) -> Column:
    """Key of a saved result: the local day and every field of the query, normalised."""
    pieces = [F.concat(F.lit("day="), day.cast("string"))]
    for name in PARTS:
        value = parts.get(name, F.lit(""))
        if name in ("start", "end", "lookback"):
            value = F.coalesce(value.cast("string"), F.lit(""))
        else:
            value = normal_part(value)
        pieces.append(F.concat(F.lit(f"{name}="), value))
    return F.concat_ws("|", *pieces)


def daily_snapshot(results: DataFrame, run_at: Column, zone: str = "Australia/Sydney") -> DataFrame:
    """Results stamped with their local day and the instant they expire."""
    stamp = local_day(run_at, zone)
    return results.withColumn("snapshot_day", stamp["day"]).withColumn("expires_at", stamp["expires"])


def last_checkpoints(ledger: DataFrame) -> DataFrame:
    """Latest finished run per query key."""
    return ledger.groupBy("query_key").agg(F.max("run_end").alias("checkpoint"))


def resume_points(requests: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Requests with their start moved to the last run when it lies inside the range."""
    joined = requests.join(checkpoints, "query_key", "left")
    inside = (F.col("checkpoint") > F.col("start")) & (F.col("checkpoint") < F.col("end"))
    return joined.withColumn("search_start", F.when(inside, F.col("checkpoint")).otherwise(F.col("start")))


SAVED = ("snapshot_day", "query_key")


def fill(spark: SparkSession, store: CommittedTable, requests: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Compute and store the results of the requests whose (day, fingerprint) is not stored yet; returns how many.

    ``requests`` may hold one fingerprint several times; ``compute`` gets each of the missing ones once.
    """
    known = store.read(spark).select(*SAVED)
    asked = requests.dropDuplicates(list(SAVED))
    missing = staged(asked.join(known, list(SAVED), "left_anti").select(*requests.columns), "missing-results")
    count = missing.count()
    if count:
        number = max((r["number"] for r in store.commits(spark)), default=-1) + 1
        store.append(compute(missing), number)
    return count
