"""Load windows, month coverage, and which parts of a request are still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal


def explode_windows(requests: DataFrame, start: str = "start", end: str = "end", monthly: bool = True) -> DataFrame:
    """One row per window of every request, as window_start, window_end and its month."""
    split = cal.month_windows if monthly else cal.day_windows
    kept = [c for c in requests.columns if c not in (start, end)]
    return (
        requests.select(*kept, F.explode(split(F.col(start), F.col(end))).alias("w"))
        .select(*kept, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))
        .withColumn("month", cal.month_label("window_start"))
    )


def month_coverage(loads: DataFrame) -> DataFrame:
    """Set of (source, month) from the ledger of finished, unfiltered loads."""
    return loads.select("source", "month").where(F.col("month").isNotNull()).distinct()


def missing_windows(windows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Windows whose month has not been loaded for their source."""
    return windows.join(coverage, ["source", "month"], "left_anti")


def merged_ranges(loads: DataFrame) -> DataFrame:
    """Loaded day ranges (source, start, end, both inclusive) united: ranges that touch or overlap become one.

    Of the loads that start on one day the longest stays, so a source has no more rows to order than it has days.
    """
    longest = loads.where(F.col("start") <= F.col("end")).groupBy("source", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("source").orderBy("start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = longest.withColumn("_new", F.coalesce(F.col("start") > F.date_add(reached, 1), F.lit(True)).cast("int"))
    numbered = fresh.withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy("source", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def uncovered_ranges(requests: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """(key, source, gap_start, gap_end): days of each request (key, source, start, end) that no merged range covers."""
    loaded = merged.select("source", F.col("start").alias("_s"), F.col("end").alias("_e"))
    touching = (F.col("_s") <= F.col("end")) & (F.col("_e") >= F.col("start"))
    met = requests.join(loaded, "source").where(touching).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_s", "_e"))).alias("_met"))
    known = requests.join(met, key, "left").withColumn("_met", F.coalesce("_met", F.array().cast("array<struct<_s:date,_e:date>>")))
    # A gap lies between what ends before it and what starts after it; the request's own ends count as such.
    begins = F.concat(F.array("start"), F.transform("_met", lambda m: F.date_add(m["_e"], 1)))
    ends = F.concat(F.transform("_met", lambda m: F.date_sub(m["_s"], 1)), F.array("end"))
    gaps = F.filter(F.arrays_zip(begins.alias("gap_start"), ends.alias("gap_end")), lambda g: g["gap_start"] <= g["gap_end"])
    return known.select(key, "source", F.inline(gaps))


def coverage_by_request(windows: DataFrame, coverage: DataFrame, key: str) -> DataFrame:
    """Per request: number of windows, number missing, and whether none is."""
    loaded = coverage.withColumn("_loaded", F.lit(True))
    joined = windows.join(loaded, ["source", "month"], "left")
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("_loaded").isNull()).alias("missing"),
        (F.count_if(F.col("_loaded").isNull()) == 0).alias("complete"),
    )


def rows_in_windows(rows: DataFrame, windows: DataFrame, keys: list[str], date: str = "release_date") -> DataFrame:
    """Rows whose month is needed and whose day lies in a window of that month.

    An equi-join on ``keys`` and month carries the range condition, so it never becomes a nested
    loop; AQE splits a month that holds many rows. Windows of one key and month must not overlap.
    """
    day = F.to_date(F.col(date))
    in_range = (day >= F.col("window_start")) & (day <= F.col("window_end"))
    labelled = rows if "month" in rows.columns else rows.withColumn("month", cal.month_label(date))
    return labelled.join(windows.select(*keys, "month", "window_start", "window_end"), [*keys, "month"]).where(in_range)


def load_jobs(suppliers: DataFrame, start: str, end: str, term: str = "") -> DataFrame:
    """One load job per supplier and month window; a name term keeps only suppliers that have it.

    The windows are built on each supplier row, so no cross product is ever joined.
    """
    digits_only = bool(term.strip()) and term.replace(" ", "").isdigit()
    rows = suppliers
    if term.strip() and not digits_only:
        rows = rows.where(F.contains(F.lower("supplier"), F.lit(term.strip().lower())))
    ranged = rows.withColumn("start", F.lit(start).cast("date")).withColumn("end", F.lit(end).cast("date"))
    return explode_windows(ranged)
