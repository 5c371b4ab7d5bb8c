"""Totals: latest-version spend, plain sums, and the ranked reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.operators.filters import SpendFilter
from spendlake.operators.versions import CONTRACT, RELEASE, keep_first, latest_versions


def as_double(c: str, name: str | None = None) -> Column:
    """Sums stay decimal until the last step, so the order of addition cannot show."""
    return F.col(c).cast("double").alias(name or c)


def once(notices: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` of a lake with each release once: a load that runs again may have stored it twice.

    A contract listed again with another day or amount is another version and stays, and so do notices without a release
    id that differ anywhere: only these carry their whole row through the shuffle. Rows without that column are not from
    a lake and stay as they are.
    """
    if "release_id" not in notices.columns:
        return notices
    keys = [c for c in RELEASE if c in notices.columns]
    blank = F.trim(F.coalesce("release_id", F.lit(""))) == ""
    whole = F.when(blank, F.struct(*[F.col(c) for c in notices.columns])).alias("_whole")
    rest = [c for c in used if c not in keys]
    slim = notices.select(*keys, *rest, whole)
    return (keep_first(slim, (*keys, "_whole")) if rest else slim.distinct()).drop("_whole")


def latest_amounts(df: DataFrame, keys: tuple[str, ...] = CONTRACT) -> DataFrame:
    """(keys, amount) of the newest version, reading only the columns the choice needs."""
    slim = df.select(*keys, "amount", "release_date", "release_id")
    return latest_versions(slim, keys).select(*keys, "amount")


def total_spend(notices: DataFrame, f: SpendFilter | None = None, partitioned: bool = False) -> DataFrame:
    """One row: contracts, total_spend and matched, on the latest version of every contract.

    A blank source means federal, as in a single-jurisdiction total. ``partitioned`` is for rows
    of a lake, whose ``fy`` and ``month`` folders the date range can prune.
    """
    f = f or SpendFilter()
    if not f.source.strip():
        f = SpendFilter(f.keyword, f.company, f.agency, "federal", f.start, f.end)
    return summarise(latest_amounts(f.apply(notices, partitioned)))


def summarise(contracts: DataFrame) -> DataFrame:
    return contracts.agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("amount").alias("total")
    ).select(
        "contracts",
        F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total_spend"),
        (F.col("contracts") > 0).alias("matched"),
    )


def total_all_versions(notices: DataFrame, f: SpendFilter, partitioned: bool = False) -> DataFrame:
    """Plain sum over matching rows, every version counted once however often it is stored."""
    rows = once(f.apply(notices, partitioned), "amount")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total")
    ).select(
        "rows",
        F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total_spend"),
        (F.col("rows") > 0).alias("matched"),
    )


def spend_by_year_and_agency(notices: DataFrame, limit: int = 20) -> DataFrame:
    """The default report: stored rows by financial year and agency, largest totals first."""
    grouped = once(notices, "fy", "agency", "amount").groupBy("fy", "agency").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("records")
    )
    top = grouped.orderBy(F.desc("total"), "fy", "agency").limit(limit)
    return top.select(F.col("fy").alias("financial_year"), "agency", as_double("total", "total_amount"), "records")


def monthly_spend(notices: DataFrame) -> DataFrame:
    grouped = once(notices, "source", "month", "amount").groupBy("source", "month").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("records")
    )
    return grouped.select("source", "month", as_double("total", "total_amount"), "records")


def incremental_total(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Total per source over stored and fresh rows together.

    The rows are united before the version collapse, so a contract amended after the last run
    counts once, with its newest value.
    """
    both = stored.unionByName(fresh, allowMissingColumns=True)
    grouped = latest_amounts(both).groupBy("source").agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("amount").alias("total")
    )
    return grouped.select("source", "contracts", as_double("total", "total_spend"))

