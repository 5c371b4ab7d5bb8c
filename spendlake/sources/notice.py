"""Common last steps of every adapter: the full notice schema, and rejects."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions.text import partition_key
from spendlake.operators.versions import keep_first
from spendlake.schemas import NOTICE


def derived_columns() -> dict[str, Column]:
    """Columns of a notice that follow from its others."""
    return {
        "fy": cal.financial_year("release_date"),
        "month": cal.month_label("release_date"),
        "agency_key": partition_key("agency"),
        "company_key": partition_key("supplier"),
    }


def finish(df: DataFrame) -> DataFrame:
    """Add derived and missing columns, in schema order; ``reject_reason`` stays last if present."""
    derived = derived_columns()
    out = []
    for field in NOTICE.fields:
        if field.name in derived:
            value = derived[field.name]
        elif field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        out.append(value.cast(field.dataType).alias(field.name))
    if "reject_reason" in df.columns:
        out.append(F.col("reject_reason"))
    return df.select(*out)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())


def reject_report(df: DataFrame) -> DataFrame:
    """Rejected rows by reason, and accepted rows that no date filter can ever find."""
    undated = F.when(F.col("release_date").isNull(), "accepted without a date")
    label = F.coalesce(F.col("reject_reason"), undated)
    return df.groupBy("source", label.alias("reason")).agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("reason").isNotNull()
    )


def observed_load(df: DataFrame, write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Hand the accepted rows to ``write`` and return what was counted on the way.

    The counts are taken in the pass that writes, so the load reads its input once.
    """
    seen = Observation()
    good = F.col("reject_reason").isNull()
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"),
        F.count_if(good & F.col("release_date").isNull()).alias("undated"),
    )
    write(accepted(counted))
    found = seen.get
    return {name: int(found[name]) for name in ("read", "accepted", "rejected", "undated")}


def first_listed(df: DataFrame) -> DataFrame:
    """One row per contract id of a portal load: the first by page and row."""
    return keep_first(df, ("source", "contract_id"), ("page", F.col("raw_file")), ("row", F.col("raw_row")))


def unite(frames: list[DataFrame]) -> DataFrame:
    """All adapters in one notice table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
