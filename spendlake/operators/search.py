"""Row search: projection, ordering, limits, summary and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.operators.filters import SpendFilter
from spendlake.operators.versions import latest_versions

# Export headers and the columns behind them.
EXPORT_COLUMNS = (
    ("Supplier", "supplier"),
    ("Agency", "agency"),
    ("Title", "title"),
    ("Amount", "amount"),
    ("Date", "release_date"),
    ("Source", "source"),
    ("ContractID", "contract_id"),
    ("OCID", "ocid"),
)


def search_projection(df: DataFrame) -> DataFrame:
    day = F.when(F.col("release_date") > F.lit("1970-01-01").cast("timestamp"), F.to_date("release_date"))
    return df.select(
        "contract_id", "release_id", "ocid", "source", "supplier", "agency", "title",
        F.col("amount").cast("double").alias("amount"),
        F.col("fy").alias("financial_year"),
        day.alias("release_date"),
    )


def matching_contracts(notices: DataFrame, f: SpendFilter) -> DataFrame:
    """Newest matching version of every contract, unlimited. A blank source means all sources."""
    return latest_versions(f.require_term().apply(notices))


def top_contracts(contracts: DataFrame, limit: int | None = None) -> DataFrame:
    """Largest amounts first: the first ``limit`` rows, or all of them without a limit."""
    ordered = contracts.orderBy(F.desc("amount"), "source", "contract_id")
    return ordered.limit(limit) if limit and limit > 0 else ordered


def search_contracts(notices: DataFrame, f: SpendFilter, limit: int | None = None) -> DataFrame:
    return search_projection(top_contracts(matching_contracts(notices, f), limit))


def search_summary(notices: DataFrame, f: SpendFilter, limit: int | None = None) -> DataFrame:
    """Count and total of the returned rows, beside those of all matches."""
    contracts = matching_contracts(notices, f).select("source", "contract_id", "amount")
    shown = top_contracts(contracts, limit).select("amount", F.lit(True).alias("shown"))
    rows = shown.unionByName(contracts.select("amount", F.lit(False).alias("shown")))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("amount"))).cast("double"), F.lit(0.0))

    is_shown = F.col("shown")
    return rows.agg(
        F.count_if(is_shown).alias("count"), total(is_shown).alias("total_spend"),
        F.count_if(~is_shown).alias("count_all"), total(~is_shown).alias("total_spend_all"),
    )


def sort_results(results: DataFrame, column: str = "amount", descending: bool | None = None) -> DataFrame:
    """Order by a chosen column, text without regard to case; amount is descending by default."""
    descending = column == "amount" if descending is None else descending
    is_text = dict(results.dtypes)[column] == "string"
    key: Column = F.lower(F.coalesce(F.col(column), F.lit(""))) if is_text else F.col(column)
    return results.orderBy(key.desc() if descending else key.asc(), "source", "contract_id")


def export_frame(results: DataFrame) -> DataFrame:
    return results.select(*[F.col(c).alias(header) for header, c in EXPORT_COLUMNS])


def export_csv(results: DataFrame, path: str) -> None:
    export_frame(results).write.mode("overwrite").option("header", True).csv(path)
