"""Spreadsheet disclosures (CSV cells) to contract notices, whatever the header layout."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions.money import parse_money
from spendlake.functions.text import blank_to_null, collapse_spaces, strip
from spendlake.operators.versions import keep_first
from spendlake.session import staged
from spendlake.sources.csv_cells import CELLS_SCHEMA, read_cells
from spendlake.sources.notice import finish

__all__ = ["CELLS_SCHEMA", "read_cells"]

# Header texts of each field, in order of preference.
HEADERS = {
    "agency": ("agency", "agency name", "department", "agency/entity", "entity"),
    "supplier": ("supplier name", "supplier", "vendor", "contractor", "contract party"),
    "award_date": (
        "award contract date", "award date", "contract date", "date awarded", "awarded date",
        "start date", "commencement date", "effective date",
    ),
    "value": (
        "contract value", "total contract value", "contract amount", "amount", "revised value",
        "revised value (inc)", "revised value inc", "revised value (incl)", "value (inc)",
        "value (incl)", "value inc", "value incl",
    ),
    "reference": ("contract reference number", "contract number", "reference", "contract reference"),
    "title": ("contract description", "description", "title", "purpose"),
}
BARE_REFERENCE = "contract"
#: Every header text of these fields holds one of these words.
HEADER_WORDS = {"award_date": ("date",), "value": ("value", "amount")}


def staged_cells(spark: SparkSession, path: str) -> DataFrame:
    """``read_cells`` written out once.

    The adapter reads the cells twice, for the headers and for the rows. From a table, neither
    read parses a file again, and the rows of a large file are split over many tasks.
    """
    return staged(read_cells(spark, path), "cells")


def header_index(cells: Column | str) -> Column:
    """struct of 1-based column positions per field, NULL where a field has no column.

    Exact header texts win over texts that merely contain a candidate; within both, the order of
    the candidates decides.
    """
    cells = F.col(cells) if isinstance(cells, str) else cells
    texts = F.transform(
        cells, lambda h: collapse_spaces(F.regexp_replace(F.lower(strip(F.coalesce(h, F.lit("")))), "^\\x{FEFF}", ""))
    )

    def position(candidates: tuple[str, ...]) -> Column:
        options = F.array(*[F.lit(c) for c in candidates])
        exact = F.get(F.filter(options, lambda c: F.array_contains(texts, c)), F.lit(0))
        inside = F.get(F.filter(options, lambda c: F.exists(texts, lambda h: F.contains(h, c))), F.lit(0))
        holds = F.transform(texts, lambda h: F.contains(h, inside))
        # A missing candidate gives NULL in the first position and zero in the second.
        return F.coalesce(F.array_position(texts, exact), F.nullif(F.array_position(holds, F.lit(True)), F.lit(0)))

    fields = {name: position(candidates) for name, candidates in HEADERS.items()}
    bare = F.array_position(texts, F.lit(BARE_REFERENCE))
    fields["reference"] = F.coalesce(fields["reference"], F.when(bare > 0, bare))
    return F.struct(*[c.cast("int").alias(name) for name, c in fields.items()])


def header_rows(cells: DataFrame) -> DataFrame:
    """(file, header_row, idx): the first row of the file that has a date and a value column."""
    # Every header text of both columns is part of the joined row, so few rows need the full look.
    # Single words need no collapsed spaces, so most rows go without a regular expression.
    raw = F.lower(F.concat_ws(" ", "cells"))
    for words in HEADER_WORDS.values():
        cells = cells.where(reduce(or_, [F.contains(raw, F.lit(w)) for w in words]))
    joined = collapse_spaces(raw)
    likely = [F.exists(F.array(*[F.lit(h) for h in HEADERS[k]]), lambda h: F.contains(joined, h)) for k in ("award_date", "value")]
    indexed = cells.where(likely[0] & likely[1]).select("file", F.col("row_no").alias("header_row"), header_index("cells").alias("idx"))
    usable = indexed.where(F.col("idx.award_date").isNotNull() & F.col("idx.value").isNotNull())
    return keep_first(usable, ("file",), ("row", F.col("header_row")))


def file_rejects(cells: DataFrame) -> DataFrame:
    """(raw_file, reject_reason) of the files that have no header row and so give no notices."""
    bare = cells.select("file").distinct().join(header_rows(cells), "file", "left_anti")
    return bare.select(F.col("file").alias("raw_file"), F.lit("no header row").alias("reject_reason"))


def to_notices(cells: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Notices of all data rows, with ``reject_reason`` on rows without a date or an amount.

    ``resources`` (file, organization) fills in a missing agency.
    """
    rows = cells.join(header_rows(cells), "file").where(F.col("row_no") > F.col("header_row"))

    def cell(field: str) -> Column:
        return blank_to_null(F.get("cells", F.col(f"idx.{field}") - 1))

    picked = rows.select(
        "file", "row_no",
        *[cell(f).alias(f) for f in ("agency", "supplier", "title", "reference")],
        cal.parse_date_qld(cell("award_date")).alias("release_date"),
        parse_money(cell("value")).alias("amount"),
    )
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("agency", "supplier", "title")]
    described = F.coalesce("agency", "supplier", "title").isNotNull()
    made_up = F.concat_ws("-", F.lit("qld"), cal.month_label("release_date"), F.col("row_no").cast("string"))
    contract = F.coalesce(
        F.col("reference"), F.when(described, strip(F.concat_ws(" | ", *parts))), made_up
    )
    flat = picked.select(
        F.lit("qld").alias("source"), contract.alias("contract_id"),
        F.concat_ws("#", "file", F.col("row_no").cast("string")).alias("release_id"),
        contract.alias("ocid"), "supplier", "agency", "title", "amount", "release_date",
        F.col("file").alias("raw_file"), F.col("row_no").alias("raw_row"),
    )
    if resources is not None:
        owners = resources.select(F.col("file").alias("raw_file"), F.col("organization").alias("_owner"))
        flat = flat.join(owners, "raw_file", "left").withColumn("agency", F.coalesce("agency", "_owner"))
    reason = F.when(F.col("release_date").isNull(), "no date").when(
        F.coalesce(F.col("amount") <= 0, F.lit(True)), "value not positive"
    )
    return finish(flat.withColumn("reject_reason", reason))


def distinct_disclosures(notices: DataFrame) -> DataFrame:
    """One row per contract, day and amount: agencies publish the same row in several files."""
    dated = notices.withColumn("_day", F.to_date("release_date"))
    kept = keep_first(
        dated, ("source", "contract_id", "_day", "amount"),
        ("file", F.col("raw_file")), ("row", F.col("raw_row")),
    )
    return kept.drop("_day")
