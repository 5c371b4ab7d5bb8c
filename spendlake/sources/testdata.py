"""Contract notices derived from the star-schema tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.calendar import financial_year, month_label
from spendlake.functions.text import partition_key
from spendlake.schemas import NOTICE_COLUMNS
from spendlake.session import prepare

SOURCES = ("federal", "nsw", "vic", "qld", "sa", "wa")

_BUYER = {"source", "agency", "agency_key"}
_SUPPLIER = {"supplier", "company_key"}
_TITLE = {"title"}


# Known schemas save a footer read per scan; other tables are inferred.
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = prepare(spark).read
    reader = reader.schema(TABLES[name]) if name in TABLES else reader
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str, *columns: str, dealt: bool = False) -> DataFrame:
    """Notices with the given columns (all when none are named).

    Every row is one line item. The dimension tables join on unique keys and from the left, so a
    dimension whose columns are not asked for is not joined at all.

    ``dealt`` spreads the line items over all tasks by their order before the joins, as landed payloads are dealt over
    files: rendering and reading payloads is most of the work, and the scan gives as many tasks as the tables have row
    groups. The join with orders needs the items there anyway, so nothing is shuffled for it.
    """
    contract = F.concat(F.lit("CN"), F.col("l_orderkey").cast("string"))
    shipped = F.col("l_shipdate").cast("timestamp")
    release = F.concat_ws(
        "-", contract, F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.date_format(shipped, "yyyyMMdd"),
    )
    # Names and keys are built on the dimension side of a join: once per entity, not once per row.
    exprs: dict[str, Column] = {
        **{c: F.col(c) for c in ("source", "supplier", "agency", "title", "agency_key", "company_key")},
        "contract_id": contract,
        "release_id": release,
        "ocid": F.concat(F.lit("ocds-"), F.col("l_orderkey").cast("string")),
        "amount": F.col("l_extendedprice").cast("decimal(18,2)"),
        "release_date": shipped,
        "contract_end": F.date_add(shipped.cast("date"), F.col("l_quantity").cast("int")),
        "tag": F.when(F.col("l_linenumber") == 1, "contract").otherwise("contractAmendment"),
        "fy": financial_year(shipped),
        "month": month_label(shipped),
        "raw_file": F.lit(None).cast("string"),
        "raw_row": F.lit(None).cast("long"),
    }
    wanted = list(columns) or NOTICE_COLUMNS
    df = table(spark, sf_dir, "lineitem")
    if dealt:
        df = df.repartition("l_orderkey")
    if _BUYER & set(wanted):
        agency = F.concat(F.lit("Department of "), F.col("c_mktsegment"))
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customers = table(spark, sf_dir, "customer").select(
            "c_custkey",
            F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("c_nationkey") % 6).alias("source"),
            agency.alias("agency"), partition_key(agency).alias("agency_key"),
        )
        # Orders meet their customers first, so the line items, which are many more, are shuffled once for both.
        buyers = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").drop("o_custkey", "c_custkey")
        df = df.join(buyers, df["l_orderkey"] == buyers["o_orderkey"], "left")
    if _SUPPLIER & set(wanted):
        supplier = F.concat(F.col("s_name"), F.lit(" Pty Ltd"))
        suppliers = table(spark, sf_dir, "supplier").select(
            "s_suppkey", supplier.alias("supplier"), partition_key(supplier).alias("company_key")
        )
        df = df.join(suppliers, df["l_suppkey"] == suppliers["s_suppkey"], "left")
    if _TITLE & set(wanted):
        parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
        df = df.join(parts, df["l_partkey"] == parts["p_partkey"], "left")
    return df.select(*[exprs[c].alias(c) for c in wanted])
