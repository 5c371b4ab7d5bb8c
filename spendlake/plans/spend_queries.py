"""Registered queries on the notice table: totals, search, versions, entities, batch lookups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.entity import entity_identifier, entity_tokens
from spendlake.functions.text import partition_key
from spendlake.operators import batch, entities, search, spend, versions
from spendlake.operators.filters import SpendFilter, notice_predicate
from spendlake.plans.answers import answer_questions
from spendlake.sources.disclosure import distinct_disclosures
from spendlake.sources.notice import first_listed
from spendlake.session import scratch_path, staged
from spendlake.sources import lake
from spendlake.sources.testdata import notices, table

NOW = date(2002, 1, 1)
# "supplier#0000000" is part of many supplier names at every scale factor.
WIDE_FILTER = SpendFilter(
    keyword="widget", company="supplier#0000000", agency="Department of Machinery",
    start=date(1996, 1, 1), end=date(2001, 6, 30),
)
PORTAL_FILTER = SpendFilter(
    keyword="Ring", company="supplier#0000000", agency="building", start=date(1996, 1, 1), end=date(1999, 12, 31)
)


def spend_by_fy_agency_top20(spark: SparkSession, sf: str) -> DataFrame:
    return spend.spend_by_year_and_agency(notices(spark, sf, "fy", "agency", "amount"), 20)


def total_spend_filtered(spark: SparkSession, sf: str) -> DataFrame:
    f = SpendFilter(
        company="Supplier 000000007 Limited", agency="Dept. of Machinery", source="Victoria",
        start=date(1996, 1, 1), end=date(2000, 6, 30),
    )
    return spend.total_spend(notices(spark, sf), f)


def total_spend_default_source(spark: SparkSession, sf: str) -> DataFrame:
    return spend.total_spend(notices(spark, sf), SpendFilter(agency="furniture"))


def total_spend_all_versions(spark: SparkSession, sf: str) -> DataFrame:
    return spend.total_all_versions(notices(spark, sf), SpendFilter(agency="Department of Building", source="nsw"))


def latest_contract_versions(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("source", "contract_id", "release_id", "supplier", "agency", "title", "amount", "release_date", "tag")
    latest = versions.latest_versions(notices(spark, sf, *cols))
    return latest.withColumn("amount", spend.as_double("amount")).withColumn("release_date", F.to_date("release_date"))


def contract_version_flags(spark: SparkSession, sf: str) -> DataFrame:
    cols = ("source", "contract_id", "release_id", "amount", "release_date")
    flags = versions.version_flags(notices(spark, sf, *cols))
    return flags.withColumn("amount", spend.as_double("amount")).withColumn("release_date", F.to_date("release_date"))


def search_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_contracts(notices(spark, sf), WIDE_FILTER, 100)


def search_all_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Without a limit every match is returned."""
    return search.search_contracts(notices(spark, sf), WIDE_FILTER)


def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_summary(notices(spark, sf), WIDE_FILTER, 25)


def search_sorted_by_title(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_contracts(notices(spark, sf), WIDE_FILTER, 60)
    return search.sort_results(found, "title").limit(25)


def search_export(spark: SparkSession, sf: str) -> DataFrame:
    return search.export_frame(search.search_contracts(notices(spark, sf), WIDE_FILTER, 40))


def portal_notice_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = notices(spark, sf).where(notice_predicate(PORTAL_FILTER))
    return kept.select(
        "source", "release_id", "supplier", "title", spend.as_double("amount"),
        F.to_date("release_date").alias("release_date"), "contract_end",
    )


def monthly_spend(spark: SparkSession, sf: str) -> DataFrame:
    return spend.monthly_spend(notices(spark, sf, "source", "month", "amount"))


def replayed_load_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly totals of a lake into which the same notices were loaded twice."""
    path = scratch_path(spark, "replayed")
    for _ in range(2):
        lake.write(notices(spark, sf), path, finished=True)
    return spend.monthly_spend(lake.read(spark, path))


def incremental_union_total(spark: SparkSession, sf: str) -> DataFrame:
    """Stored years and a fresh load that overlaps them by six months."""
    rows = notices(spark, sf, "source", "contract_id", "release_id", "amount", "release_date")
    day = F.to_date("release_date")
    stored = rows.where(day < F.lit(date(1999, 7, 1)))
    fresh = rows.where(day >= F.lit(date(1999, 1, 1)))
    return spend.incremental_total(stored, fresh)


def dedupe_composite(spark: SparkSession, sf: str) -> DataFrame:
    """The same notice read from two files counts once per contract, day and amount."""
    rows = notices(spark, sf, "source", "contract_id", "release_id", "amount", "release_date")
    first = rows.withColumn("raw_file", F.lit("a.csv")).withColumn("raw_row", F.lit(1))
    again = rows.withColumn("raw_file", F.lit("b.csv")).withColumn("raw_row", F.lit(2))
    kept = distinct_disclosures(first.unionByName(again))
    grouped = kept.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("total"))
    return grouped.select("source", "records", spend.as_double("total", "total_amount"))


def first_listed_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Page order here is title, then line order of the release id."""
    rows = notices(spark, sf, "source", "contract_id", "release_id", "title", "amount")
    paged = rows.withColumn("raw_file", F.col("title")).withColumn("raw_row", F.col("release_id"))
    kept = first_listed(paged)
    return kept.select("source", "contract_id", "release_id", "title", spend.as_double("amount"))


def messy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Four spellings of every customer and supplier name."""
    names = table(spark, sf, "customer").select(F.col("c_name").alias("base")).unionByName(
        table(spark, sf, "supplier").select(F.col("s_name").alias("base"))
    )
    spellings = F.array(
        F.concat("base", F.lit(" Pty Ltd")),
        F.concat(F.lit("  The Dept. of "), "base", F.lit(" & Co.  LIMITED")),
        F.concat(F.lit("GOVT Svcs @ "), F.upper("base"), F.lit("/Tech-Corp")),
        F.concat_ws(" ", F.lit("Limited"), F.lit("To"), F.lit("For"), F.regexp_replace("base", "[^#]", "")),
    )
    return names.select(F.explode(spellings).alias("name"))


def entity_tokens_identifier(spark: SparkSession, sf: str) -> DataFrame:
    return messy_names(spark, sf).select(
        "name",
        F.array_join(entity_tokens("company", "name"), " ").alias("company_tokens"),
        entity_identifier("company", "name").alias("company_id"),
        F.array_join(entity_tokens("agency", "name"), " ").alias("agency_tokens"),
        entity_identifier("agency", "name").alias("agency_id"),
    )


def sanitize_partition_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of every conversation turn and messy name."""
    texts = table(spark, sf, "conversations").select("text").unionByName(
        messy_names(spark, sf).select(F.col("name").alias("text"))
    )
    return texts.select("text", partition_key("text").alias("key"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return entities.entity_catalog(
        notices(spark, sf, "source", "fy", "month", "agency", "agency_key", "supplier", "company_key")
    )


def entity_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf)


def find_agencies(spark: SparkSession, sf: str) -> DataFrame:
    return entities.find_entities(_catalog(spark, sf), "agency", "Dept of Furniture", limit=10)


def find_companies(spark: SparkSession, sf: str) -> DataFrame:
    return entities.find_entities(_catalog(spark, sf), "company", "The Supplier 000000001 Limited", "NSW", limit=20)


def find_companies_top(spark: SparkSession, sf: str) -> DataFrame:
    return entities.find_entities(_catalog(spark, sf), "company", limit=50)


def resolve_entities_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Best catalogue supplier for one loosely written name per supplier."""
    queries = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("query_id"),
        F.concat(F.lit("the "), F.regexp_replace("s_name", "#", " "), F.lit(" & Ltd")).alias("text"),
    )
    return entities.best_candidates(queries, _catalog(spark, sf), "company", "query_id", "text")


def lookup_filters(spark: SparkSession, sf: str) -> DataFrame:
    """One filter per supplier and customer segment, in loose spelling, with its own dates."""
    suppliers = table(spark, sf, "supplier")
    name = F.regexp_replace("s_name", "#", " ")
    start = F.date_add(F.lit(date(1995, 1, 1)), F.pmod("s_suppkey", F.lit(900)).cast("int"))
    by_company = suppliers.select(
        F.concat(F.lit("c"), "s_suppkey").alias("filter_id"),
        F.concat(F.lit("The "), name, F.lit(" Limited")).alias("company"),
        F.when(F.col("s_acctbal") > 5000, "dept of machinery").alias("agency"),
        F.when(F.col("s_nationkey") < 5, "Victoria").alias("source"),
        start.alias("start"), F.date_add(start, 1000).alias("end"),
    )
    by_agency = table(spark, sf, "customer").select("c_mktsegment").distinct().select(
        F.concat(F.lit("a-"), "c_mktsegment").alias("filter_id"),
        F.lit(None).cast("string").alias("company"), F.lower("c_mktsegment").alias("agency"),
        F.lit("qld").alias("source"), F.lit(date(1997, 7, 1)).alias("start"), F.lit(date(1998, 6, 30)).alias("end"),
    )
    return by_company.unionByName(by_agency)


def batch_spend_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = batch.batch_total_spend(lookup_filters(spark, sf), notices(spark, sf))
    return found.select("filter_id", "contracts", spend.as_double("total", "total_spend"))


def keyword_spend_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One keyword filter per distinct word of the part names."""
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    filters = words.select(F.concat(F.lit("k-"), "keyword").alias("filter_id"), F.upper("keyword").alias("keyword"))
    found = batch.batch_total_spend(filters, notices(spark, sf), with_keywords=True)
    return found.select("filter_id", "contracts", spend.as_double("total", "total_spend"))


def entity_semi_join_spend(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy names tested on the catalogue, then a semi join into the rows."""
    f = SpendFilter(company="Supplier#0000000", agency="Dept of Machinery", start=date(1996, 7, 1), end=date(2001, 6, 30))
    rows = f.apply_with_catalog(notices(spark, sf), _catalog(spark, sf))
    grouped = rows.groupBy("source", "fy").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("records"))
    return grouped.select("source", "fy", spend.as_double("total", "total_amount"), "records")


def spend_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per supplier; its key picks the phrasing and its customer namesake, if any, the agency."""
    suppliers, customers = table(spark, sf, "supplier"), table(spark, sf, "customer")
    joined = suppliers.join(
        customers.select("c_custkey", "c_mktsegment"), suppliers["s_suppkey"] == customers["c_custkey"], "left"
    ).withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("BUILDING")))
    spaced = F.regexp_replace("s_name", "#", " ")
    texts = F.array(
        F.concat(F.lit("How much did the Department of "), "c_mktsegment", F.lit(" spend on "), spaced, F.lit("?")),
        F.concat(F.lit("how much was spent on "), spaced, F.lit(" by Dept of "), "c_mktsegment", F.lit(" ?")),
        F.concat(F.lit("How much was spent by the Department of "), "c_mktsegment", F.lit("?")),
        F.concat(F.lit("How much was spent on "), spaced),
        F.concat(F.lit("Show Queensland spending with “"), "s_name", F.lit("”")),
        F.lit("Gear!"),
    )
    return joined.select(
        F.col("s_suppkey").alias("question_id"),
        F.get(texts, F.pmod("s_suppkey", F.lit(6)).cast("int")).alias("text"),
        F.when(F.col("s_nationkey") < 8, "New South Wales").alias("source"),
    )


def answer_spend_questions(spark: SparkSession, sf: str) -> DataFrame:
    catalog = staged(_catalog(spark, sf), "catalog")
    answers = answer_questions(spend_questions(spark, sf), notices(spark, sf), catalog, NOW)
    return answers.select("question_id", "company", "agency", "keyword", "source", "contracts", "total_spend", "answer")


QUERIES = {
    f.__name__: f
    for f in (
        spend_by_fy_agency_top20, total_spend_filtered, total_spend_default_source, total_spend_all_versions,
        latest_contract_versions, contract_version_flags, search_contracts, search_all_rows, search_summary,
        search_sorted_by_title, search_export, portal_notice_filter, monthly_spend, incremental_union_total,
        dedupe_composite, replayed_load_totals, first_listed_contracts, entity_tokens_identifier, sanitize_partition_keys,
        entity_catalog, find_agencies, find_companies, find_companies_top, resolve_entities_batch,
        batch_spend_lookup, keyword_spend_lookup, entity_semi_join_spend, answer_spend_questions,
    )
}
