"""Registered queries on dates, load windows, coverage and saved results."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions.jurisdiction import canonical_source, detect_source
from spendlake.functions.money import format_money, parse_money, parse_money_or_zero, parse_money_strict
from spendlake.operators import coverage, snapshots
from spendlake.operators.spend import as_double
from spendlake.sources.portals import supplier_term_class
from spendlake.sources.testdata import SOURCES, notices, table

NOW = date(2002, 1, 1)


def load_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One load request per customer: its jurisdiction and the days of its first and last order."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end")
    )
    buyers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(buyers, orders["o_custkey"] == buyers["c_custkey"])
    return joined.select(
        F.col("c_custkey").alias("request_id"),
        F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("c_nationkey") % 6).alias("source"),
        "start", "end",
    )


def finished_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Load ledger: the months in which a source published at least its monthly average."""
    monthly = notices(spark, sf, "source", "month").groupBy("source", "month").agg(F.count(F.lit(1)).alias("rows"))
    overall = monthly.groupBy("source").agg(F.sum("rows").alias("all_rows"), F.count(F.lit(1)).alias("months"))
    busy = monthly.join(overall, "source").where(F.col("rows") * F.col("months") >= F.col("all_rows"))
    return busy.select("source", "month")


def month_windows(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.explode_windows(load_requests(spark, sf))


def day31_windows(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.explode_windows(load_requests(spark, sf), monthly=False)


def month_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.month_coverage(finished_loads(spark, sf))


def uncovered_months(spark: SparkSession, sf: str) -> DataFrame:
    covered = coverage.month_coverage(finished_loads(spark, sf))
    return coverage.missing_windows(month_windows(spark, sf), covered).select(
        "request_id", "source", "month", "window_start", "window_end"
    )


def coverage_complete(spark: SparkSession, sf: str) -> DataFrame:
    covered = coverage.month_coverage(finished_loads(spark, sf))
    return coverage.coverage_by_request(month_windows(spark, sf), covered, "request_id")


def window_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that fall into the missing windows of their source, summed per month."""
    span = notices(spark, sf, "source", "release_date").groupBy("source").agg(
        F.date_add(F.to_date(F.min("release_date")), 10).alias("start"),
        F.date_sub(F.to_date(F.max("release_date")), 10).alias("end"),
    )
    windows = coverage.missing_windows(coverage.explode_windows(span), finished_loads(spark, sf))
    rows = notices(spark, sf, "source", "month", "release_date", "amount")
    kept = coverage.rows_in_windows(rows, windows, ["source"])
    grouped = kept.groupBy("source", "month").agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("total"))
    return grouped.select("source", "month", "records", as_double("total", "total_amount"))


def load_jobs_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"))
    return coverage.load_jobs(suppliers, "1999-11-15", "2000-03-02", "supplier#0000000")


def resolved_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with a missing start, a missing end, or swapped ends, by account balance."""
    requests = load_requests(spark, sf).join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), "c_acctbal"), "request_id"
    )
    start = F.when(F.col("c_acctbal") >= 0, F.col("start"))
    end = F.when(F.col("c_acctbal") < 5000, F.col("end"))
    swapped = F.col("c_acctbal") >= 9000
    resolved = cal.resolve_range(
        F.when(swapped, F.col("end")).otherwise(start), F.when(swapped, F.col("start")).otherwise(end),
        F.lit(NOW), F.when(F.col("c_acctbal") < 2000, 3),
    )
    return requests.select("request_id", resolved["start"].alias("start"), resolved["end"].alias("end"))


def user_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written as users write them, by order priority."""
    day = F.col("o_orderdate").cast("timestamp")
    priority = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(priority == "1", F.date_format(day, "yyyy-MM-dd"))
        .when(priority == "2", F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(priority == "3", F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+10:00")))
        .when(priority == "4", F.date_format(day, "dd/MM/yyyy"))
        .otherwise("  ")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("raw"))
    parsed = cal.parse_user_date("raw")
    return rows.select(
        "o_orderkey", "raw", F.unix_seconds(parsed).alias("epoch"), cal.is_bad_user_date("raw").alias("is_bad")
    )


def date_parse_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Every ship date rendered in every layout and read back by every jurisdiction's parser.

    Rows of one date have the same texts, so a date is rendered and read once and counts with its rows.
    """
    day = F.col("release_date")
    serial = F.datediff(F.to_date(day), F.lit(date(1899, 12, 30)))
    layouts: dict[str, Column] = {
        "iso": F.date_format(day, "yyyy-MM-dd"),
        "slash": F.date_format(day, "dd/MM/yyyy"),
        "slash_short": F.date_format(day, "d/M/yyyy"),
        "dash_month": F.date_format(day, "d-MMM-yyyy"),
        "dash_month_short_year": F.date_format(day, "dd-MMM-yy"),
        "space_month": F.date_format(day, "dd MMM yyyy"),
        "long_month": F.date_format(day, "d MMMM yyyy"),
        "month_first": F.date_format(day, "MMM d yyyy"),
        "rfc3339": F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "midnight": F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00")),
        "serial": serial.cast("string"),
        "junk": F.concat(F.lit("n/a "), F.date_format(day, "yyyy")),
    }
    parsers = {
        "nsw": cal.parse_date_nsw, "vic": cal.parse_date_vic, "sa": cal.parse_date_sa, "wa": cal.parse_date_wa,
        "qld": cal.parse_date_qld, "catalogue": cal.parse_catalogue_time, "ocds": cal.parse_rfc3339,
    }
    rendered = F.array(*[F.struct(F.lit(n).alias("layout"), c.alias("text")) for n, c in layouts.items()])
    dates = notices(spark, sf, "release_date").groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    texts = dates.select(day, "n", F.explode(rendered).alias("r")).select(day, "n", "r.layout", "r.text")
    parsed = texts.select(
        day, "n", "layout", *[(parse("text") == day).alias(name) for name, parse in parsers.items()]
    )
    rows = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    hits = [rows(F.col(name)).alias(name) for name in parsers]
    misread = sum((rows(~F.col(name)) for name in parsers), F.lit(0))
    return parsed.groupBy("layout").agg(F.sum("n").alias("rows"), *hits, misread.alias("wrong"))


def money_parse_format(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts in messy spellings, read back and shown again; an amount is spelled and read once and counts with its rows."""
    plain = F.col("amount").cast("string")
    commas = F.format_number("amount", 2)
    spellings: dict[str, Column] = {
        "plain": plain,
        "dollars": F.concat(F.lit("$"), commas),
        "prefixed": F.concat(F.lit(" A$ "), commas, F.lit(" (inc. GST)")),
        "negative": F.concat(F.lit("-"), plain),
        "blank": F.lit("  "),
        "words": F.lit("to be advised"),
    }
    rendered = F.array(*[F.struct(F.lit(n).alias("spelling"), c.alias("text")) for n, c in spellings.items()])
    amounts = notices(spark, sf, "amount").groupBy("amount").agg(F.count(F.lit(1)).alias("n"))
    texts = amounts.select("n", F.explode(rendered).alias("r")).select("n", "r.spelling", "r.text")
    parsed = texts.select(
        "n", "spelling", parse_money("text").alias("lenient"), parse_money_or_zero("text").alias("or_zero"),
        parse_money_strict("text").alias("strict"),
    )
    rows = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0))
    total = lambda c: F.sum((F.col(c) * F.col("n")).cast("decimal(28,2)"))
    grouped = parsed.groupBy("spelling").agg(
        rows("lenient").alias("lenient_rows"), total("lenient").alias("lenient_sum"),
        total("or_zero").alias("zero_sum"), rows("strict").alias("strict_rows"),
        total("strict").alias("strict_sum"), F.max(format_money("lenient")).alias("top_shown"),
    )
    return grouped.select(
        "spelling", "lenient_rows", as_double("lenient_sum"), as_double("zero_sum"), "strict_rows",
        as_double("strict_sum"), "top_shown",
    )


# Loosely written jurisdictions; the last ones are unknown or blank.
SPELLINGS = (
    "Federal", "Commonwealth", "AusTender", "Australian  Government", "federal_government", "QLD", "Queensland",
    "qld-government", "Queensland Government.", "nsw", "New South Wales", "NSW/Government", "VIC", "victoria",
    "Victorian Government", "SA", "South Australia", "sa government", "WA", "Western Australia",
    "W.A. Government", "western australian government", "Tasmania", "Northern-Territory", "  ",
)


def canonical_sources(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), (F.col("c_custkey") % len(SPELLINGS)).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", spelled.alias("text"))
    return rows.select("c_custkey", "text", canonical_source("text").alias("source"))


def detect_jurisdiction(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn, with a jurisdiction named in it for most turns."""
    named = F.array(*[F.lit(s) for s in SPELLINGS])
    pick = F.get(named, ((F.col("conv_id") + F.col("turn")) % len(SPELLINGS)).cast("int"))
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws(" ", "text", F.lit("- spend in"), pick).alias("text")
    )
    found = rows.withColumn("found", detect_source("text"))
    return found.select("conv_id", "turn", F.col("found.source").alias("source"), F.col("found.evidence").alias("evidence"))


def supplier_search_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as 11-digit, 9-digit and other numbers, and names."""
    key = F.col("o_orderkey").cast("string")
    nine, eleven = F.lpad(key, 9, "1"), F.lpad(key, 11, "2")
    spaced = F.regexp_replace(eleven, r"^(\d\d)(\d{3})(\d{3})(\d{3})$", "$1 $2 $3 $4")
    terms = F.array(spaced, nine, key, F.concat(F.lit(" Order "), key))
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(terms).alias("term"))
    classed = rows.withColumn("c", supplier_term_class("term"))
    return classed.select("o_orderkey", "term", F.col("c.kind").alias("kind"), F.col("c.value").alias("value"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runs of a saved query: one keyword per event type, by user."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        ts.alias("run_at"), F.concat(F.lit("  User "), "user_id").alias("company"),
        F.upper("event_type").alias("keyword"), "value",
    )


def daily_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Runs per local day and fingerprint: the first computes the result, the others reuse it."""
    stamped = snapshots.daily_snapshot(_runs(spark, sf), F.col("run_at"))
    keyed = stamped.withColumn(
        "query_key",
        snapshots.fingerprint(
            F.col("snapshot_day"), company=F.col("company"), keyword=F.col("keyword"), source=F.lit("Federal"),
            lookback=F.lit(20),
        ),
    )
    grouped = keyed.groupBy("snapshot_day", "query_key").agg(
        F.count(F.lit(1)).alias("runs"), F.min(F.unix_micros("run_at")).alias("first_run"),
        F.max(F.unix_seconds("expires_at")).alias("expires"),
    )
    return grouped


def run_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Last run per query, and where a request over the first quarter of 2024 resumes."""
    runs = _runs(spark, sf).select(
        F.concat_ws("|", snapshots.normal_part("company"), snapshots.normal_part("keyword")).alias("query_key"),
        F.col("run_at").alias("run_end"),
    )
    requests = runs.select("query_key").distinct().select(
        "query_key", F.lit("2024-01-01").cast("timestamp").alias("start"),
        F.lit("2024-01-20").cast("timestamp").alias("end"),
    )
    resumed = snapshots.resume_points(requests, snapshots.last_checkpoints(runs))
    return resumed.select(
        "query_key", F.unix_micros("checkpoint").alias("checkpoint"), F.unix_micros("search_start").alias("search_start")
    )


QUERIES = {
    f.__name__: f
    for f in (
        month_windows, day31_windows, month_coverage, uncovered_months, coverage_complete, window_range_join,
        load_jobs_by_supplier, resolved_ranges, user_dates, date_parse_multi, money_parse_format,
        canonical_sources, detect_jurisdiction, supplier_search_terms, daily_snapshots, run_checkpoints,
    )
}
