"""Registered queries on the source adapters and the lake.

The raw payloads (release JSON, catalogue JSON, disclosure cells, portal pages) are rendered by
Spark from the notice table, one payload per line item, and read back by the adapters.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.urls import notice_id, resolve_url
from spendlake.operators.entities import find_entities
from spendlake.operators.filters import SpendFilter
from spendlake.operators.spend import as_double, latest_amounts
from spendlake.session import scratch_path, spent_shuffles, staged
from spendlake.sources import catalogue, disclosure, file_index, lake, ocds, pages, portals
from spendlake.sources.notice import accepted, first_listed, reject_report, unite
from spendlake.sources.testdata import SOURCES, notices, table


def shown(df: DataFrame, *extra: str) -> DataFrame:
    """The comparable columns of adapter output."""
    return df.select(
        "contract_id", "supplier", "agency", "title", as_double("amount"),
        F.to_date("release_date").alias("release_date"), *extra,
    )


# --- OCDS --------------------------------------------------------------------------------------


#: Parts of one source while its pages are landed; tasks with little data are merged.
LANDING_SHARDS = 1024


def release_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON page per line item.

    First lines are contracts. Later lines are amendments, half with the amended value and half
    with the change. Undiscounted lines become planning releases, and some pages are errors.
    """
    return rendered_pages(notices(spark, sf, dealt=True))


def landed_pages(spark: SparkSession, sf: str, path: str) -> int:
    """Write the pages of each source as compressed lines; returns the number of files, which grows with the rows.

    Rows are dealt and sorted by source before they are rendered: a page is four times its row, and is never shuffled.
    """
    shard = F.pmod(F.xxhash64("release_id"), F.lit(LANDING_SHARDS))
    rows = notices(spark, sf).repartition("source", shard).sortWithinPartitions("source")
    with spent_shuffles(spark):
        rendered_pages(rows).write.partitionBy("source").option("compression", "gzip").text(path)
    return len(spark.read.text(path).inputFiles())


def rendered_pages(n: DataFrame) -> DataFrame:
    """``value, source``: the JSON page of each notice."""
    number = F.regexp_extract("release_id", r"^CN\d+-(\d+)-", 1).cast("int")
    half = (F.col("amount") / 2).cast("decimal(18,2)")
    is_first = number == 1
    amended = number % 2 == 0
    base = F.when(is_first, F.col("amount")).when(~amended, half)
    no_amount = F.lit(None).cast("decimal(18,2)")
    amendments = F.when(
        ~is_first,
        F.array(
            F.struct(
                F.concat("contract_id", F.lit("-A"), number.cast("string")).alias("id"),
                F.when(amended, F.col("amount")).otherwise(no_amount).alias("amendedValue"),
                F.when(~amended, F.col("amount") - half).otherwise(no_amount).alias("contractamendmentvalue"),
            )
        ),
    )
    contract_name = F.when(is_first, F.col("contract_id")).when(
        amended, F.concat("contract_id", F.lit("-A"), number.cast("string"))
    )
    tag = F.when(F.col("contract_end") == F.date_add(F.to_date("release_date"), 1), "planning").otherwise(F.col("tag"))
    release = F.struct(
        F.col("release_id").alias("id"), "ocid",
        F.date_format("release_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.array(tag).alias("tag"),
        F.array(
            F.struct(F.col("agency").alias("name"), F.array(F.lit("procuringEntity")).alias("roles")),
            F.struct(F.col("supplier").alias("name"), F.array(F.lit("Supplier")).alias("roles")),
        ).alias("parties"),
        F.struct(F.col("title").alias("description")).alias("tender"),
        F.array(
            F.struct(
                contract_name.alias("id"), "title", F.lit("supply of goods").alias("description"),
                F.when(base.isNotNull(), F.struct(base.alias("amount"))).alias("value"),
                amendments.alias("amendments"),
            )
        ).alias("contracts"),
    )
    failed = F.col("contract_end") == F.date_add(F.to_date("release_date"), 2)
    page = F.when(failed, F.to_json(F.struct(F.lit(500).alias("errorCode"), F.lit("upstream").alias("message")))).otherwise(
        F.to_json(F.struct(F.array(release).alias("releases")))
    )
    return n.select(page.alias("value"), "source")


def _ocds(spark: SparkSession, sf: str, f: SpendFilter | None = None) -> DataFrame:
    packages = ocds.parse_packages(release_pages(spark, sf))
    return ocds.to_notices(ocds.releases(packages), f=f)


def ocds_notices(spark: SparkSession, sf: str) -> DataFrame:
    return shown(accepted(_ocds(spark, sf)), "source", "release_id", "ocid", "tag", "fy", "month")


def ocds_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected releases and error pages by reason, counted in one pass over the pages."""
    packages = ocds.parse_packages(release_pages(spark, sf))
    return reject_report(ocds.to_notices(ocds.releases_and_errors(packages)))


def ocds_filtered_total(spark: SparkSession, sf: str) -> DataFrame:
    """Latest-version spend per source over raw releases that pass a substring filter."""
    f = SpendFilter(keyword="SUPPLY of", company="supplier#0000000", agency="machinery")
    totals = latest_amounts(accepted(_ocds(spark, sf, f))).groupBy("source").agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("amount").alias("total")
    )
    return totals.select("source", "contracts", as_double("total", "total_spend"))


# --- catalogue ---------------------------------------------------------------------------------


def catalogue_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One catalogue page per part, with four resources of different formats and URLs."""
    key = F.col("p_partkey").cast("string")
    host = F.lit("https://data.example.test/")

    def resource(suffix: str, fmt: str, url: Column, modified: Column, created: str) -> Column:
        return F.struct(
            F.concat(F.lit("res-"), key, F.lit(suffix)).alias("id"), F.concat(F.lit("pkg-"), key).alias("package_id"),
            F.col("p_name").alias("name"), url.alias("url"), F.lit(fmt).alias("format"),
            modified.alias("last_modified"), F.lit(created).alias("created"),
        )

    day = F.date_format(F.date_add(F.lit(date(2024, 1, 1)), F.col("p_size")), "yyyy-MM-dd")
    found = F.array(
        resource("a", " CSV", F.concat(host, key, F.lit(".csv ")), F.concat(day, F.lit("T10:30:00.123456")), "2020-01-01"),
        resource("b", "XLSX", F.concat(F.lit("http://files.example.test/"), key), F.lit(""), "2023-05-06T07:08:09"),
        resource("c", "PDF", F.concat(host, key, F.lit(".pdf")), day, ""),
        resource("d", "xls", F.concat(F.lit("https://register"), key, F.lit(".xls/")), day, ""),
        # the same resource listed twice
        resource("a", "csv", F.concat(host, F.lit("z/"), key, F.lit(".csv")), F.lit("2019-01-01"), ""),
    )
    package = F.struct(
        F.concat(F.lit("pkg-"), key).alias("id"), F.concat(F.lit("set-"), key).alias("name"),
        F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("title")).alias("organization"),
        found.alias("resources"),
    )
    body = F.struct(
        F.lit(True).alias("success"), F.struct(F.lit(1).alias("count"), F.array(package).alias("results")).alias("result")
    )
    return table(spark, sf, "part").select(F.to_json(body).alias("value"))


def catalogue_resources(spark: SparkSession, sf: str) -> DataFrame:
    found = catalogue.resources(catalogue_pages(spark, sf))
    return found.select(
        "resource_id", "url", "format", "dataset_title", "organization",
        F.unix_seconds("last_modified").alias("modified"),
    )


def stale_resources(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest knows the CSV files as of mid January."""
    # Read as the catalogue and as the manifest: the pages are decoded once.
    found = staged(catalogue.resources(catalogue_pages(spark, sf)), "resources")
    manifest = found.where(F.col("format") == "csv").select(
        "resource_id", F.lit("2024-01-16 00:00:00").cast("timestamp").alias("last_modified")
    )
    return catalogue.stale_resources(found, manifest).select("resource_id", "format")


# --- disclosure CSV ----------------------------------------------------------------------------

# Layouts of our own; the header texts they hold are among those the adapter knows.
_LAYOUTS = (
    ("Agency", "Supplier name", "Award contract date", "Contract value", "Contract reference number", "Contract description"),
    ("Line", "Contract", "Description of purchase", "Contract Party", "Notes", "Revised Value (inc)", "Start Date", "Ends"),
    ("Title of works", "Vendor legal name", "Commencement date (dd/mm/yyyy)", "Total amount AUD", "Purchasing department"),
)


def disclosure_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cell rows of one file per financial year and header layout, with a preamble in some files."""
    n = notices(spark, sf, "contract_id", "release_id", "supplier", "agency", "title", "amount", "release_date", "fy", dealt=True)
    line = F.regexp_extract("release_id", r"^CN\d+-(\d+)-", 1).cast("int")
    order_no = F.regexp_extract("contract_id", r"(\d+)", 1).cast("long")
    day = F.col("release_date")
    money = F.concat(F.lit("$"), F.format_number("amount", 2))
    blank = F.lit("")
    cells = (
        F.when(line % 3 == 0, F.array("agency", "supplier", F.date_format(day, "yyyy-MM-dd"), money, "contract_id", "title"))
        .when(
            line % 3 == 1,
            F.array(blank, F.col("contract_id"), F.col("title"), F.col("supplier"), blank, money,
                    F.date_format(day, "d/MM/yyyy"), blank),
        )
        .otherwise(F.array(F.col("title"), F.col("supplier"), F.date_format(day, "d MMM yyyy"), money))
    )
    layout = (line % 3).cast("string")
    file = F.concat(F.lit("fy-"), "fy", F.lit("-"), layout, F.lit(".csv"))
    # Data rows start below the header rows.
    row_no = order_no * 8 + line + 30
    data = n.select(file.alias("file"), row_no.alias("row_no"), cells.alias("cells"), layout.alias("layout"))
    files = data.select("file", "layout").distinct()
    headers = F.array(*[F.array(*[F.lit(h) for h in headers]) for headers in _LAYOUTS])
    top = F.array(
        F.struct(F.lit(1).cast("long").alias("row_no"), F.array(F.lit("Contract disclosure report")).alias("cells")),
        F.struct(F.lit(3).cast("long").alias("row_no"), F.get(headers, F.col("layout").cast("int")).alias("cells")),
    )
    leading = files.select("file", F.explode(top).alias("t")).select("file", "t.row_no", "t.cells")
    return data.select("file", "row_no", "cells").unionByName(leading)


def csv_header_mapping(spark: SparkSession, sf: str) -> DataFrame:
    # The cells are read for the headers, the rows and the owners: they are computed once.
    cells = staged(disclosure_cells(spark, sf), "cells")
    owners = cells.select("file").distinct().withColumn("organization", F.lit("Department of Works"))
    found = accepted(disclosure.to_notices(cells, owners))
    return shown(found, "release_id", "raw_file", "month")


# --- portal pages ------------------------------------------------------------------------------


def _portal_rows(spark: SparkSession, sf: str, only: str | None) -> DataFrame:
    """All line items as a portal would list them, or those of one jurisdiction."""
    rows = notices(
        spark, sf, "source", "contract_id", "release_id", "supplier", "agency", "title", "amount", "release_date", "contract_end"
    )
    # As landed pages are dealt over files: the scan gives as many tasks as the tables have row groups.
    return (rows.where(F.col("source") == only) if only else rows).repartition("release_id")


def _page(source: str, url: Column, *parts: str | Column) -> list[Column]:
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return [F.lit(source).alias("source"), url.alias("url"), html.alias("html")]


def _money() -> Column:
    return F.concat(F.lit("$"), F.format_number("amount", 2))


def _portal_shown(df: DataFrame) -> DataFrame:
    return shown(accepted(df), "source", "release_id", "contract_end")


def nsw_listing(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    """Cards: the notice id is in the link, the award id in the details."""
    rows = _portal_rows(spark, sf, only)
    day = lambda c: F.date_format(c, "d-MMM-yyyy")
    return rows.select(
        *_page(
            "nsw", F.concat(F.lit("https://portal.example.test/search?n="), "release_id"),
            "<ul class='profiles cards'><li><h3><a href='/notices/", F.col("release_id"), "'> ", F.col("title"),
            " </a></h3><dl class='details'><dt>Agency</dt><dd> ", F.col("agency"),
            "</dd><dt>Contractor Name<dd>", F.regexp_replace("supplier", " ", "\n  "), "<dt>Publish Date</dt><dd>",
            day("release_date"), "</dd><dt>Contract Period</dt><dd>", day("release_date"), " to ", day("contract_end"),
            "</dd><dt>Estimated amount payable to the contractor (including GST)</dt><dd>", _money(),
            "</dd><dt>CAN ID</dt><dd>", F.when(F.col("amount") > 50000, F.col("contract_id")).otherwise(""),
            "</dd></dl></li></ul>",
        )
    )


def portal_nsw_notices(spark: SparkSession, sf: str) -> DataFrame:
    return _portal_shown(portals.nsw_notices(pages.extract_listings(nsw_listing(spark, sf))))


def vic_listing(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    """A results table with two rows, the second of them malformed; names are on the detail page."""
    rows = _portal_rows(spark, sf, only)
    day = lambda c: F.date_format(c, "d MMM yyyy")
    return rows.select(
        *_page(
            "vic", F.concat(F.lit("https://portal.example.test/list/"), "release_id"),
            "<table><thead><tr><th>Contract<th>Title<th>Status<th>Start<th>End<th>Total Value</tr></thead><tbody><tr><td>",
            "<b class='tablesaw-cell-label'>Contract</b><span class='tablesaw-cell-content'>", F.col("contract_id"),
            "</span></td><td><a href='../view?id=", F.col("release_id"), "'>", F.col("title"), "</a></td><td>Current</td><td>",
            day("release_date"), "</td><td>", day("contract_end"), "</td><td>AUD ", F.format_number("amount", 2),
            "</td></tr><tr><td>n/a</td><td>x</td><td></td><td>soon</td><td></td><td>1</td></tr></tbody></table>",
        )
    )


def vic_detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _portal_rows(spark, sf, None)
    return rows.select(
        *_page(
            "vic", F.concat(F.lit("https://portal.example.test/view?id="), "release_id"),
            "<html><body><div>Public Body</div> <p>", F.col("agency"), "</p> <p>Contract Number ", F.col("contract_id"),
            "</p> <h2>Supplier Information</h2> 1 ", F.col("supplier"), " ABN 11 222 333 444 Powered by x</body></html>",
        )
    )


def portal_vic_notices(spark: SparkSession, sf: str) -> DataFrame:
    details = portals.vic_details(pages.extract_details(vic_detail_pages(spark, sf)))
    return _portal_shown(portals.vic_notices(pages.extract_listings(vic_listing(spark, sf)), details))


def sa_listing(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    """A menu table before the results table; the award date is missing for small amounts."""
    rows = _portal_rows(spark, sf, only)
    awarded = F.when(F.col("amount") > 30000, F.date_format("release_date", "dd/MM/yyyy")).otherwise("")
    return rows.select(
        *_page(
            "sa", F.concat(F.lit("https://portal.example.test/search?p="), "release_id"),
            "<table><tr><th>Title</th></tr><tr><td>a</td></tr><tr><td>b</td></tr></table><table><thead><tr>",
            "<th>Contract  Reference</th><th>Description</th><th>Buyer</th><th>Supplier</th><th>Start Date</th>",
            "<th>Awarded Date</th><th>Total Cost</th></tr></thead><tbody><tr><td><i class='tablesaw-cell-label'>Ref</i> ",
            F.col("contract_id"), "</td><td>", F.col("title"), "</td><td>", F.col("agency"), "</td><td>", F.col("supplier"),
            "</td><td>", F.date_format("release_date", "d MMMM yyyy"), "</td><td>", awarded, "</td><td>", _money(),
            "</td></tr><tr><td></td><td></td></tr></tbody></table>",
        )
    )


def portal_sa_notices(spark: SparkSession, sf: str) -> DataFrame:
    return _portal_shown(portals.sa_notices(pages.extract_listings(sa_listing(spark, sf))))


def wa_listing(spark: SparkSession, sf: str, only: str | None = None) -> DataFrame:
    rows = _portal_rows(spark, sf, only)
    return rows.select(
        *_page(
            "wa", F.concat(F.lit("https://portal.example.test/wa?n="), "release_id"),
            "<table id='contractTable'><tbody><tr><td>1</td><td><a href='/view?id=", F.col("release_id"), "'>",
            F.col("contract_id"), "</a></td><td>", F.col("title"), "</td><td>", F.col("agency"), "</td><td>",
            F.date_format("release_date", "dd/MM/yyyy"), "</td><td></td><td>", _money(), "</td></tr></tbody></table>",
        )
    )


def wa_detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Contract pages of the larger contracts only; the others stay without a supplier."""
    rows = _portal_rows(spark, sf, None).where(F.col("amount") > 40000)
    return rows.select(
        *_page(
            "wa", F.concat(F.lit("https://portal.example.test/view?id="), "release_id"),
            "<table><tr><td>1)</td><td><div>", F.col("supplier"), "</div></td></tr><tr><td>2)</td><td><div>Joint Co</div>",
            "<div>x</div></td></tr><tr><td>n)</td><td><div>no</div></td></tr></table>",
        )
    )


def portal_wa_notices(spark: SparkSession, sf: str) -> DataFrame:
    details = portals.wa_details(pages.extract_details(wa_detail_pages(spark, sf)))
    return _portal_shown(portals.wa_notices(pages.extract_listings(wa_listing(spark, sf)), details))


def all_sources_total(spark: SparkSession, sf: str) -> DataFrame:
    """Every adapter united in one notice table: first-listed portal rows, then spend per source.

    Only the columns that decide which row counts are compared and kept.
    """
    def listed(adapter, listing) -> DataFrame:
        only = listing.__name__.split("_")[0]
        rows = accepted(adapter(pages.extract_listings(listing(spark, sf, only))))
        return first_listed(rows.select("source", "contract_id", "amount", "raw_file", "raw_row"))

    portal_frames = [
        listed(portals.nsw_notices, nsw_listing), listed(portals.vic_notices, vic_listing),
        listed(portals.sa_notices, sa_listing), listed(portals.wa_notices, wa_listing),
    ]
    federal = accepted(_ocds(spark, sf))
    # The cells are read for the headers and for the rows: they are computed once.
    rows = accepted(disclosure.to_notices(staged(disclosure_cells(spark, sf), "cells")))
    qld = disclosure.distinct_disclosures(rows.select("source", "contract_id", "release_date", "amount", "raw_file", "raw_row"))
    both = unite([frame.select("source", "amount") for frame in (federal.withColumn("source", F.lit("federal")), qld, *portal_frames)])
    grouped = both.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("amount").alias("total"))
    return grouped.select("source", "records", as_double("total", "total_amount"))


def challenge_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole landed pages, with challenge markers in those of some sizes."""
    size = F.length("html") % 7
    html = (
        F.when(size == 0, F.concat(F.lit("<script>awsWafCookieDomainList=[]</script>"), "html"))
        .when(size == 1, F.concat("html", F.lit("<h1>Attention Required! | Cloudflare</h1>")))
        .when(size == 2, F.concat("html", F.lit("<h1>Attention required</h1>")))
        .otherwise(F.col("html"))
    )
    landed = table(spark, sf, "pages").select("page_id", html.alias("html"))
    return landed.select("page_id", pages.is_challenge("html").alias("blocked"))


def page_link_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Id of every page URL, and of a detail link resolved against it in five spellings."""
    landed = table(spark, sf, "pages").select("page_id", "url")
    href = F.array(
        F.lit("/contract/view?id=1"), F.lit("https://other.example.test/notices/"), F.lit("//cdn.example.test/a/b#c"),
        F.lit("?page=3"), F.lit("../up/./x.html"),
    )
    links = landed.select("page_id", "url", F.posexplode(href).alias("n", "href"))
    resolved = links.withColumn("link", resolve_url("url", "href"))
    return resolved.select("page_id", "n", "link", notice_id("url").alias("page_notice"), notice_id("link").alias("link_notice"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all landed pages, resolved; a url that is landed twice has the links of both pages."""
    found = pages.extract_links(table(spark, sf, "pages").select("url", "html"))
    links = found.select("url", F.explode_outer("hrefs").alias("href"))
    return links.groupBy("url").agg(
        F.count("href").alias("links"), F.max(resolve_url("url", "href")).alias("last_link")
    )


# --- lake --------------------------------------------------------------------------------------


def _written_lake(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "lake")
    lake.write(notices(spark, sf), path)
    return path


LAKE_FILTER = SpendFilter(
    company="supplier#0000000", agency="Dept of Machinery", source="Queensland",
    start=date(1997, 8, 1), end=date(1998, 3, 31),
)


def lake_roundtrip_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Write the lake, read it back through partition pruning."""
    rows = lake.search(spark, _written_lake(spark, sf), LAKE_FILTER)
    return rows.select("release_id", "supplier", "agency", as_double("amount"), "fy", "month")


def lake_file_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """A search that opens the files its index names, and those that were loaded after the index was written."""
    path, index = scratch_path(spark, "lake"), scratch_path(spark, "file-index")
    rows = notices(spark, sf)
    lake.write(rows.where(F.col("month") < "1999-01"), path, rows_per_file=2000)
    file_index.update_index(spark, path, index)
    lake.write(rows.where(F.col("month") >= "1999-01"), path, rows_per_file=2000)
    f = SpendFilter(
        company="supplier#00000000", agency="Dept of Machinery", source="Queensland", start=date(1997, 8, 1), end=date(1999, 12, 31)
    )
    found = file_index.search(spark, path, index, f)
    return found.select("release_id", "supplier", "agency", as_double("amount"), "fy", "month")


def lake_month_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Reload the months of one financial year with doubled amounts; the others stay."""
    path = _written_lake(spark, sf)
    again = notices(spark, sf).where(F.col("fy") == "1997-98")
    lake.write(again.withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)")), path, replace_months=True)
    grouped = lake.read(spark, path).groupBy("fy").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("records"))
    return grouped.select("fy", as_double("total", "total_amount"), "records")


def lake_sql(spark: SparkSession, sf: str) -> DataFrame:
    path = _written_lake(spark, sf)
    return lake.sql(
        spark, path,
        "SELECT source, agency, CAST(SUM(amount) AS DOUBLE) AS total_amount, COUNT(*) AS records "
        "FROM notices WHERE fy >= '1998-99' GROUP BY source, agency",
    )


def lake_catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rebuild the catalogue from the files of a lake and look suppliers up in it."""
    stored = lake.read(spark, _written_lake(spark, sf))
    return find_entities(lake.file_catalog(stored), "company", "Supplier 000000003", limit=10)


def lake_file_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per partition folder, counted per file and labelled from the path."""
    stored = lake.read(spark, _written_lake(spark, sf))
    files = lake.rows_per_file(stored).withColumn("p", lake.path_values("path"))
    return files.groupBy("p.source", "p.fy", "p.month").agg(F.sum("row_count").alias("records"))


QUERIES = {
    f.__name__: f
    for f in (
        ocds_notices, ocds_rejects, ocds_filtered_total, catalogue_resources, stale_resources, csv_header_mapping,
        portal_nsw_notices, portal_vic_notices, portal_sa_notices, portal_wa_notices, all_sources_total,
        challenge_pages, page_link_ids, page_links, lake_roundtrip_pruned, lake_file_pruned, lake_month_reload, lake_sql,
        lake_catalog_lookup, lake_file_rows,
    )
}
