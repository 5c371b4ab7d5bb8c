"""Open-data catalogue pages (JSON) to downloadable resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions.text import blank_to_null, strip
from spendlake.functions.urls import url_host
from spendlake.operators.versions import keep_first
from spendlake.schemas import CATALOGUE_PAGE

# Fixed values.
TABLE_FORMATS = ("csv", "xlsx", "xls")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def is_table_resource(fmt: Column, url: Column) -> Column:
    """A spreadsheet format behind an absolute http(s) URL with a real host name."""
    host = F.lower(url_host(url))
    return F.coalesce(
        fmt.isin(*TABLE_FORMATS) & F.contains(host, F.lit(".")) & ~host.rlike(r"\.(xlsx|xls|csv)$"),
        F.lit(False),
    )


def resources(pages: DataFrame, value: str = "value") -> DataFrame:
    """One row per resource id, the first by package and URL."""
    page = pages.select(F.from_json(value, CATALOGUE_PAGE).alias("page"))
    packages = page.select(F.explode("page.result.results").alias("p"))
    rows = packages.select("p.id", "p.title", "p.organization", F.explode("p.resources").alias("r"))
    flat = rows.select(
        F.col("r.id").alias("resource_id"),
        strip("r.url").alias("url"),
        F.lower(strip("r.format")).alias("format"),
        F.col("title").alias("dataset_title"),
        F.col("r.name").alias("resource_title"),
        F.coalesce(cal.parse_catalogue_time("r.last_modified"), cal.parse_catalogue_time("r.created")).alias(
            "last_modified"
        ),
        blank_to_null("organization.title").alias("organization"),
        F.col("id").alias("package_id"),
        F.col("r.size").alias("size"),
    )
    usable = flat.where(is_table_resource(F.col("format"), F.col("url")))
    return keep_first(usable, ("resource_id",), ("package", F.col("package_id")), ("url", F.col("url")))


def stale_resources(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Resources never read, or changed in the catalogue after they were last read."""
    seen = manifest.select("resource_id", F.col("last_modified").alias("_seen"))
    joined = found.join(seen, "resource_id", "left")
    stale = F.col("_seen").isNull() | (F.col("last_modified") > F.col("_seen"))
    return joined.where(stale).drop("_seen")


def content_manifest(files: DataFrame) -> DataFrame:
    """Manifest rows (path, size, sha-256) of a ``binaryFile`` scan."""
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"), "modificationTime")


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, content_hash, old_hash) of two manifests: ``new``, ``changed``, ``gone`` or ``same``.

    The content decides, so a file that was only touched is the same. Paths are unique in a manifest.
    """
    a = old.select("path", F.col("content_hash").alias("old_hash"))
    both = a.join(new.select("path", "content_hash"), "path", "full")
    change = (
        F.when(F.col("old_hash").isNull(), "new").when(F.col("content_hash").isNull(), "gone")
        .when(F.col("old_hash") != F.col("content_hash"), "changed").otherwise("same")
    )
    return both.select("path", change.alias("change"), "content_hash", "old_hash")
