"""Spend totals for a whole table of filters at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions.entity import resolve_entity
from spendlake.functions.jurisdiction import canonical_source
from spendlake.functions.text import blank_to_null
from spendlake.operators.entities import FIELDS, GRAM, match_entities
from spendlake.operators.versions import latest_versions
from spendlake.session import staged

#: The columns of the notices that a lookup reads.
LOOKUP_COLUMNS = (
    "source", "contract_id", "release_id", "supplier", "company_key", "agency", "agency_key", "title", "amount", "release_date",
)

#: The fields that a keyword is looked for in.
HAY_FIELDS = ("supplier", "title", "agency", "contract_id")

VALUE_GRAMS = f"""array_distinct(flatten(transform(sequence(1, {GRAM}), n ->
  transform(sequence(1, greatest(length(_value) - n + 1, 1)), i -> substring(_value, i, n)))))"""


def normal_filters(filters: DataFrame) -> DataFrame:
    """All filter columns present, texts lower-case, blank fields NULL, source canonical, range in order."""

    def text(c: str) -> Column:
        return F.lower(blank_to_null(c)) if c in filters.columns else F.lit(None).cast("string")

    def day(c: str) -> Column:
        return F.col(c).cast("timestamp") if c in filters.columns else F.lit(None).cast("timestamp")

    start, end = day("start"), day("end")
    swap = start > end
    return filters.select(
        "filter_id", text("keyword").alias("keyword"), text("company").alias("company"),
        text("agency").alias("agency"),
        F.when(text("source").isNotNull(), canonical_source(text("source"))).alias("source"),
        F.when(swap, end).otherwise(start).alias("start"), F.when(swap, start).otherwise(end).alias("end"),
    )


def _hay() -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in HAY_FIELDS]))


def _other_tests(filters_alias: str) -> Column:
    """Source, date and keyword tests of a joined (filter, notice) row."""
    f = lambda c: F.col(f"{filters_alias}.{c}")
    source = f("source").isNull() | (F.coalesce(F.col("n.source"), F.lit("federal")) == f("source"))
    dates = (f("start").isNull() | (F.col("n.release_date") >= f("start"))) & (
        f("end").isNull() | (F.col("n.release_date") <= f("end"))
    )
    keyword = f("keyword").isNull() | F.contains(F.col("n._hay"), F.lower(f("keyword")))
    return F.coalesce(source & dates & keyword, F.lit(False))


def _name_pairs(wanted: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """(_text, _name, _key): the stored names that match each text of ``wanted``.

    The distinct names and the pairs are written out: the match and the row joins read them
    several times, and none of those reads should scan the notices again. Without any text nothing is read.
    """
    name, key = FIELDS[kind]
    if wanted.where(F.col(kind).isNotNull()).isEmpty():
        text = F.lit(None).cast("string")
        return wanted.where(F.lit(False)).select(text.alias("_text"), text.alias("_name"), text.alias("_key"))
    distinct = names.select(F.coalesce(name, F.lit("")).alias("_name"), F.coalesce(key, F.lit("")).alias("_key")).distinct()
    resolved = staged(distinct, f"{kind}-names").withColumn("e", resolve_entity(kind, "_name", "_key"))
    # The stored name travels inside the entity, so the match needs no join to get it back.
    entities = resolved.select(F.struct("e.*", "_name", "_key").alias("entity"))
    pairs = match_entities(wanted, entities, kind, kind)
    return staged(pairs.select(F.col("text").alias("_text"), "entity._name", "entity._key"), f"{kind}-pairs")


def _same_entity(kind: str) -> Column:
    name, key = FIELDS[kind]
    same_name = F.coalesce(F.col(f"n.{name}"), F.lit("")) == F.col(f"{kind}._name")
    return same_name & (F.coalesce(F.col(f"n.{key}"), F.lit("")) == F.col(f"{kind}._key"))


def matching_rows(filters: DataFrame, notices: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(filter_id, notice columns) of every match of a company or agency, without a nested loop.

    The texts of the filters are matched against the distinct stored names (those of ``catalog``
    when there is one, else of the rows). The rows then join by name: on the supplier where the
    filter has a company, else on the agency. A filter with both keeps the rows whose agency is
    one of its agency names, by another equi-join, which filters with a company only pass. Source, date and keyword are tested on the
    joined rows. AQE's skew join splits a name that holds a large share of the rows.
    """
    wanted = staged(normal_filters(filters), "filters")
    names = notices if catalog is None else catalog
    n = notices.withColumn("_hay", _hay()).alias("n")
    company = _name_pairs(wanted, names, "company").alias("company")
    agency = _name_pairs(wanted, names, "agency").alias("agency")
    by_company = wanted.where(F.col("company").isNotNull()).alias("f").join(
        company, F.col("f.company") == F.col("company._text")
    )
    on_company = by_company.join(n, _same_entity("company")).where(_other_tests("f"))
    fits = on_company.join(agency, (F.col("f.agency") == F.col("agency._text")) & _same_entity("agency"), "left")
    fits = fits.where(F.col("f.agency").isNull() | F.col("agency._text").isNotNull())
    by_agency = wanted.where(F.col("company").isNull() & F.col("agency").isNotNull()).alias("f").join(
        agency, F.col("f.agency") == F.col("agency._text")
    )
    on_agency = by_agency.join(n, _same_entity("agency")).where(_other_tests("f"))
    columns = ["f.filter_id", *[f"n.{c}" for c in notices.columns]]
    return fits.select(*columns).unionByName(on_agency.select(*columns))


def keyword_rows(filters: DataFrame, notices: DataFrame) -> DataFrame:
    """Matches of the filters that have only a keyword.

    A searched text is four fields with spaces between, and nearly every row has another one; but a piece of a keyword
    without spaces can only stand within a field. So the distinct values of the fields are looked at, not the rows: each
    keyword takes its longest piece, and of that the gram that the fewest values have. Rows get the keywords of their
    four values by the values themselves, and the substring test on the whole text decides.
    """
    wanted = normal_filters(filters).where(
        F.col("company").isNull() & F.col("agency").isNull() & F.col("keyword").isNotNull()
    )
    value_of = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in HAY_FIELDS}
    values = reduce(DataFrame.unionByName, [notices.select(v.alias("_value")).distinct() for v in value_of.values()]).distinct()
    values = staged(values, "keyword-values")
    pieces = F.array_sort(F.split("keyword", " "), lambda a, b: F.length(b) - F.length(a))
    asked = wanted.select("keyword").distinct().withColumn("_piece", F.get(pieces, F.lit(0)))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_piece") - GRAM + 1, F.lit(1))), lambda i: F.substring("_piece", i, F.lit(GRAM)))
    probes = asked.select("keyword", "_piece", F.explode(F.array_distinct(cuts)).alias("_gram"))
    # Grams that nobody asks for leave before anything is shuffled by gram.
    grams = values.select("_value", F.explode(F.expr(VALUE_GRAMS)).alias("_gram"))
    found = staged(grams.join(probes.select("_gram").distinct(), "_gram", "left_semi"), "keyword-grams")
    volumes = found.groupBy("_gram").agg(F.count(F.lit(1)).alias("volume"))
    best = probes.join(volumes, "_gram", "left").groupBy("keyword", "_piece").agg(
        F.min(F.struct(F.coalesce("volume", F.lit(0)).alias("volume"), "_gram")).alias("best")
    ).where("best.volume > 0").select("keyword", "_piece", "best._gram")
    pairs = found.join(best, "_gram").where(F.contains("_value", F.col("_piece")))
    # A value holds no more pieces than it has substrings.
    pairs = staged(pairs.groupBy("_value").agg(F.collect_set("keyword").alias("_found")), "keyword-pairs")
    rows = notices.withColumn("_hay", _hay())
    for c, v in value_of.items():
        mine = pairs.select(F.col("_value").alias(f"_at_{c}"), F.col("_found").alias(f"_in_{c}"))
        rows = rows.join(mine, v == F.col(f"_at_{c}"), "left").drop(f"_at_{c}")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(f"_in_{c}", none) for c in HAY_FIELDS])))
    keyed = rows.select(*notices.columns, "_hay", F.explode(every).alias("_keyword")).alias("n")
    joined = keyed.join(wanted.alias("f"), F.col("n._keyword") == F.col("f.keyword"))
    return joined.where(_other_tests("f")).select("f.filter_id", *[F.col(f"n.{c}") for c in notices.columns])


def batch_total_spend(
    filters: DataFrame, notices: DataFrame, with_keywords: bool = False, catalog: DataFrame | None = None
) -> DataFrame:
    """(filter_id, contracts, total) on the latest matching version.

    Every filter keeps a row: zero without a match, NULL when it has no search term at all.
    Filters that have only a keyword need ``with_keywords``.
    """
    slim = notices.select(*LOOKUP_COLUMNS)
    # Equal filters are looked up once: the key of a lookup is the content of its filter.
    fields = ("keyword", "company", "agency", "source", "start", "end")
    keyed = normal_filters(filters).withColumn("_lookup", F.sha2(F.to_json(F.struct(*fields)), 256))
    lookups = keyed.select(F.col("_lookup").alias("filter_id"), *fields).distinct()
    hits = matching_rows(lookups, slim, catalog)
    if with_keywords:
        hits = hits.unionByName(keyword_rows(lookups, slim))
    slim_hits = hits.select("filter_id", "source", "contract_id", "amount", "release_date", "release_id")
    latest = latest_versions(slim_hits, ("filter_id", "source", "contract_id"))
    sums = latest.groupBy(F.col("filter_id").alias("_lookup")).agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("amount").alias("total")
    )
    zero = F.lit("0.00").cast("decimal(18,2)")
    terms = ["company", "agency"] + (["keyword"] if with_keywords else [])
    searched = F.coalesce(*terms).isNotNull()
    return keyed.join(sums, "_lookup", "left").select(
        "filter_id",
        F.when(searched, F.coalesce("contracts", F.lit(0))).alias("contracts"),
        F.when(searched, F.coalesce("total", zero)).alias("total"),
    )
