"""The spend query: keyword, company, agency, source and date range as predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions.entity import EntityQuery, resolve_entity
from spendlake.functions.jurisdiction import canonical_source
from spendlake.functions.text import has_text


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


@dataclass(frozen=True)
class SpendFilter:
    """One search. Blank fields pass every row; ``end`` is inclusive."""

    keyword: str = ""
    company: str = ""
    agency: str = ""
    source: str = ""
    start: date | datetime | None = None
    end: date | datetime | None = None

    def __post_init__(self) -> None:
        if self.start and self.end and self._instant(self.start) > self._instant(self.end):
            raise ValueError("start date cannot be after end date")

    @staticmethod
    def _instant(day: date | datetime) -> datetime:
        return day if isinstance(day, datetime) else datetime(day.year, day.month, day.day)

    def require_term(self) -> SpendFilter:
        """A row search without any of the three text terms would return the whole lake."""
        if not (self.keyword.strip() or self.company.strip() or self.agency.strip()):
            raise ValueError("at least one of keyword, company or agency is required")
        return self

    def source_predicate(self) -> Column:
        if not self.source.strip():
            return F.lit(True)
        # Lake sources are canonical ids already, so the test stays a plain comparison that
        # prunes partitions; a missing source counts as federal.
        wanted = canonical_source(F.lit(self.source))
        return F.coalesce(F.col("source"), F.lit("federal")) == wanted

    def date_predicate(self, c: str = "release_date") -> Column:
        tests = []
        if self.start:
            tests.append(F.col(c) >= F.lit(self._instant(self.start)).cast("timestamp"))
        if self.end:
            tests.append(F.col(c) <= F.lit(self._instant(self.end)).cast("timestamp"))
        return _all(tests)

    def partition_predicate(self) -> Column:
        """Bounds on the partition columns that follow from the date range.

        Catalyst cannot derive them from ``release_date``; with them the scan lists only the
        matching ``fy``/``month`` folders.
        """
        tests = []
        for bound, low in ((self.start, True), (self.end, False)):
            if bound is None:
                continue
            day = F.lit(self._instant(bound)).cast("date")
            for column, label in (("fy", cal.financial_year(day)), ("month", cal.month_label(day))):
                tests.append(F.col(column) >= label if low else F.col(column) <= label)
        return _all(tests)

    def keyword_predicate(self) -> Column:
        hay = F.concat_ws(
            " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("supplier", "title", "agency", "contract_id")]
        )
        return has_text(hay, self.keyword)

    def entity_predicate(self, kind: str) -> Column:
        text, name, key = self._entity_fields(kind)
        if not text.strip():
            return F.lit(True)
        return EntityQuery.of(kind, text).matches(resolve_entity(kind, name, key))

    def _entity_fields(self, kind: str) -> tuple[str, str, str]:
        if kind == "company":
            return self.company, "supplier", "company_key"
        return self.agency, "agency", "agency_key"

    def to_column(self) -> Column:
        """The whole predicate on one row."""
        return _all(
            [
                self.source_predicate(),
                self.date_predicate(),
                self.keyword_predicate(),
                self.entity_predicate("company"),
                self.entity_predicate("agency"),
            ]
        )

    def apply(self, notices: DataFrame, partitioned: bool = False) -> DataFrame:
        """Matching rows in one pass over the scan, without a shuffle.

        ``partitioned`` says that ``fy`` and ``month`` are partition columns worth pruning on.
        """
        rows = notices.where(self.to_column())
        return rows.where(self.partition_predicate()) if partitioned else rows

    def apply_with_catalog(self, notices: DataFrame, catalog: DataFrame) -> DataFrame:
        """Matching rows of a lake, testing the fuzzy names on its entity catalogue only.

        The name work then grows with the number of entities instead of rows. The hits join back
        as a semi join, broadcast when Spark finds them small and shuffled otherwise.
        """
        rows = notices.where(self.source_predicate() & self.date_predicate() & self.partition_predicate())
        rows = rows.where(self.keyword_predicate())
        for kind in ("company", "agency"):
            text, name, key = self._entity_fields(kind)
            if not text.strip():
                continue
            hits = (
                catalog.where(self.source_predicate() & self.entity_predicate(kind))
                .select(F.coalesce(F.col(name), F.lit("")).alias("_name"), F.col(key).alias("_key"))
                .distinct()
            )
            same = (F.coalesce(rows[name], F.lit("")) == hits["_name"]) & (rows[key] == hits["_key"])
            rows = rows.join(hits, same, "left_semi")
        return rows


def release_predicate(release: Column, f: SpendFilter, supplier: Column, agency: Column) -> Column:
    """Filter on a raw release: the keyword may be in its ids, contract, tender or supplier text."""

    def joined(*parts: Column) -> Column:
        return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])

    contract, tender = F.get(release["contracts"], F.lit(0)), release["tender"]
    texts = [
        release["id"],
        release["ocid"],
        joined(contract["title"], contract["description"]),
        joined(tender["description"], tender["procurementMethodDetails"]),
        supplier,
    ]
    hit = F.lit(not f.keyword.strip())
    for text in texts:
        hit = hit | has_text(text, f.keyword) if f.keyword.strip() else hit
    return hit & has_text(supplier, f.company) & has_text(agency, f.agency)


def notice_predicate(f: SpendFilter) -> Column:
    """Filter of the portal loads: plain substrings and a date rule that knows the contract end.

    A release after the range still passes when its contract has ended by the end of the range.
    """
    hay = F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("contract_id", "title", "supplier", "agency")]
    )
    tests = [has_text(hay, f.keyword), has_text(F.col("supplier"), f.company), has_text(F.col("agency"), f.agency)]
    if f.start:
        tests.append(F.col("release_date") >= F.lit(f._instant(f.start)).cast("timestamp"))
    if f.end:
        end = F.lit(f._instant(f.end)).cast("timestamp")
        upper = F.col("contract_end").cast("timestamp")
        late = (F.col("release_date") > end) & (upper.isNull() | (upper > end))
        tests.append(~late)
    return F.coalesce(_all(tests), F.lit(False))


def lookback_start(now: date, years: int | None = None) -> date:
    """First day of the lookback period that ends on ``now``; 29 February becomes 1 March."""
    years = years if years and years > 0 else cal.DEFAULT_LOOKBACK
    first = date(now.year - years, now.month, 1)
    return first + timedelta(days=now.day - 1)
