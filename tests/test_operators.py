"""Filters, versions, totals, search, entities, batch lookups, coverage, lake and streaming."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlake.functions import entity
from spendlake.operators import batch, coverage, entities, search, snapshots, spend, versions
from spendlake.operators.filters import SpendFilter, lookback_start, notice_predicate
from spendlake.plans.answers import answer_questions
from spendlake.schemas import LEGACY_ROW
from spendlake.session import staged
from spendlake.sources import lake
from spendlake.sources.notice import finish

COLUMNS = "source string, contract_id string, release_id string, supplier string, agency string, title string, amount decimal(18,2), release_date string, tag string"


def notices(spark, *rows):
    """Rows of (source, contract, release, supplier, agency, title, amount, date[, tag])."""
    data = [(*r[:6], None if r[6] is None else Decimal(str(r[6])), r[7], r[8] if len(r) > 8 else "contract") for r in rows]
    df = spark.createDataFrame(data, COLUMNS)
    return finish(df.withColumn("release_date", F.col("release_date").cast("timestamp")))


ROW = ("federal", "CN-1", "r1", "Acme Pty Ltd", "Department of Finance", "Audit and advisory", 100, "2024-07-01")


@pytest.mark.parametrize(
    "f,expected",
    [
        (SpendFilter(), True), (SpendFilter(keyword="audit"), True), (SpendFilter(keyword="travel"), False),
        (SpendFilter(company="acme"), True), (SpendFilter(company="Acme Limited"), True),
        (SpendFilter(company="other"), False), (SpendFilter(agency="finance"), True),
        (SpendFilter(agency="dept of finance"), True), (SpendFilter(agency="dva"), False),
        (SpendFilter(source="federal"), True), (SpendFilter(source="vic"), False),
        (SpendFilter(start=dt.date(2025, 1, 1)), False), (SpendFilter(end=dt.date(2023, 1, 1)), False),
        (SpendFilter(end=dt.date(2024, 7, 1)), True), (SpendFilter(keyword="50%"), False),
    ],
)
def test_row_matcher(spark, f, expected):
    df = notices(spark, ROW)
    assert (f.apply(df, partitioned=True).count() == 1) is expected
    catalog = entities.entity_catalog(df)
    assert (f.apply_with_catalog(df, catalog).count() == 1) is expected


def test_missing_source_is_federal_and_missing_date_fails(spark):
    df = notices(spark, (None, *ROW[1:]), (*ROW[:2], "r2", *ROW[3:7], None))
    assert SpendFilter(source="Commonwealth").apply(df).count() == 2
    assert SpendFilter(start=dt.date(2000, 1, 1)).apply(df).count() == 1


def test_guards():
    with pytest.raises(ValueError):
        SpendFilter(start=dt.date(2024, 2, 1), end=dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        SpendFilter(source="vic").require_term()
    assert lookback_start(dt.date(2024, 2, 29), 1) == dt.date(2023, 3, 1)


def test_portal_filter_end_rule(spark):
    df = notices(spark, ROW).withColumn("contract_end", F.lit("2024-05-01").cast("date"))
    f = SpendFilter(end=dt.date(2024, 6, 30))
    assert df.where(notice_predicate(f)).count() == 1
    assert df.withColumn("contract_end", F.lit(None).cast("date")).where(notice_predicate(f)).count() == 0


VERSIONS = [
    ("federal", "CN1", "b", "A", "X", "t", 150, "2024-01-02", "contractAmendment"),
    ("federal", "CN1", "a", "A", "X", "t", 100, "2024-01-01"),
    ("federal", "CN1", "c", "A", "X", "t", 999, "2024-01-02", "contractAmendment"),
    ("federal", "CN2", "d", "B", "X", "t", 50, None),
    ("vic", "CN1", "e", "A", "X", "t", 7, "2020-01-01"),
]


def test_latest_version_and_total_do_not_depend_on_order(spark):
    for order in itertools.islice(itertools.permutations(VERSIONS), 0, 120, 31):
        df = notices(spark, *order)
        got = {(r["source"], r["contract_id"]): r["amount"] for r in versions.latest_versions(df).collect()}
        assert got == {("federal", "CN1"): 150, ("federal", "CN2"): 50, ("vic", "CN1"): 7}
        assert spend.total_spend(df).first()["total_spend"] == 200.0


def test_version_flags(spark):
    got = versions.version_flags(notices(spark, *VERSIONS)).collect()
    assert sorted((r["source"], r["release_id"], r["is_update"]) for r in got) == [
        ("federal", "a", False), ("federal", "b", True), ("federal", "d", False), ("vic", "e", False),
    ]


def test_stored_twice_counts_once(spark):
    df = notices(spark, *VERSIONS)
    assert versions.unique_releases(df.unionByName(df)).count() == 5
    got = {r["source"]: r["total_spend"] for r in spend.incremental_total(df, df).collect()}
    assert got == {"federal": 200.0, "vic": 7.0}


def test_lake_totals_keep_notices_without_ids_and_listings_again(spark, tmp_path):
    """Loaded twice: notices with a null release id, and portal contracts listed with other dates or amounts."""
    keys = ("source", "contract_id", "release_id", "supplier", "agency", "title", "amount", "day", "raw_file", "raw_row")
    rows = [
        ("nsw", "N1", None, "S", "A", "t", "10", "2020-07-01", "p1", 1),
        ("nsw", "N1", None, "S", "A", "t", "10", "2020-07-01", "p1", 2),
        ("nsw", "N2", None, "S", "A", "t", "20", "2020-07-02", "p1", 3),
        ("federal", "F1", None, "S", "A", "t", "30", "2020-07-02", None, None),
        ("federal", "F1", None, "S2", "A", "t", "30", "2020-07-02", None, None),
        ("vic", "V1", "V1", "S", "A", "t", "100", "2020-07-03", "p1", 1),
        ("vic", "V1", "V1", "S", "A", "t", "100", "2020-07-04", "p1", 1),
        ("vic", "V1", "V1", "S", "A", "t", "150", "2020-07-04", "p1", 1),
        # The same listing, read from another place on the page.
        ("vic", "V1", "V1", "S", "A", "t", "150", "2020-07-04", "p2", 7),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{k} {'long' if k == 'raw_row' else 'string'}" for k in keys))
    df = finish(df.withColumns({"release_date": F.to_timestamp("day"), "amount": F.col("amount").cast("decimal(18,2)")}))
    path = str(tmp_path / "lake")
    for _ in range(2):
        lake.write(df, path)
    stored = lake.read(spark, path)
    got = {r["source"]: (r["total_amount"], r["records"]) for r in spend.monthly_spend(stored).collect()}
    assert got == {"nsw": (40.0, 3), "federal": (60.0, 2), "vic": (350.0, 3)}
    year = spend.spend_by_year_and_agency(stored).first()
    assert (year["total_amount"], year["records"]) == (450.0, 8)
    for source, (total, n) in got.items():
        r = spend.total_all_versions(stored, SpendFilter(source=source)).first()
        assert (r["total_spend"], r["rows"]) == (total, n)


def test_hot_contract(spark):
    """One contract holds most rows; brute force agrees."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        contract = "HOT" if rng.random() < 0.6 else f"C{rng.randrange(400)}"
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(700))
        rows.append(("nsw", contract, f"r{i:05d}", "S", "A", "t", rng.randrange(1, 9999), str(day)))
    best, first, accepted = {}, {}, {}
    for r in rows:
        key = r[1]
        if key not in best or (r[7], ) > (best[key][7],) or (r[7] == best[key][7] and r[2] < best[key][2]):
            best[key] = r
        first[key] = min(first.get(key, r[7]), r[7])
        slot = (key, r[7])
        if slot not in accepted or r[2] < accepted[slot][2]:
            accepted[slot] = r
    df = notices(spark, *rows)
    got = {r["contract_id"]: r["release_id"] for r in versions.latest_versions(df).collect()}
    assert got == {k: v[2] for k, v in best.items()}
    flags = {(r["contract_id"], r["release_id"]): r["is_update"] for r in versions.version_flags(df).collect()}
    assert flags == {(k[0], v[2]): k[1] > first[k[0]] for k, v in accepted.items()}


def test_reports(spark):
    df = notices(spark, ("federal", "CN-X", "r", "KPMG", "Department of Defence", "Smoke", 123.45, "2024-01-15"))
    row = spend.spend_by_year_and_agency(df).first()
    assert tuple(row) == ("2023-24", "Department of Defence", 123.45, 1)
    f = SpendFilter(keyword="smoke", source="federal")
    assert search.search_contracts(df, f).first()["release_date"] == dt.date(2024, 1, 15)
    assert tuple(search.search_summary(df, f).first()) == (1, 123.45, 1, 123.45)
    assert search.export_frame(search.search_contracts(df, f)).columns[0] == "Supplier"


def test_search_limit_and_totals(spark):
    df = notices(spark, *[("nsw", f"C{i}", f"r{i}", "Acme", "X", f"T{i}", i + 1, "2024-01-01") for i in range(8)])
    f = SpendFilter(company="acme")
    assert tuple(search.search_summary(df, f, 3).first()) == (3, 21.0, 8, 36.0)
    found = search.search_contracts(df, f, 3)
    assert [r["amount"] for r in found.collect()] == [8.0, 7.0, 6.0]
    assert [r["title"] for r in search.sort_results(found, "title").collect()] == ["T5", "T6", "T7"]


def test_range_excludes_old_row(spark):
    df = notices(
        spark, ("federal", "A", "a", "Acme", "X", "t", 200, "2019-06-01"), ("federal", "B", "b", "Acme", "X", "t", 50, "2023-06-01")
    )
    f = SpendFilter(company="acme", start=lookback_start(dt.date(2024, 6, 1), 3), end=dt.date(2024, 6, 1))
    assert spend.total_spend(df, f).first()["total_spend"] == 50.0


CATALOG = "source string, fy string, month string, agency string, agency_key string, supplier string, company_key string, row_count long"


def catalog(spark, *rows):
    return spark.createDataFrame([(s, "2024-25", "2024-07", a, ak, c, ck, n) for s, a, ak, c, ck, n in rows], CATALOG)


def test_entity_lookup(spark):
    rows = [
        ("federal", "Department of Defence", "department_of_defence", "Acme", "acme", 100),
        ("federal", "The Department of Defence", "the_department_of_defence", "Beta", "beta", 20),
        ("federal", "Australian Taxation Office", "ato", "Acme", "acme", 10),
        ("vic", None, "dept_health", None, "kpmg", 50),
        ("vic", None, "dept_health", None, "acn_123", 10),
    ]
    for order in (rows, rows[::-1]):
        c = catalog(spark, *order)
        got = entities.find_entities(c, "agency", "Dept of Defence", "federal").collect()
        assert [(r["name"], r["rows"]) for r in got] == [("The Department of Defence", 120)]
        got = entities.find_entities(c, "company", "kpmg", "Victoria").collect()
        assert [(r["name"], r["key"], r["rows"]) for r in got] == [("kpmg", "kpmg", 50)]
    assert entities.find_entities(catalog(spark, *rows), "company", limit=2).count() == 2


def test_entity_lookup_tests_names_after_the_sum(spark):
    """A name stands in many rows of a catalogue; testing one takes far longer than adding its rows."""
    c = catalog(spark, ("vic", None, "dept_health", "KPMG", "kpmg", 50), ("vic", None, "dept_works", "KPMG", "kpmg", 10)).repartition(2)
    found = entities.find_entities(c, "company", "kpmg")
    below = found._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate [source")[2]
    assert "row_count" in below and "Filter" not in below and found.first()["rows"] == 60


NAMES = ["Acme Pty Ltd", "ACME Holdings", "KPMG", "Deloitte Touche", "Ernst & Young", "AT&T", "A", "ab", "The Of", "株式会社", "a-b c"]
QUERIES = ["acme", "KPMG Limited", "e & y", "young and ernst", "a", "ab", "tt", "the", "zzz", "株", "!!!", "touche deloitte pty", "b c", "of the"]


def test_batch_match_equals_pairwise_match(spark):
    from spendlake.functions.entity import EntityQuery, resolve_entity
    from spendlake.functions.text import partition_key

    names = spark.createDataFrame([(n,) for n in NAMES], "n string")
    ents = names.select(resolve_entity("company", "n", partition_key("n")).alias("entity"), F.col("n").alias("name"))
    queries = spark.createDataFrame([(q,) for q in QUERIES], "q string")
    expected = set()
    for q in QUERIES:
        wanted = EntityQuery.of("company", q)
        expected |= {(q, r["name"]) for r in ents.where(wanted.matches(F.col("entity"))).collect()}
    got = entities.match_entities(queries, ents, "company", "q").collect()
    assert len(got) == len(expected)
    assert {(r["text"], r["name"]) for r in got} == expected


def batch_fixture(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        # a third of all rows belongs to one supplier
        supplier = "Hot Co Pty Ltd" if i % 3 == 0 else rng.choice(["Acme", "Beta & Sons", "Gamma Tech", None])
        agency = rng.choice(["Department of Health", "Dept of Works", "ATO"])
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(600))
        rows.append((rng.choice(["nsw", "vic"]), f"C{rng.randrange(90)}", f"r{i:04d}", supplier, agency,
                     rng.choice(["Road works", "Audit", "x y"]), rng.randrange(1, 500), str(day)))
    filters = [
        ("f1", None, "hot co", None, None, None, None), ("f2", None, "Hot Co Limited", "works", "NSW", "2020-03-01", "2021-02-01"),
        ("f3", None, None, "department of health", "vic", None, None), ("f4", "audit", "beta and sons", None, None, None, None),
        ("f5", "road", None, None, None, "2020-06-01", None), ("f6", None, "nobody", None, None, None, None),
        ("f7", "d w", None, None, "nsw", None, None), ("f8", "ATO C1", None, None, None, None, None),
    ]
    schema = "filter_id string, keyword string, company string, agency string, source string, start date, end date"
    day = lambda s: dt.date.fromisoformat(s) if s else None
    table = spark.createDataFrame([(*f[:5], day(f[5]), day(f[6])) for f in filters], schema)
    return notices(spark, *rows), filters, table, day


def test_batch_lookup_equals_single_lookups(spark):
    df, filters, table, day = batch_fixture(spark)
    got = {r["filter_id"]: r for r in batch.batch_total_spend(table, df, with_keywords=True).collect()}
    for fid, keyword, company, agency, source, start, end in filters:
        f = SpendFilter(keyword or "", company or "", agency or "", source or "", day(start), day(end))
        want = spend.summarise(spend.latest_amounts(f.apply(df))).first()
        assert (got[fid]["contracts"], float(got[fid]["total"])) == (want["contracts"], want["total_spend"]), fid


def test_keyword_rows_equal_a_test_of_every_row(spark):
    df, filters, table, day = batch_fixture(spark)
    got = sorted(map(tuple, batch.keyword_rows(table, df).select("filter_id", "release_id").collect()))
    want = []
    for fid, keyword, company, agency, source, start, end in filters:
        if keyword and not company and not agency:
            f = SpendFilter(keyword, "", "", source or "", day(start), day(end))
            want += [(fid, r["release_id"]) for r in f.apply(df).select("release_id").collect()]
    assert got == sorted(want) and got


def test_keywords_across_fields_and_the_values_that_are_looked_at(spark, monkeypatch):
    """Every row has a contract id of its own, but its name, title and agency are those of many rows."""
    rows = [("nsw", f"C{i}", f"r{i}", "Acme Pty", "Health", "Road works", i + 1, "2020-01-01") for i in range(40)]
    rows.append(("nsw", "C99", "r99", None, None, "Ltd road", 5, "2020-01-01"))
    keywords = {"a": "PTY road W", "b": "works health c3", "c": "acme", "d": "road", "e": "pty  road", "f": " ltd ROAD ", "g": "absent", "h": "h C7"}
    table = spark.createDataFrame(list(keywords.items()), "filter_id string, keyword string")
    sizes = {}

    def seen(df, name):
        out = staged(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(batch, "staged", seen)
    df = notices(spark, *rows)
    got = sorted(map(tuple, batch.keyword_rows(table, df).select("filter_id", "release_id").collect()))
    texts = {r["release_id"]: " ".join((r[c] or "").lower() for c in ("supplier", "title", "agency", "contract_id")) for r in df.collect()}
    assert got == sorted((f, r) for f, k in keywords.items() for r, t in texts.items() if k.strip().lower() in t)
    # 41 contract ids, two titles, one name, one agency and the empty text of the missing ones; no row's whole text.
    assert sizes["keyword-values"] == 46


def test_names_nobody_asks_for_are_not_read(spark, monkeypatch):
    df = notices(spark, ("nsw", "C1", "r1", "Acme", "ATO", "Road", 5, "2020-01-01"))
    table = spark.createDataFrame([("k", "road")], "filter_id string, keyword string")
    names = []
    monkeypatch.setattr(batch, "staged", lambda df, name: names.append(name) or staged(df, name))
    assert [tuple(r) for r in batch.batch_total_spend(table, df, with_keywords=True).collect()] == [("k", 1, 5)]
    assert not [n for n in names if n.endswith("-names")]


def test_given_limits_are_kept(spark):
    df = spark.range(1500).select(
        F.lit("nsw").alias("source"), F.col("id").cast("string").alias("contract_id"), F.col("id").cast("decimal(18,2)").alias("amount")
    )
    assert search.top_contracts(df, 1200).count() == 1200 and search.top_contracts(df).count() == 1500


def test_undated_contract_keeps_a_row_without_update(spark):
    rows = [("nsw", "A", "1", None), ("nsw", "A", "2", None), ("nsw", "B", "3", None), ("nsw", "B", "4", dt.datetime(2024, 1, 1)), (None, "C", "5", None)]
    df = spark.createDataFrame(rows, "source string, contract_id string, release_id string, release_date timestamp")
    got = {(r.source, r.contract_id, r.release_id, r.is_update) for r in versions.version_flags(df).collect()}
    assert got == {("nsw", "A", "1", False), ("nsw", "B", "4", False), (None, "C", "5", False)}


def test_totals_do_not_count_a_release_twice(spark):
    df = notices(spark, ROW)
    twice = df.unionByName(df)
    assert spend.monthly_spend(twice).collect() == spend.monthly_spend(df).collect()
    assert spend.spend_by_year_and_agency(twice).collect() == spend.spend_by_year_and_agency(df).collect()
    assert spend.total_all_versions(twice, SpendFilter()).collect() == spend.total_all_versions(df, SpendFilter()).collect()


def test_filter_without_terms_has_no_total(spark):
    df, *_ = batch_fixture(spark)
    table = spark.createDataFrame([("f", "nsw")], "filter_id string, source string")
    assert tuple(batch.batch_total_spend(table, df, with_keywords=True).first()) == ("f", None, None)


def test_answers(spark):
    df = notices(
        spark, ("federal", "A", "a", "KPMG", "Department of Defence", "t", 100, "2020-01-01"),
        ("vic", "B", "b", "KPMG", "Dept of Health", "t", 40, "2020-01-01"),
        ("vic", "C", "c", "Acme Pty Ltd", "Dept of Health", "Victoria Acme roads", 5, "2020-01-01"),
    )
    asked = [
        (1, "How much did Department of Defence spend on KPMG?", None), (2, "How much was spent on KPMG?", None),
        (3, "How much was spent by the Department of Health ?", "Victoria"), (4, "Acme", None), (5, "y" * 90, None),
    ]
    questions = spark.createDataFrame(asked, "question_id int, text string, source string")
    got = {r["question_id"]: r for r in answer_questions(questions, df, entities.entity_catalog(df), dt.date(2024, 1, 1)).collect()}
    assert got[1]["answer"] == "Total spend on KPMG by Department of Defence over the past 20 years: $100.00"
    assert got[2]["total_spend"] == 140.0
    assert got[3]["answer"] == "Total spend by Department of Health (VIC) over the past 20 years: $45.00"
    assert got[4]["answer"] == "Total spend on Acme Pty Ltd (VIC) over the past 20 years: $5.00"
    assert got[5]["total_spend"] == 0.0 and got[5]["keyword"] == "y" * 90


def test_coverage(spark):
    requests = spark.createDataFrame(
        [(1, "nsw", dt.date(2024, 1, 30), dt.date(2024, 3, 2)), (2, "vic", dt.date(2024, 2, 1), dt.date(2024, 2, 2))],
        "id int, source string, start date, end date",
    )
    windows = coverage.explode_windows(requests)
    loads = spark.createDataFrame([("nsw", "2024-01"), ("nsw", "2024-03"), ("vic", "2024-02"), ("vic", None)], "source string, month string")
    covered = coverage.month_coverage(loads)
    missing = coverage.missing_windows(windows, covered).collect()
    assert [(r["id"], r["month"]) for r in missing] == [(1, "2024-02")]
    got = {r["id"]: (r["windows"], r["missing"], r["complete"]) for r in coverage.coverage_by_request(windows, covered, "id").collect()}
    assert got == {1: (3, 1, False), 2: (1, 0, True)}


def test_rows_in_windows_keep_the_last_day(spark):
    df = notices(spark, ("nsw", "A", "a", "S", "X", "t", 1, "2024-01-31 18:30:00"), ("nsw", "B", "b", "S", "X", "t", 1, "2024-02-03"))
    w = spark.createDataFrame([("nsw", "2024-01", dt.date(2024, 1, 2), dt.date(2024, 1, 31))], "source string, month string, window_start date, window_end date")
    assert [r["contract_id"] for r in coverage.rows_in_windows(df, w, ["source"]).collect()] == ["A"]


def test_load_jobs(spark):
    suppliers = spark.createDataFrame([("KPMG",), ("Acme",)], "supplier string")
    assert coverage.load_jobs(suppliers, "2024-01-15", "2024-02-02", "kpmg").count() == 2
    assert coverage.load_jobs(suppliers, "2024-01-15", "2024-02-02", "11 222").count() == 4


def test_snapshots_and_checkpoints(spark):
    runs = spark.createDataFrame([("q", "2024-01-05"), ("q", "2024-01-03")], "query_key string, e string").select(
        "query_key", F.col("e").cast("timestamp").alias("run_end")
    )
    requests = spark.createDataFrame([("q",), ("other",)], "query_key string").select(
        "query_key", F.lit("2024-01-01").cast("timestamp").alias("start"), F.lit("2024-02-01").cast("timestamp").alias("end")
    )
    got = snapshots.resume_points(requests, snapshots.last_checkpoints(runs)).collect()
    assert {r["query_key"]: r["search_start"].day for r in got} == {"q": 5, "other": 1}
    key = spark.range(1).select(snapshots.fingerprint(F.lit("2024-01-01"), company=F.lit("  ACME \t Co ")).alias("k")).first()["k"]
    assert key == "day=2024-01-01|company=acme co|agency=|keyword=|source=|dateType=|lookback=|start=|end="


def test_lake_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "lake")
    df = notices(
        spark, ("federal", "A", "a", "ACME & Co", "ATO", "t", 1, "2024-07-10"), ("vic", "B", "b", "Beta", "12345", "t", 2, "2023-01-01"),
        ("vic", "C", "c", "Beta", "12345", "t", 3, None),
    )
    lake.write(df, path)
    stored = lake.read(spark, path)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    found = lake.search(spark, path, SpendFilter(source="vic", start=dt.date(2022, 7, 1), end=dt.date(2023, 6, 30)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fy" in plan or "PartitionFilters: [isnotnull(month" in plan
    assert [r["contract_id"] for r in found.collect()] == ["B"]
    again = df.where("contract_id = 'B'").withColumn("amount", F.lit(9).cast("decimal(18,2)"))
    lake.write(again, path, replace_months=True)
    assert {r["contract_id"]: float(r["amount"]) for r in lake.read(spark, path).collect()} == {"A": 1.0, "B": 9.0, "C": 3.0}
    labels = lake.rows_per_file(lake.read(spark, path)).select(lake.path_values("path").alias("p"), "row_count").collect()
    assert {(r["p"]["source"], r["p"]["month"]) for r in labels} >= {("federal", "2024-07"), ("vic", "2023-01")}
    assert lake.sql(spark, path, "SELECT count(*) AS n FROM parquet.`{{PARQUET_GLOB}}`").first()["n"] == 3


def test_legacy_files(spark, tmp_path):
    path = str(tmp_path / "old")
    df = notices(spark, ("federal", "A", "a", "ACME & Co", "ATO", "t", 1.5, "2024-07-10"))
    lake.write_deep(df, path)
    folders = {str(p.relative_to(path)) for p in (tmp_path / "old").rglob("company=*")}
    assert folders == {"source=federal/fy=2024-25/month=2024-07/agency=ato/company=acme__co"}
    values = ("", "nsw", "2023-24", "x", "y", "B", "b", "", "Y Co", "X Dept", "t", 2.25, 1705276800000, True)
    spark.createDataFrame([values], LEGACY_ROW).write.mode("append").parquet(f"{path}/plain")
    got = {r["contract_id"]: r for r in lake.read_legacy(spark, path).collect()}
    assert (got["A"]["agency"], float(got["A"]["amount"]), got["A"]["month"]) == ("ATO", 1.5, "2024-07")
    assert (got["B"]["agency"], got["B"]["is_update"], got["B"]["fy"], got["B"]["month"]) == ("X Dept", True, "2023-24", "2024-01")
    assert got["B"]["release_date"] == dt.datetime(2024, 1, 15)


def test_corrupt_files_are_opt_in(spark, tmp_path):
    path = tmp_path / "lake"
    lake.write(notices(spark, ROW), str(path))
    folder = next(path.rglob("month=*"))
    (folder / "part-bad.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        lake.read(spark, str(path)).count()
    assert lake.read(spark, str(path), skip_corrupt=True).count() == 1


def test_sql_limit_and_json_lines(spark, tmp_path):
    lake.write(notices(spark, *VERSIONS), str(tmp_path / "lake"))
    rows = lake.sql(spark, str(tmp_path / "lake"), "SELECT release_id, supplier FROM notices ORDER BY release_id", limit=2)
    lake.json_lines(rows, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"release_id":"a","supplier":"A"}', '{"release_id":"b","supplier":"A"}']


def test_terms_of_names_are_not_broadcast(spark, tmp_path):
    """A stored table of names is small, its exploded terms are not: their joins shuffle."""
    names = spark.range(50).select(F.format_string("Supplier#%09d Pty Ltd", "id").alias("name"))
    names.write.parquet(str(tmp_path / "names"))
    stored = spark.read.parquet(str(tmp_path / "names"))
    known = stored.select(entity.resolve_entity("company", "name", F.lit(None).cast("string")).alias("entity"))
    found = entities.match_entities(stored.select(F.col("name").alias("text")), known, "company")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.where("text = entity.name").count() == 50
