"""Adapters: release JSON, catalogue, disclosure CSV, portal pages; and the streaming load."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from spendlake.operators.filters import SpendFilter
from spendlake.operators.spend import latest_amounts, total_spend
from spendlake.plans.source_queries import QUERIES
from spendlake.sources import catalogue, disclosure, lake, ocds, pages, portals, registry
from spendlake.sources.notice import accepted, first_listed, reject_report, rejected, unite
from spendlake.sources.testdata import notices
from spendlake.streaming import load


def release(rid, contract, day, value=None, tag="contract", supplier="Acme", agency="ATO", amendments=None, **extra):
    body = {"id": contract, "title": f"title {contract}", "description": "consulting"}
    if value is not None:
        body["value"] = {"amount": value}
    if amendments:
        body["amendments"] = amendments
    parties = [{"name": agency, "roles": ["procuringEntity"]}, {"name": supplier, "roles": ["SUPPLIER"]}]
    return {"id": rid, "ocid": f"ocds-{rid}", "date": f"{day}T00:00:00Z", "tag": [tag], "parties": parties, "contracts": [body], **extra}


def notices_of(spark, *releases, f=None):
    df = spark.createDataFrame([(json.dumps({"releases": [r]}),) for r in releases], "value string")
    return ocds.to_notices(ocds.releases(ocds.parse_packages(df)), f=f)


def test_pages_are_aggregated(spark, tmp_path):
    for i, r in enumerate([release("r1", "CN-1", "2024-01-01", 100), release("r2", "CN-2", "2024-01-02", "50", supplier="Beta")]):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"releases": [r], "links": {"next": "x"}}, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps({"errorCode": 7, "message": "no"}))
    (tmp_path / "junk.json").write_text("<html>")
    packages = ocds.parse_packages(ocds.read_pages(spark, str(tmp_path)))
    found = accepted(ocds.to_notices(ocds.releases(packages)))
    assert total_spend(found).first()["total_spend"] == 150.0
    assert sorted(r["reject_reason"] for r in ocds.package_errors(packages).collect()) == ["error 7: no", "unreadable page"]


@pytest.mark.parametrize("key", ["amendedvalue", "amendedValue"])
def test_amendment_replaces(spark, key):
    late = release("r2", "CN123-A1", "2024-01-02", tag="contractAmendment", amendments=[{"id": "CN123", key: 150}])
    found = accepted(notices_of(spark, late, release("r1", "CN123", "2024-01-01", 100)))
    assert [(r["contract_id"], float(r["amount"])) for r in latest_amounts(found).collect()] == [("CN123", 150.0)]


def test_values_ids_and_parties(spark):
    change = release("r1", "CN1", "2024-01-01", 100, "contractAmendment", amendments=[{"id": "x", "amendedvalue": 0, "contractamendmentvalue": 20}])
    bare = release("r2", "", "2024-01-01", None, "contractAmendment", amendments=[{"id": "CN2-A3-A4", "contractAmendmentValue": 5.5}])
    odd = release("r3", "-A9", "bad", 3)
    odd["parties"] = [{"name": "Only", "roles": ["tenderer"]}]
    got = {r["release_id"]: r for r in accepted(notices_of(spark, change, bare, odd)).collect()}
    assert float(got["r1"]["amount"]) == 120.0
    assert (got["r2"]["contract_id"], float(got["r2"]["amount"])) == ("CN2", 5.5)
    assert (got["r3"]["contract_id"], got["r3"]["supplier"], got["r3"]["agency"]) == ("-A9", "Only", None)
    assert got["r3"]["release_date"] is None


def test_rejects_are_reported(spark):
    none = release("r5", "", "2024-01-01", 1)
    found = notices_of(
        spark, release("r1", "A", "2024-01-01", 1, tag="tender"), release("r2", "B", "2024-01-01", None),
        release("r3", "C", "2024-01-01", 0), release("r4", "D", "x", 1), none,
    )
    got = {r["reason"]: r["rows"] for r in reject_report(found).collect()}
    assert got == {
        "not a contract release": 1, "no value": 1, "value not positive": 1, "no contract id": 1, "accepted without a date": 1,
    }
    assert rejected(found).count() == 4


def test_release_filter(spark):
    rel = release("CN123", "CN123", "2024-01-01", 1, tender={"description": "Roads", "procurementMethodDetails": "Open"})
    for f, hit in [
        (SpendFilter("CN123", "acme", "ato"), 1), (SpendFilter("roads open"), 1), (SpendFilter("CONSULT"), 1),
        (SpendFilter("nothing"), 0), (SpendFilter(company="beta"), 0), (SpendFilter(agency="dva"), 0),
    ]:
        assert notices_of(spark, rel, f=f).count() == hit


def test_catalogue(spark):
    def res(i, fmt, url, **kw):
        return {"id": i, "package_id": "p", "name": "n", "url": url, "format": fmt, "size": 12, **kw}

    body = {"success": True, "result": {"count": 2, "results": [
        {"id": "pkg-1", "title": "A", "organization": {"title": "Agency A"}, "resources": [
            res("1", "CSV", "https://example.test/a.csv", last_modified="2024-07-15T10:00:00"),
            res("2", " xlsx", "https://example.test/b", created="2023-08-01"), res("3", "PDF", "https://example.test/c"),
            res("4", "csv", "relative/d.csv"), res("5", "csv", "https://nodots/x"), res("6", "csv", "http://file.csv/x"),
        ]},
        {"id": "pkg-2", "title": "B", "organization": None, "resources": [
            res("7", "XLS", "https://example.test/e.xls", size="big"), res("1", "csv", "https://example.test/again.csv")]},
    ]}}
    df = spark.createDataFrame([(json.dumps(body),)], "value string")
    got = {r["resource_id"]: r for r in catalogue.resources(df).collect()}
    assert sorted(got) == ["1", "2", "7"]
    assert (got["1"]["organization"], got["1"]["url"], got["7"]["organization"]) == ("Agency A", "https://example.test/a.csv", None)
    assert got["2"]["last_modified"] == dt.datetime(2023, 8, 1)
    manifest = spark.createDataFrame([("1", dt.datetime(2024, 7, 15, 10)), ("2", dt.datetime(2023, 1, 1))], "resource_id string, last_modified timestamp")
    assert sorted(r["resource_id"] for r in catalogue.stale_resources(catalogue.resources(df), manifest).collect()) == ["2", "7"]


def test_stale_resources_decode_pages_once(spark):
    """The resources are both the catalogue and the base of the manifest."""
    found = QUERIES["stale_resources"](spark, "/root/testdata/sf0.001")
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0


HEADER = "Agency,Supplier name,Award contract date,Contract value,Contract reference number,Contract description\n"


def test_disclosure_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + 'Dept A,Acme Pty Ltd,2024-07-10,"$1,234.56",ABC-123,Consulting\nDept B,"Other\nPty Ltd",2024-08-01,$10.00,DEF-456\n'
    )
    (tmp_path / "b.csv").write_text(
        "﻿Report;;\n\nfor;2024;\nVENDOR;Start  Date;Contract Value (inc GST);Purpose\nBeta;44942;12,5;x;extra\nGamma;soon;5;y\nDelta;1/02/2024;0;z\n"
    )
    (tmp_path / "c.csv").write_text("LIST\tContract\tRevised Value (inc)\tStart Date\n1\t\t7\t2 Jan 2024\n")
    (tmp_path / "d.csv").write_text("no,header,here\n1,2,3\n")
    cells = disclosure.staged_cells(spark, str(tmp_path / "*.csv"))
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    assert [r["f"] for r in disclosure.file_rejects(cells).select(name("raw_file").alias("f")).collect()] == ["d.csv"]
    owners = cells.select("file").distinct().withColumn("organization", F.lit("Owner"))
    found = disclosure.to_notices(cells, owners).withColumn("f", name("raw_file"))
    got = {r["contract_id"]: r for r in accepted(found).collect()}
    assert sorted(got) == ["ABC-123", "DEF-456", "qld-2024-01-2", "| Beta | x"]
    assert (got["ABC-123"]["agency"], float(got["ABC-123"]["amount"]), got["ABC-123"]["raw_row"]) == ("Dept A", 1234.56, 2)
    assert got["DEF-456"]["supplier"] == "Other\nPty Ltd"
    assert (float(got["| Beta | x"]["amount"]), got["| Beta | x"]["agency"]) == (125.0, "Owner")
    assert got["| Beta | x"]["release_date"] == dt.datetime(2023, 1, 16)
    assert sorted((r["supplier"], r["reject_reason"]) for r in rejected(found).collect()) == [
        ("Delta", "value not positive"), ("Gamma", "no date"),
    ]


def test_report_headers(spark):
    # A header row of a published report.
    headers = ["LIST", "Contract", "Description", "Contract Party", "ABN", "Contract Type", "Revised Value (inc)", "Start Date", "End Date"]
    df = spark.createDataFrame([(headers,), (["x"],)], "cells array<string>")
    got = [r["i"].asDict() for r in df.select(disclosure.header_index("cells").alias("i")).collect()]
    assert got[0] == {"agency": None, "supplier": 4, "award_date": 8, "value": 7, "reference": 2, "title": 3}
    assert set(got[1].values()) == {None}


def page(spark, source, html, url="https://www.x.test/contract/search"):
    return spark.createDataFrame([(source, url, html)], "source string, url string, html string")


def test_challenge_pages(spark):
    html = ["normal page", "Attention Required - Cloudflare", "__cf_chl page", "<script>awswafcookiedomainlist</script>", '{"goKuProps":true}', "attention required", None]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    assert [r["b"] for r in df.select(pages.is_challenge("html").alias("b")).collect()] == [False, True, True, True, True, False, False]
    good, bad = pages.split_blocked(df)
    assert (good.count(), bad.count()) == (3, 4)


def test_nsw_cards(spark):
    html = """<ul class="cards x profiles"><li><h3><a href="/notices/N-7?x=1">Fix  roads</a></h3><dl class="details">
      <dt>Agency</dt><dd> NSW Health </dd><dt>Contractor Name</dt><dd>Example
      Pty Ltd</dd><dt>Publish Date</dt><dd>01-Jan-2024</dd><dt>Contract Period</dt><dd>9-Dec-2022 to 31-Dec-2025</dd>
      <dt>Estimated amount payable to the contractor (including GST)</dt><dd>$1,000.50</dd></dl></li>
      <li><h3><a href="/notices">No id</a></h3></li><li></li></ul><ul><li>menu</li></ul>"""
    got = registry.adapter("nsw")(pages.extract_listings(page(spark, "nsw", html))).collect()
    by_id = {r["contract_id"]: r for r in got}
    row = by_id["N-7"]
    assert (row["agency"], row["supplier"], row["title"], float(row["amount"])) == ("NSW Health", "Example Pty Ltd", "Fix  roads", 1000.5)
    assert (row["release_date"], row["contract_end"]) == (dt.datetime(2024, 1, 1), dt.date(2025, 12, 31))
    assert by_id["No id"]["reject_reason"] is None and by_id[None]["reject_reason"] == "no contract id"


VIC = """<table><tr><th>Contract</th><th>Title</th><th>x</th><th>x</th><th>x</th><th>Cost</th></tr>
<tr><td><span class=tablesaw-cell-content> C-1001 </span> extra<td><a href="view?id=1">Roads</a><td> Current <td>30 Aug 2025<td>1 Sep 2026<td>$ 1,234.56</tr>
<tr><td>C-1001</td><td>Again</td><td></td><td>1 Aug 2025</td><td></td><td>2</td><td>Agency</td><td>Sup</td></tr>
<tr><td>abc</td><td>t</td><td></td><td>1 Aug 2025</td><td></td><td>2</td></tr><tr><td>C-9</td><td>short</td></tr>
<tr><td>C-10x1</td><td>t</td><td></td><td>never</td><td></td><td>2</td></tr></table><table><tr><th>Menu</th></tr><tr><td>1</td></tr></table>"""


def test_vic_rows_and_details(spark):
    detail = "<body>Public <b>Body</b> Dept  of Works Contract Number 9 <h2>Supplier Information</h2> 1 Acme Pty Ltd ABN 1 ACN 2</body>"
    details = portals.vic_details(pages.extract_details(page(spark, "vic", detail, "https://www.x.test/contract/view?id=1")))
    found = portals.vic_notices(pages.extract_listings(page(spark, "vic", VIC)), details)
    assert sorted(r["reject_reason"] for r in rejected(found).collect()) == ["no date", "too few cells", "unlikely contract id"]
    row = first_listed(accepted(found)).collect()
    assert len(row) == 1
    assert (row[0]["contract_id"], row[0]["title"], row[0]["agency"]) == ("C-1001", "Roads (Current)", "Dept of Works")
    assert (row[0]["supplier"], float(row[0]["amount"]), row[0]["contract_end"]) == ("Acme Pty Ltd ABN 1", 1234.56, dt.date(2026, 9, 1))


def test_sa_tables_and_details(spark):
    html = """<table><tr><th>Title</th></tr><tr><td>1</td></tr></table><table><thead><tr><th>Contract Reference</th><th>Buyer</th>
      <th>Awarded Date</th><th>Value</th></tr></thead><tbody><tr><td><b class="tablesaw-cell-label">Ref</b> <a href="/contract/view?id=12345">CN1</a></td>
      <td></td><td>21/12/2025</td><td>$100</td></tr><tr><td>CN2</td><td>Agency</td><td>x</td><td>n/a</td></tr></tbody></table>"""
    detail = "<table><tr><th>Issued By</th><td>Department for Infrastructure</td></tr><tr><th>Supplier</th><td>Acme Civil Pty Ltd</td></tr></table>"
    details = portals.sa_details(pages.extract_details(page(spark, "sa", detail, "https://www.x.test/contract/view?id=12345")))
    got = {r["contract_id"]: r for r in portals.sa_notices(pages.extract_listings(page(spark, "sa", html)), details).collect()}
    assert (got["CN1"]["agency"], got["CN1"]["supplier"], float(got["CN1"]["amount"])) == ("Department for Infrastructure", "Acme Civil Pty Ltd", 100.0)
    assert (got["CN2"]["agency"], float(got["CN2"]["amount"]), got["CN2"]["release_date"]) == ("Agency", 0.0, None)
    text = "<p>Public Authority SA Water Reference # 5</p><p>Unregistered Contractors 1 Zed Co Created: now</p>"
    row = portals.sa_details(pages.extract_details(page(spark, "sa", text))).first()
    # the shorter heading is part of the longer one
    assert (row["agency"], row["supplier"]) == ("SA Water", "Zed Co")
    bold = "<div class='contractor-details'><b>Bold Co</b></div><table><tr><th>Supplier</th><td>Other</td></tr></table>"
    assert portals.sa_details(pages.extract_details(page(spark, "sa", bold))).first()["supplier"] == "Bold Co"


def test_wa_rows(spark):
    html = """<table id="contractTable"><tbody><tr><td>1</td><td><a href="/view?id=1">W1</a></td><td>Roads</td><td>Main Roads</td>
      <td>02/01/2024</td><td></td><td>$239,285</td></tr><tr><td>1</td><td>W2</td><td>t</td><td>a</td><td>2024-01-03</td><td></td><td>abc</td></tr>
      <tr><td>1</td><td>W3</td><td>t</td><td>a</td><td>x</td><td></td><td></td></tr></tbody></table>"""
    detail = "<table><tr><td>1)</td><td><div>Acme</div></td></tr><tr><td>2)</td><td><div> Beta </div></td></tr></table>"
    details = portals.wa_details(pages.extract_details(page(spark, "wa", detail, "https://www.x.test/view?id=1")))
    got = {r["contract_id"]: r for r in portals.wa_notices(pages.extract_listings(page(spark, "wa", html)), details).collect()}
    assert (got["W1"]["supplier"], float(got["W1"]["amount"]), got["W1"]["release_date"]) == ("Acme, Beta", 239285.0, dt.datetime(2024, 1, 2))
    assert got["W2"]["reject_reason"] == "no value"
    assert (got["W3"]["supplier"], got["W3"]["release_date"], float(got["W3"]["amount"])) == ("Various", None, 0.0)


def test_supplier_terms(spark):
    terms = ["11 222 333 444", "123 456 789", "12345", "Acme 1"]
    df = spark.createDataFrame([(t,) for t in terms], "c string")
    got = [tuple(r["v"]) for r in df.select(portals.supplier_term_class("c").alias("v")).collect()]
    assert got == [("abn", "11222333444"), ("acn", "123456789"), ("name", "12345"), ("name", "Acme 1")]


def test_registry_and_union(spark):
    assert registry.available() == ["federal", "nsw", "qld", "sa", "vic", "wa"]
    with pytest.raises(KeyError):
        registry.adapter("tas")
    federal = accepted(notices_of(spark, release("r1", "CN1", "2024-01-01", 1)))
    vic = accepted(portals.vic_notices(pages.extract_listings(page(spark, "vic", VIC))))
    assert unite([federal, vic]).select("source").distinct().count() == 2


def write_pages(folder, name, *releases):
    (folder / f"{name}.json").write_text(json.dumps({"releases": list(releases)}))


def test_streaming_load_resumes_and_gates(spark, tmp_path):
    landing, path, state = tmp_path / "in", str(tmp_path / "lake"), str(tmp_path / "state")
    landing.mkdir()
    seen = []
    coverage = spark.createDataFrame([("federal", "2023-01")], "source string, month string")

    def run():
        stream = load.stream_notices(load.stream_pages(spark, str(landing), files_per_batch=1))
        load.start_load(
            stream, path, state, rejects_path=str(tmp_path / "rejects"), coverage=coverage,
            match=SpendFilter(company="acme"), on_match=lambda df, i: seen.extend(r["contract_id"] for r in df.collect()),
        ).awaitTermination()

    write_pages(landing, "1", release("r1", "CN1", "2024-01-01", 100), release("r0", "OLD", "2023-01-05", 9))
    write_pages(landing, "2", release("r2", "CN2", "2024-01-02", 50, supplier="Beta"), release("r9", "X", "2024-01-01", 0))
    run()
    write_pages(landing, "3", release("r3", "CN1-A1", "2024-02-01", None, "contractAmendment", amendments=[{"id": "CN1", "amendedvalue": 150}]))
    run()
    stored = lake.read(spark, path)
    assert stored.count() == 3 and sorted(seen) == ["CN1", "CN1"]
    assert total_spend(stored).first()["total_spend"] == 200.0
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1


def test_running_versions_keep_the_newest(spark, tmp_path):
    landing, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "s")
    landing.mkdir()
    progress = []
    listener = load.Progress(lambda batches, rows: progress.append((batches, rows)))
    spark.streams.addListener(listener)

    def run():
        stream = accepted(load.stream_notices(load.stream_pages(spark, str(landing)))).select(
            "source", "contract_id", "release_id", "amount", "release_date"
        )
        load.start_changes(load.running_versions(stream), table, state).awaitTermination()
        rows = load.current_rows(spark, table, ["source", "contract_id"]).collect()
        return {r["contract_id"]: (float(r["amount"]), r["is_update"]) for r in rows}

    write_pages(landing, "1", release("r2", "CN1", "2024-01-02", 100))
    assert run() == {"CN1": (100.0, False)}
    write_pages(landing, "2", release("r1", "CN1", "2024-01-01", 70), release("r3", "CN2", "2024-01-01", 5))
    assert run() == {"CN1": (100.0, True), "CN2": (5.0, False)}
    write_pages(landing, "3", release("r4", "CN1", "2024-03-01", 130))
    assert run() == {"CN1": (130.0, True), "CN2": (5.0, False)}
    spark.streams.removeListener(listener)


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    once = release("r1", "CN1", "2024-01-01", 100)
    write_pages(landing, "1", once, once, release("r2", "CN2", "2024-01-05", 1))
    stream = accepted(load.stream_notices(load.stream_pages(spark, str(landing))))
    totals = load.window_totals(load.drop_repeats(stream), "release_date", "amount", ["source"])
    load.start_changes(totals, str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    rows = load.current_rows(spark, str(tmp_path / "t"), ["window_start", "window_end", "source"]).collect()
    assert [(r["records"], float(r["total"])) for r in rows] == [(2, 101.0)]


def test_header_far_down_the_file(spark):
    cells = [["note", str(k)] for k in range(40)] + [["Agency", "Award contract date", "Contract value"], ["A", "2024-07-10", "$5"]]
    df = spark.createDataFrame([("f", k, c) for k, c in enumerate(cells, start=1)], disclosure.CELLS_SCHEMA)
    assert disclosure.to_notices(df).select("agency").collect() == [("A",)]


def listing(spark, html, source):
    pages_in = spark.createDataFrame([(source, "https://x.test/p", html)], "source string, url string, html string")
    return pages.extract_listings(pages_in)


def test_deep_pages_parse(spark):
    deep = "<p><font>" * 100_000 + "<table><tr><th>Contract</th><th>Buyer</th></tr><tr><td>C1</td><td>B</td></tr></table>"
    got = listing(spark, deep, "sa").select(F.size("tables").alias("n")).first()
    assert got["n"] == 1


def test_single_sa_result(spark):
    html = "<table><tr><th>Contract reference</th><th>Buyer</th><th>Value</th></tr><tr><td>C1</td><td>B</td><td>$5</td></tr></table>"
    assert portals.sa_notices(listing(spark, html, "sa")).count() == 1


def test_short_vic_rows_are_rejected_with_a_reason(spark):
    html = "<table><tr><th>Contract</th><th>Title</th><th>Value</th></tr><tr><td>C100</td><td>T</td></tr></table>"
    assert portals.vic_notices(listing(spark, html, "vic")).select("reject_reason").collect() == [("too few cells",)]


def test_nsw_card_labels_are_mapped_once(spark):
    found = accepted(portals.nsw_notices(pages.extract_listings(page(spark, "nsw", "<p>"))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), F.lit(value).alias("value"))
    fields = F.array(pair("A", "1"), pair(" b ", "2  3"), pair("a", "4"))
    assert spark.range(1).select(portals.card_fields(fields).alias("f")).first()["f"] == {"a": "4", "b": "2 3"}


def test_rows_without_header_words_meet_no_regular_expression(spark):
    for field, words in disclosure.HEADER_WORDS.items():
        assert all(any(w in h for w in words) for h in disclosure.HEADERS[field])
    cells = spark.createDataFrame([("f", 1, ["a"])], disclosure.CELLS_SCHEMA)
    plan = disclosure.header_rows(cells)._jdf.queryExecution().optimizedPlan().toString()
    tests = plan[plan.index("+- Filter"):]
    assert tests.index("Contains(lower(concat_ws( , cells") < tests.index("regexp_replace")


def test_line_items_are_shuffled_once_for_their_buyer(spark):
    """Orders meet customers before the line items meet both."""
    plan = notices(spark, "/root/testdata/sf0.001", "source", "agency")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Join" in line or "Relation" in line]
    assert ["Join" in line for line in lines] == [True, False, True, False, False]
