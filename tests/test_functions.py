"""Scalar rules: text, money, dates, jurisdictions, entities, URLs, questions."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions import money, questions, text, urls
from spendlake.functions.entity import EntityQuery, entity_identifier, entity_tokens, preferred_name, resolve_entity
from spendlake.functions.jurisdiction import canonical_source, detect_source
from spendlake.plans import calendar_queries


def rows(spark, values, build):
    """Expression over one string column ``c``, in input order."""
    data = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "i int, c string")
    return [r[1] for r in sorted(df.select("i", build.alias("v")).collect())]


def test_strip_sees_unicode_space(spark):
    assert rows(spark, ["  a b　\n", "", None], text.strip("c")) == ["a b", "", None]
    assert rows(spark, [" \t", " x "], text.blank_to_null("c")) == [None, "x"]
    assert rows(spark, [" a   b\n\nc "], text.collapse_spaces("c")) == ["a b c"]


def test_keys_and_tokens(spark):
    names = ["ACME & Co", "Department of Finance", "!!!", None, "Ünïcode_x"]
    assert rows(spark, names, text.partition_key("c")) == ["acme__co", "department_of_finance", "unknown", "unknown", "ncode_x"]
    assert rows(spark, ["A-b, 9c!", ""], text.tokenize("c")) == [["a", "b", "9c"], []]


@pytest.mark.parametrize(
    "kind,name,tokens,identifier",
    [
        ("agency", "The Dept. of Defence", ["department", "defence"], "defence_department"),
        ("agency", "Govt Svcs & Tech", ["government", "services", "technology"], "government_services_technology"),
        ("company", "Acme Pty Ltd", ["acme"], "acme"),
        ("company", "Limited", ["limited"], "limited"),
        ("company", "Pty Limited", ["pty", "limited"], "limited_pty"),
        ("agency", "Acme Pty Ltd", ["acme", "pty", "ltd"], "acme_ltd_pty"),
        ("agency", "The Of", ["the", "of"], "of_the"),
        ("agency", "Bob Bob @ Home", ["bob", "at", "home"], "at_bob_home"),
        ("company", "株式会社", [], ""),
        ("company", " - -", [], "-_-"),
        ("company", "", [], ""),
    ],
)
def test_entity_tokens(spark, kind, name, tokens, identifier):
    df = spark.createDataFrame([(name,)], "c string")
    got = df.select(entity_tokens(kind, "c").alias("t"), entity_identifier(kind, "c").alias("i")).first()
    assert (got["t"], got["i"]) == (tokens, identifier)


def test_identifier_is_idempotent(spark):
    names = ["The Dept. of Defence", "Acme & Sons Pty Ltd", "a b c a", "Svc Co"]
    once = rows(spark, names, entity_identifier("company", "c"))
    assert rows(spark, once, entity_identifier("company", "c")) == once


@pytest.mark.parametrize(
    "query,name,expected",
    [
        ("acme", "Acme Pty Ltd", True), ("Acme Limited", "Acme Pty Ltd", True), ("other", "Acme Pty Ltd", False),
        ("", "Acme Pty Ltd", True), ("!!!", "unknown", False), ("me Pt", "Acme Pty Ltd", True),
    ],
)
def test_entity_match(spark, query, name, expected):
    df = spark.createDataFrame([(name, text_key(name))], "n string, k string")
    test = EntityQuery.of("company", query).matches(resolve_entity("company", "n", "k"))
    assert df.select(test.alias("v")).first()["v"] is expected


def text_key(name):
    return "".join(ch for ch in name.lower().replace(" ", "_") if ch.isalnum() or ch in "_-")


def test_entity_score(spark):
    df = spark.createDataFrame([("Department of Defence", "department_of_defence")], "n string, k string")
    entity = resolve_entity("agency", "n", "k")

    def score(query):
        return df.select(EntityQuery.of("agency", query).score(entity).alias("v")).first()["v"]

    assert score("Department of Defence") == 1000 + 300 + 180 + 220
    assert score("defence") == 120 + 80 + 210
    assert score("defence force") == 5
    assert score("") == 0


def test_preferred_name_ignores_row_order(spark):
    names = ["acme_co", "Acme", "Acme Company", "Acme Companx", None, " "]
    for order in (names, names[::-1]):
        df = spark.createDataFrame([(n,) for n in order], "c string")
        assert df.agg(preferred_name("c").alias("v")).first()["v"] == "Acme Companx"


def test_money(spark):
    raw = ["$ 1,234.56", "$239,285", " 1000 ", "", "A$-12.5 inc", "none", None]
    D = Decimal
    assert rows(spark, raw, money.parse_money("c")) == [
        D("1234.56"), D("239285.00"), D("1000.00"), D("0.00"), D("-12.50"), None, D("0.00"),
    ]
    assert rows(spark, [" $5", "none"], money.parse_money_or_zero("c")) == [D("5.00"), D("0.00")]
    strict = rows(spark, ["$1,234,567.89", "12 AUD", " "], money.parse_money_strict("c"))
    assert strict == [D("1234567.89"), None, D("0.00")]
    shown = rows(spark, ["1234.5", "-0.125", "0"], money.format_money(F.col("c").cast("decimal(18,3)")))
    assert shown == ["$1,234.50", "-$0.13", "$0.00"]


def test_financial_year_and_month(spark):
    days = ["2024-06-30", "2024-07-01", "1999-12-31", "2000-06-30"]
    assert rows(spark, days, cal.financial_year(F.col("c").cast("date"))) == ["2023-24", "2024-25", "1999-00", "1999-00"]
    assert rows(spark, days[:1], cal.month_label(F.col("c").cast("date"))) == ["2024-06"]


@pytest.mark.parametrize(
    "parser,raw,expected",
    [
        (cal.parse_date_sa, "21/12/2025", "2025-12-21"), (cal.parse_date_sa, "29  Sept 2025", "2025-09-29"),
        (cal.parse_date_sa, "23 July 2024", "2024-07-23"), (cal.parse_date_sa, "1 Dec 2024", "2024-12-01"),
        (cal.parse_date_sa, "2 September 2024", "2024-09-02"), (cal.parse_date_sa, "invalid", None),
        (cal.parse_date_nsw, "29-Jul-2025", "2025-07-29"), (cal.parse_date_nsw, "9-Dec-22", "2022-12-09"),
        (cal.parse_date_nsw, "1-Jan-70", "1970-01-01"), (cal.parse_date_nsw, "29/07/2025", None),
        (cal.parse_date_vic, "30 Aug 2025", "2025-08-30"), (cal.parse_date_wa, "2/01/2024", None),
        (cal.parse_date_wa, "02/01/2024", "2024-01-02"), (cal.parse_date_qld, "44942", "2023-01-16"),
        (cal.parse_date_qld, "44942.5", "2023-01-16"), (cal.parse_date_qld, "1999", None),
        (cal.parse_date_qld, "2024-07-10 00:00:00", "2024-07-10"), (cal.parse_date_qld, "January 2 2024", "2024-01-02"),
        (cal.parse_date_qld, "31/02/2024", None), (cal.parse_catalogue_time, "2024-07-15", "2024-07-15"),
        (cal.parse_catalogue_time, "", None), (cal.parse_rfc3339, "2024-07-15T23:30:00-02:00", "2024-07-16"),
        (cal.parse_rfc3339, "2024-07-15", None),
    ],
)
def test_dates(spark, parser, raw, expected):
    got = rows(spark, [raw], F.to_date(parser("c")).cast("string"))
    assert got == [expected]


def test_times_of_day(spark):
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    got = rows(spark, ["2024-07-15T10:30:00.123456"], F.date_format(cal.parse_catalogue_time("c"), stamp))
    assert got == ["2024-07-15 10:30:00.123456"]
    got = rows(spark, ["44942.5"], F.date_format(cal.parse_date_qld("c"), stamp))
    assert got == ["2023-01-16 12:00:00.000000"]


def test_contract_period(spark):
    got = rows(spark, ["9-Dec-2022 to 31-Dec-2025", "9-Dec-2022", ""], F.to_json(cal.contract_period("c")))
    assert "2022-12-09" in got[0] and "2025-12-31" in got[0]
    assert got[1:] == ["{}", "{}"]


def test_user_dates(spark):
    raw = ["2024-02-03", "2024-02-03T00:00:00Z", "03/02/2024", " ", None]
    assert rows(spark, raw, cal.is_bad_user_date("c")) == [False, False, True, False, False]


def test_ranges(spark):
    def resolve(start, end, years=None):
        build = cal.resolve_range(F.lit(start), F.lit(end), F.lit(dt.date(2024, 5, 1)), years)
        got = spark.range(1).select(build.alias("v")).first()["v"]
        return got["start"], got["end"]

    d = dt.date
    assert resolve(None, None) == (d(2004, 5, 1), d(2024, 5, 1))
    assert resolve(None, d(2024, 2, 29), 1) == (d(2023, 3, 1), d(2024, 2, 29))
    assert resolve(d(2024, 5, 1), d(2023, 1, 1)) == (d(2023, 1, 1), d(2024, 5, 1))


def windows(spark, split, start, end):
    got = spark.range(1).select(split(F.lit(start), F.lit(end)).alias("v")).first()["v"]
    return [(w["start"], w["end"]) for w in got]


def test_fixed_windows(spark):
    d = dt.date
    assert windows(spark, cal.day_windows, d(2024, 1, 1), d(2024, 3, 3)) == [
        (d(2024, 1, 1), d(2024, 2, 1)), (d(2024, 2, 1), d(2024, 3, 3)),
    ]
    assert windows(spark, cal.day_windows, d(2024, 1, 1), d(2024, 1, 1)) == [(d(2024, 1, 1), d(2024, 1, 1))]
    assert windows(spark, cal.day_windows, d(2024, 1, 2), d(2024, 1, 1)) == [(d(2024, 1, 2), d(2024, 1, 1))]


def test_month_windows(spark):
    d = dt.date
    assert windows(spark, cal.month_windows, d(2024, 1, 15), d(2024, 3, 2)) == [
        (d(2024, 1, 15), d(2024, 1, 31)), (d(2024, 2, 1), d(2024, 2, 29)), (d(2024, 3, 1), d(2024, 3, 2)),
    ]
    assert windows(spark, cal.month_windows, d(2024, 7, 10), d(2024, 7, 10)) == [(d(2024, 7, 10), d(2024, 7, 10))]


@settings(max_examples=12, deadline=None)
@given(start=st.dates(dt.date(1990, 1, 1), dt.date(2030, 1, 1)), span=st.integers(0, 900))
def test_month_windows_cover_every_day_once(spark, start, span):
    end = start + dt.timedelta(days=span)
    days = []
    for a, b in windows(spark, cal.month_windows, start, end):
        days += [a + dt.timedelta(days=i) for i in range((b - a).days + 1)]
    assert days == [start + dt.timedelta(days=i) for i in range(span + 1)]
    fixed = windows(spark, cal.day_windows, start, end)
    assert fixed[0][0] == start and fixed[-1][1] == end
    assert all(a[1] == b[0] for a, b in zip(fixed, fixed[1:]))


def test_local_day(spark):
    build = cal.local_day(F.col("c").cast("timestamp"))
    got = rows(spark, ["2024-01-01 12:59:59", "2024-01-01 13:00:00", "2024-07-01 13:59:00"], F.to_json(build))
    assert '"day":"2024-01-01"' in got[0] and "2024-01-01T13:00:00" in got[0]
    assert '"day":"2024-01-02"' in got[1]
    assert '"day":"2024-07-01"' in got[2] and "2024-07-01T14:00:00" in got[2]


def test_jurisdictions(spark):
    raw = ["Federal Government", "commonwealth", "Queensland", "NSW", "new south wales", "VIC", "Victoria", "SA",
           "South Australia", "WA", "western_australia", "", "Tasmania!"]
    assert rows(spark, raw, canonical_source("c")) == [
        "federal", "federal", "qld", "nsw", "nsw", "vic", "vic", "sa", "sa", "wa", "wa", "federal", "tasmania",
    ]


@pytest.mark.parametrize(
    "phrase,source,evidence",
    [
        ("Show spend for Victoria suppliers", "vic", "phrase matched: victoria"),
        ("Compare Western Australia to NSW", "wa", "phrase matched: western australia"),
        ("Federal government contract spend", "federal", "phrase matched: federal government"),
        ("Austender awards in 2024", "federal", "phrase matched: austender"),
        ("VIC procurement spend", "vic", "token matched: vic"),
        ("spend: SA,WA", "sa", "token matched: sa"),
        ("No jurisdiction mentioned", None, "no match"),
    ],
)
def test_detection(spark, phrase, source, evidence):
    got = rows(spark, [phrase], detect_source("c"))[0]
    assert (got["source"], got["evidence"]) == (source, evidence)


def test_urls(spark):
    links = ["https://x.test/notices/ABC-1/?q=1", "https://x.test/notices", "https://x.test/", "", "/a/b%20c", "https://x.test"]
    assert rows(spark, links, urls.notice_id("c")) == ["ABC-1", None, None, None, "b c", None]
    base = F.lit("https://www.x.test/contract/search?p=1#t")
    refs = ["/contract/view?id=12345", "https://y.test/a", "//z.test/b", "?q=2", "#k", "view.html", "../up/./v?x", "", None]
    assert rows(spark, refs, urls.resolve_url(base, "c")) == [
        "https://www.x.test/contract/view?id=12345", "https://y.test/a", "https://z.test/b",
        "https://www.x.test/contract/search?q=2", "https://www.x.test/contract/search?p=1#k",
        "https://www.x.test/contract/view.html", "https://www.x.test/up/v?x", None, None,
    ]


@pytest.mark.parametrize(
    "question,company,agency",
    [
        ("How much was spent on KPMG ?", "KPMG", None),
        ("How much did Department of Defence spend on KPMG?", "KPMG", "Department of Defence"),
        ("How much was spent by the Department of Defence ?", None, "Department of Defence"),
        ("How much was spent on KPMG by Defence?", "KPMG", "Defence"),
        ("how much did “the ATO” spend", None, "ATO"),
        ("List suppliers", None, None),
    ],
)
def test_questions(spark, question, company, agency):
    got = rows(spark, [question], questions.parse_question("c"))[0]
    assert (got["company"], got["agency"]) == (company, agency)


def test_questions_of_a_megabyte(spark):
    long = "how much was spent on " + "a  by\t" * 200_000
    assert rows(spark, [long], questions.parse_question("c"))[0]["company"] == "a"


def test_fallback_keyword(spark):
    raw = ["Total spending with 'Acme Co'?", "Deloitte?!", "x" * 81, " ", "money spent on  roads. And more"]
    assert rows(spark, raw, questions.fallback_keyword("c")) == ["Acme Co", "Deloitte", "x" * 81, None, "roads"]


def test_answer_text(spark):
    n = F.lit(None).cast("string")
    args = (F.lit("vic"), F.lit(20), F.lit("$1.00"))
    df = spark.range(1).select(
        questions.answer_text(F.lit("A"), F.lit("B"), *args).alias("both"),
        questions.answer_text(F.lit("A"), n, n, *args[1:]).alias("company"),
        questions.answer_text(n, F.lit("B"), *args).alias("agency"),
        questions.answer_text(n, n, *args).alias("none"),
        questions.context_text(F.lit("A"), n, *args).alias("context"),
    )
    assert tuple(df.first()) == (
        "Total spend on A by B (VIC) over the past 20 years: $1.00",
        "Total spend on A over the past 20 years: $1.00",
        "Total spend by B (VIC) over the past 20 years: $1.00", None,
        "Prefetched spend (VIC) over the last 20 years: $1.00 | company=A",
    )


def test_serials_in_every_spelling_of_a_number(spark):
    texts = ["4.4942e4", "+44942", "44942d", "44942.0F", "\x0144942", "0x1.5F1Cp15", ".44942E+5", "1e", "44942-1", "--44942", "9" * 20_000]
    parsed = cal.parse_date_qld("c")
    assert rows(spark, texts, F.to_date(parsed).cast("string")) == ["2023-01-16"] * 7 + [None] * 4
    df = spark.createDataFrame([("10/07/2024",)], "c string").select(parsed)
    tree = df._jdf.queryExecution().analyzed().toString()
    assert "THEN try_cast" in tree or "THEN cast" in tree, "texts that are no number are not cast"


@pytest.mark.parametrize("name, key", [("date_parse_multi", "release_date"), ("money_parse_format", "amount")])
def test_each_value_is_parsed_once(spark, name, key):
    """The values are grouped before they are spelled, so the rows that share one cost no parsing."""
    plan = calendar_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate"):]


def test_days_from_their_parts_equal_the_formatter(spark):
    marks = [(f"{d}{m}{mon}{m}{y}",) for m in "/- " for d in ("1", "09", "29", "30", "31", "32", "0") for mon in ("2", "02", "12", "13", "Feb", "DEC", "Xyz") for y in ("2023", "2024", "0000", "1582")]
    df = spark.createDataFrame(marks + [("2024-02-30",), ("2024-02-29",), ("Feb 29 2024",), ("Feb 30 2024",)], "t string")
    t = F.col("t")
    for shape, pattern in (cal.ISO_DAY, cal.SLASH_DAY, cal.SLASH_ANY, cal.SLASH_STRICT, cal.DASH_DAY, cal.SPACE_MON, cal.DASH_MON, cal.MON_FIRST):
        fits = df.where(t.rlike(f"^{shape}$"))
        got = fits.select(cal._timestamp_of(t, pattern).cast("string").alias("d"))
        want = fits.select(F.try_to_timestamp(t, F.lit(pattern)).cast("string").alias("d"))
        assert got.collect() == want.collect() and got.where("d IS NOT NULL").count() > 0
        assert "gettimestamp" not in got._jdf.queryExecution().optimizedPlan().toString()
