"""Split CSV files, page markup, the file index, committed tables and accepted updates."""

import csv
import datetime as dt
import io
import random
import re
import time
from decimal import Decimal
from pathlib import Path
from urllib.parse import urljoin

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from spendlake import session
from spendlake.operators import batch
from spendlake.operators.filters import SpendFilter
from spendlake.plans import file_queries, source_queries, stream_queries
from spendlake.session import scratch_path
from spendlake.sources import csv_cells, file_index, lake, ocds, pages, registry
from spendlake.sources.notice import reject_report
from spendlake.sources.testdata import notices
from spendlake.streaming import load
from spendlake.streaming.commits import CommittedTable

SF = "/root/testdata/sf0.001"


# --- CSV

def plain_cells(text):
    mark = csv_cells.delimiter(text)
    return [(k, r) for k, r in enumerate((r for r in csv.reader(io.StringIO(text, newline=""), delimiter=mark) if r), start=1)]


def random_csv(rng, mark, rows):
    cell = lambda: "".join(rng.choice(["a", "b", " ", "é", "1"]) for _ in range(rng.randint(0, 9)))
    quoted = lambda: '"' + "".join(rng.choice(["x", "\n", "\r\n", '""', mark, ",", "y"]) for _ in range(rng.randint(0, 12))) + '"'
    odd = lambda: rng.choice(['5" pipe', '"open" tail', "", '""'])
    out = [mark.join(["one", "two", "three"])]
    for _ in range(rows):
        out.append("" if rng.random() < 0.1 else mark.join(rng.choice([cell, cell, quoted, odd])() for _ in range(rng.randint(1, 5))))
    return rng.choice(["\n", "\r\n"]).join(out) + "\n"


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = [spark.conf.get(n, None) for n in names]
    for name, value in zip(names, ("61", "1", "400")):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, old):
        spark.conf.set(name, value) if value else spark.conf.unset(name)


def test_split_files_read_like_whole_ones(spark, tmp_path, small_ranges):
    rng, want = random.Random(4), {}
    for k in range(9):
        text = random_csv(rng, csv_cells.MARKS[k % 3], 60)
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        want[f"{k}.csv"] = plain_cells(text)
    long = 'a,b\n1,"' + "inside\n" * 200 + '"\n2,x\n3,"never closed\nand more\n'
    (tmp_path / "long.csv").write_bytes(long.encode())
    want["long.csv"] = plain_cells(long)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "bytes.csv").write_bytes(b"a,\xff\n")
    want["bytes.csv"] = [(1, ["a", "�"])]
    found = csv_cells.read_cells(spark, str(tmp_path / "*.csv"))
    assert found.rdd.getNumPartitions() > 0
    got = {}
    for r in found.collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row_no"], r["cells"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_no_task_reads_a_whole_file(spark, tmp_path, small_ranges):
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 2000)
    ranges = spark.read.text(str(tmp_path / "big.csv")).select(F.col("_metadata.file_block_start")).distinct().count()
    assert ranges > 50 and csv_cells.read_cells(spark, str(tmp_path / "big.csv")).count() == 2001


@pytest.mark.parametrize("line, inside, want", [
    ("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('b"', True, False), ('x"y', False, False), ('"a""', False, True),
    ('"a"",b"', False, False), ('a,"b', False, True), ('","', False, False), ('","', True, True), ('"a"b"c', False, False), ('x\r"y', False, True),
])
def test_quote_state(line, inside, want):
    assert csv_cells.inside_after(line, ",", inside) == want


def test_lines_without_quotes_are_not_walked_and_records_are_read_together(monkeypatch):
    """A range of 9,000 lines of which 3 have quotes."""
    lines = [b'"x", y' if k in (5, 6, 7) else b"1,2" for k in range(9000)]
    n = len(lines)
    scan = pa.RecordBatch.from_pydict({"file": ["f"] * n, "range": pa.array([0] * n, pa.int64()), "line": lines})
    walked, read, walk, records = [], [], csv_cells.inside_after, csv_cells.records
    monkeypatch.setattr(csv_cells, "inside_after", lambda line, *rest: walked.append(line) or walk(line, *rest))
    monkeypatch.setattr(csv_cells, "records", lambda text, mark: read.append(text) or records(text, mark))
    found = [r for b in csv_cells._effects_of(iter([scan])) for r in b.to_pylist()]
    assert [(r["file"], r["range"], r["mark"], r["effects"][0]) for r in found] == [("f", 0, ",", csv_cells.OUT)]
    assert len(walked) < 30
    read.clear()
    numbered = next(csv_cells._numbered(iter([scan])))
    assert numbered.column("n").to_pylist() == list(range(n))
    told = pa.RecordBatch.from_arrays(
        [*numbered.columns, pa.array([","] * n), pa.array([False] * n)], names=[*numbered.schema.names, "mark", "inside"]
    )
    parts = [r for b in csv_cells._parts_of(iter([told])) for r in b.to_pylist()]
    assert [r["seq"] for r in parts] == list(range(1, n + 1)) and parts[5]["cells"] == ["x", " y"] and len(read) < 5


# --- markup

def test_nested_tables_take_one_pass():
    html = "<table><tr><td>x" * 1000
    start = time.perf_counter()
    found = pages._listing(html, None)
    assert len(found["tables"]) == 1000 and time.perf_counter() - start < 1
    assert [len(r) for t in found["tables"] for r in t["rows"]] == [1] * 1000


@pytest.mark.parametrize("html", ["<![abc[x]]>", "<![", "<a b='", "</", "<!-- x", "<x y=\"<z>\" q", "<script>never", "\x00<>&#xZ;", "<td><table>" * 3])
def test_odd_markup_is_read(html):
    assert isinstance(pages._listing(html, "http://["), dict) and isinstance(pages._detail(html, None), dict)


def test_a_page_that_cannot_be_read_is_rejected(spark, monkeypatch):
    def breaks(html, url):
        if html == "bad":
            raise RuntimeError("x")
        return {"tables": [], "cards": []}

    rows = spark.createDataFrame([("sa", "u1", "bad"), ("sa", "u2", "good")], "source string, url string, html string")
    found = rows.mapInArrow(pages._each(breaks, pages._LISTING), pages.LISTING_SCHEMA)
    assert [tuple(r) for r in pages.unreadable(found).collect()] == [("sa", "u1", "unreadable page: RuntimeError")]
    assert found.count() == 2


def test_attributes_quotes_and_entities():
    found = pages._listing("<TABLE ID=x><tr><td CLASS='a > b'>1 &lt; 2<a HREF=\"/p?a=1&amp;b=2\">t</a><td><a href=/q/>u</a><br/>v</table>", "http://h.test/d/")
    cells = found["tables"][0]["rows"][0]
    assert found["tables"][0]["id"] == "x" and [c["text"] for c in cells] == ["1 < 2t", "uv"]
    assert [c["href"] for c in cells] == ["http://h.test/p?a=1&b=2", "http://h.test/q/"]


def test_pages_of_the_same_tags_are_laid_out_once(monkeypatch):
    """Texts, links and empty cells of their own, and the elements of the first one."""
    html = "<table id=t><tr><th>Ref<th>By</tr><tr><td><b class='tablesaw-cell-label'>l</b>{0}</td><td><a HREF='{1}'>{2}</a></td></tr></table>"
    pages._layouts.clear()
    made, init = [], pages._Page.__init__
    monkeypatch.setattr(pages._Page, "__init__", lambda self, tokens: made.append(1) or init(self, tokens))
    for ref, href, by in [("a", "/x", "b"), ("", "../y?z=1", ""), ("c &lt; d", "", "e"), ("f", "/p//q", "g")]:
        found = pages._listing(html.format(ref, href, by), "http://h.test/d/e")["tables"][0]["rows"][1]
        text = ref.replace("&lt;", "<")
        assert [(c["text"], c["bare"]) for c in found] == [(f"l{text}", text), (by, by)]
        assert found[1]["href"] == {"/x": "http://h.test/x", "../y?z=1": "http://h.test/y?z=1", "": None, "/p//q": "http://h.test/p//q"}[href]
    assert len(made) == 1
    pages._listing(html.replace("id=t", "id=u"), None)
    assert len(made) == 2


# --- file index

@pytest.fixture(scope="module")
def indexed(spark):
    path, index = scratch_path(spark, "lake"), scratch_path(spark, "index")
    lake.write(notices(spark, SF), path, rows_per_file=40)
    assert file_index.update_index(spark, path, index) == len(lake.read(spark, path).inputFiles())
    assert file_index.update_index(spark, path, index) == 0
    return path, index


@pytest.mark.parametrize("f", [
    SpendFilter(company="supplier 000000007 limited", agency="Dept of Machinery"), SpendFilter(company="000000003 Supplier"),
    SpendFilter(company="R#00000000"), SpendFilter(company="supplier0000000"), SpendFilter(company="zzz"), SpendFilter(company="7"),
    SpendFilter(agency="BUILD", start=dt.date(1997, 3, 5), end=dt.date(1997, 9, 1)), SpendFilter(source="NSW", agency="govt"), SpendFilter(keyword="gear"),
])
def test_indexed_search_equals_plain_search(spark, indexed, f):
    path, index = indexed
    plain, found = lake.search(spark, path, f), file_index.search(spark, path, index, f)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_index_opens_fewer_files_than_the_folders_hold(spark, indexed):
    path, index = indexed
    f = SpendFilter(company="supplier 000000007 limited", agency="Dept of Machinery", source="qld", start=dt.date(1996, 1, 1), end=dt.date(2000, 1, 1))
    folders = lake.read(spark, path).where(f.source_predicate() & f.partition_predicate()).select("_metadata.file_path").distinct().count()
    opened = len(file_index.search(spark, path, index, f).inputFiles())
    assert 0 < opened < folders


def test_terms_of_a_file_are_not_shuffled(spark, indexed):
    """Names are exploded to terms after the only shuffle, and every term of a file is in its filter."""
    path, index = indexed
    rows = file_index.describe(lake.read(spark, path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
    name = notices(spark, SF, "supplier").first()["supplier"]
    stored = file_index.read_index(spark, index)
    found = {r["path"] for r in file_index.may_hold(stored, "company", name).collect()}
    held = {r["p"] for r in lake.read(spark, path).where(F.col("supplier") == name).select(F.col("_metadata.file_path").alias("p")).collect()}
    assert held and held <= found and len(found) < stored.count()
    assert all(len(b["words"]) * 64 == b["bits"] for r in stored.collect() for b in r["blooms"].values())


def test_files_after_the_index_are_read_and_gone_ones_are_not(spark):
    path, index = scratch_path(spark, "lake"), scratch_path(spark, "index")
    rows = notices(spark, SF)
    lake.write(rows.where("source = 'vic'"), path)
    file_index.update_index(spark, path, index)
    lake.write(rows.where("source = 'sa'"), path)
    month = rows.where("source = 'vic'").first()["month"]
    lake.write(rows.where((F.col("source") == "vic") & (F.col("month") == month)).limit(1), path, replace_months=True)
    f = SpendFilter(agency="department")
    assert file_index.search(spark, path, index, f).count() == lake.search(spark, path, f).count()


# --- committed tables

ROWS = StructType().add("k", StringType()).add("v", LongType())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def content(table, spark):
    return sorted((r["k"], r["v"], r["part_number"]) for r in table.read(spark).collect())


def test_a_batch_counts_once_whenever_it_dies(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"), ROWS, ("k",))
    assert content(table, spark) == []
    table.append(frame(spark, ("a", 1)), 0)

    def dies():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        table.append(frame(spark, ("b", 2), ("c", 3)), 1, between=dies)
    assert content(table, spark) == [("a", 1, 0)]
    assert table.append(frame(spark, ("b", 2), ("c", 3)), 1) == 2
    assert table.append(frame(spark, ("b", 2), ("c", 3)), 1) == -1
    assert content(table, spark) == [("a", 1, 0), ("b", 2, 1), ("c", 3, 1)]
    assert table.vacuum(spark) == 1 and content(table, spark) == [("a", 1, 0), ("b", 2, 1), ("c", 3, 1)]


def test_a_base_swaps_in_as_a_whole(spark, tmp_path):
    table = CommittedTable(str(tmp_path / "t"), ROWS)
    for number, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], []]):
        table.append(frame(spark, *rows), number)

    def merge(rows):
        return load.newest_rows(rows, ["k"])

    def dies():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        table.compact(spark, merge, between=dies)
    assert len(content(table, spark)) == 3
    assert table.compact(spark, merge) == 2 and table.compact(spark, merge) == 2
    assert content(table, spark) == [("a", 2, 2), ("b", 1, 2)]
    table.append(frame(spark, ("b", 9)), 3)
    assert table.append(frame(spark, ("a", 1)), 0) == -1
    table.vacuum(spark)
    assert [r["kind"] for r in table.commits(spark)] == ["base", "batch"]
    assert sorted((r["k"], r["v"]) for r in merge(table.read(spark)).collect()) == [("a", 2), ("b", 9)]


def test_accepted_updates(spark, tmp_path):
    schema = "source string, contract_id string, release_id string, amount decimal(18,2), release_date timestamp"
    day = lambda d: dt.datetime(2024, 1, d) if d else None
    turns = [
        [("s", "a", "r2", 20, 2), ("s", "a", "r1", 10, 1), ("s", "b", "u1", 5, 0), (None, "a", "x", 1, 3)],
        [("s", "a", "late", 9, 1), ("s", "a", "same", 9, 2), ("s", "b", "u2", 6, 0), ("s", "b", "d", 7, 1)],
        [("s", "a", "r4", 40, 4), ("s", "a", "r4b", 41, 4), ("s", "b", "u3", 1, 0)],
    ]
    seen = []
    for turn in turns:
        rows = [(s, c, r, Decimal(a), day(d)) for s, c, r, a, d in turn]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = load.update_events(stream).writeStream.outputMode("append").foreachBatch(lambda b, i: seen.extend(b.collect()) and None)
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((str(r["source"]), r["contract_id"], r["release_id"], r["is_update"], r["replaced_release"] or "") for r in seen)
    assert got == [
        ("None", "a", "x", False, ""), ("s", "a", "r1", False, ""), ("s", "a", "r2", True, "r1"), ("s", "a", "r4", True, "r2"),
        ("s", "b", "d", True, "u1"), ("s", "b", "u1", False, ""),
    ]


def test_accepted_updates_of_committed_batches(spark, tmp_path, monkeypatch):
    """Batches through both tables, merged after every batch, against a plain loop; no contract is handed to Python."""
    monkeypatch.setattr(load, "MERGE_AFTER", 0)
    schema = "source string, contract_id string, release_id string, amount decimal(18,2), release_date timestamp"
    rng, held, want = random.Random(3), {}, []
    version = "is_update boolean, replaced_release string, replaced_amount decimal(18,2)"
    events = CommittedTable(str(tmp_path / "events"), StructType.fromDDL(f"{schema}, {version}"))
    newest = CommittedTable(str(tmp_path / "newest"), StructType.fromDDL(schema))
    for turn in range(4):
        rows = [
            (rng.choice(["s", None]), rng.choice(["a", "b", "c", None]), f"{turn}-{k}", Decimal(f"{rng.randint(1, 99)}.00"),
             dt.datetime(2024, 1, rng.randint(1, 28)) if rng.random() < 0.8 else None) for k in range(25)
        ]
        for s, c, r, a, d in sorted(rows, key=lambda x: (x[4] or dt.datetime.min, x[2])):
            age, old = d or dt.datetime.min, held.get((s, c))
            if old is None or age > old[0]:
                want.append((turn, s, c, r, a, d, old is not None, *(old[1:] if old else (None, None))))
                held[s, c] = (age, r, a)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        load.start_accepted_updates(stream, events, newest, str(tmp_path / "c")).awaitTermination()
    names = ("part_number", "source", "contract_id", "release_id", "amount", "release_date", "is_update", "replaced_release", "replaced_amount")
    assert sorted(map(str, (tuple(r[n] for n in names) for r in events.read(spark).collect()))) == sorted(map(str, want))
    assert [r["kind"] for r in newest.commits(spark)] == ["base"]


def test_update_events_query_calls_no_python(spark, monkeypatch):
    monkeypatch.setattr(load, "update_events", None)
    assert stream_queries.stream_update_events(spark, SF).count() > 0


def test_pages_are_dealt_over_tasks(spark):
    listing = source_queries.vic_listing(spark, SF)
    assert "hashpartitioning(release_id" in listing._jdf.queryExecution().executedPlan().toString()


def test_snapshot_runs_share_one_copy_of_the_notices(spark, monkeypatch):
    """Three runs, of which two compute: the notices are written once, with the columns that a lookup reads."""
    written, staged = [], file_queries.staged
    monkeypatch.setattr(file_queries, "staged", lambda df, name: written.append((name, tuple(df.columns))) or staged(df, name))
    assert file_queries.daily_snapshot_reuse(spark, SF).count() > 0
    assert written == [("snapshot-notices", batch.LOOKUP_COLUMNS)]


def test_landed_pages_are_compressed_and_whole(spark, tmp_path):
    path = str(tmp_path / "landing")
    files = source_queries.landed_pages(spark, SF, path)
    assert files == len([*Path(path).rglob("*.gz")]) and not [*Path(path).rglob("*.txt")]
    landed = spark.read.schema("value string, source string").text(path).select("value", "source")
    want = source_queries.release_pages(spark, SF)
    assert landed.exceptAll(want).isEmpty() and want.exceptAll(landed).isEmpty() and landed.count() == want.count()


def test_spent_shuffles_restores_the_setting(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with pytest.raises(ValueError), session.spent_shuffles(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key, None) == before


def test_page_errors_and_rejects_in_one_pass(spark):
    release = '{"id": "r%d", "tag": ["%s"], "contracts": [{"id": "c", "value": {"amount": %d}}]}'
    pages_ = [
        '{"releases": [' + release % (1, "contract", 5) + "," + release % (2, "planning", 5) + "," + release % (3, "contract", 0) + "]}",
        '{"releases": []}', '{"errorCode": 0}', '{"errorCode": 500, "message": "x", "releases": [' + release % (4, "contract", 5) + "]}", "broken", None,
    ]
    packages = ocds.parse_packages(spark.createDataFrame([(p, "nsw") for p in pages_], "value string, source string"))
    errors = ocds.package_errors(packages).groupBy("source", F.col("reject_reason").alias("reason")).agg(F.count("*").alias("rows"))
    want = reject_report(ocds.to_notices(ocds.releases(packages))).unionByName(errors)
    got = reject_report(ocds.to_notices(ocds.releases_and_errors(packages)))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    plan = source_queries.ocds_rejects(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and len(re.findall(r"Relation \[l_orderkey", plan)) == 1


def pages_batch(*rows):
    names = ("source", "url", "html", "reject_reason")[: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=list(names))


def test_alike_pages_are_laid_out_together(monkeypatch):
    """Pages whose tags keep coming back fit a pattern and are read without any page of their own, with equal results."""
    cards = "<ul class='cards profiles'><li><h3><a href=\"{1}\"> {0}</a></h3><dl class=details><dt>{2}</dt><dd>a  b</dd><dd>c</dd></dl></li></ul>"
    table = "<table id=t><tr><th>Ref {0}<th>By</tr><tr><td><b class='tablesaw-cell-label'>l</b>{0}</td><td><a HREF='{1}'>{0}</a></td></tr></table>"
    marks = "<table><tr><td>{2})</td><td><div> <i>{0}</i> x</div></td></tr></table><dl><dt>K</dt><dd>{0}</dd></dl>"
    texts, links, labels = ["a", "", "b &amp; c", " d\n e\xa0", "f" * 40], ["/x", "../y?z=1", "", "q/r", "http://o.test/&amp;"], ["L", " ", "12", "1" * 40]
    rows = [
        ("s", "http://h.test/d/e/f", form.format(texts[k % 5], links[k % 5], labels[k % 4]))
        for k in range(80) for form in (cards, table, marks)
    ] + [("s", None, "<p>1 < 2"), ("s", "u", None), ("s", "u", "<script>x</script><td>")]
    for read, schema, together in ((pages._listing, pages._LISTING, pages._listings), (pages._detail, pages._DETAIL, pages._details)):
        want = [r for b in pages._each(read, schema)(iter([pages_batch(*rows)])) for r in b.to_pylist()]
        assert list(pages._each(read, schema, together)(iter([pages_batch(*rows)])))
        single = []
        counted = lambda html, url: single.append(html) or read(html, url)  # noqa: E731, B023
        got = [r for b in pages._each(counted, schema, together)(iter([pages_batch(*rows)])) for r in b.to_pylist()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(single) == 3


def test_relative_links_are_joined_as_the_library_does():
    for base in ("http://h.test/a/b/c?x=1", "https://h.test/", "http://h.test", "http://h.test/a//b", "", None, "http://h.test/a/./b"):
        for href in ("../x", "../../../x/y?a=1&b=2", "x", "x/y", "?a=1", "#f", "../", "../x#f", "x/", "/r/s", " ../x ", "./x", "x/../y"):
            assert pages._joined(href, base) == urljoin(base or "", href.strip())


def test_rejects_of_a_portal_load_come_from_one_pass(spark):
    plan = file_queries.portal_rejects(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4 and len(re.findall(r"Relation \[l_orderkey", plan)) == 4
    table = "<table id='contractTable'><tr><td>1<td>C1<td>t<td>a<td>02/01/2024<td><td>$5</table>"
    rows = [("wa", "u1", table, None), ("wa", "u2", "__cf_chl", None), ("wa", "u4", "<p>attention required", None)]
    landed = pages.flag_blocked(spark.createDataFrame(rows, "source string, url string, html string, x string"))
    for name in ("nsw", "vic", "sa", "wa"):
        found = registry.adapter(name)(pages.extract_listings(landed))
        assert [tuple(r) for r in found.where("reject_reason = 'challenge page'").select("source", "raw_file", "contract_id").collect()] == [(name, "u2", None)]
        assert found.count() == (2 if name == "wa" else 1)


def test_united_sources_keep_only_what_is_compared(spark):
    plan = source_queries.all_sources_total(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "agency_key" not in plan and "company_key" not in plan


def test_finished_rows_are_shuffled_without_derived_columns(spark, tmp_path):
    rows = notices(spark, SF)
    slim = lake.laid_out_slim(rows)._jdf.queryExecution().optimizedPlan().toString()
    moved = slim[slim.index("RebalancePartitions"):].splitlines()[1]
    assert "company_key" not in moved and "fy" not in moved and "company_key" in slim
    lake.write(rows, str(tmp_path / "a"))
    lake.write(rows, str(tmp_path / "b"), finished=True)
    plain, got = lake.read(spark, str(tmp_path / "a")), lake.read(spark, str(tmp_path / "b"))
    assert plain.exceptAll(got).isEmpty() and got.exceptAll(plain).isEmpty() and got.count() == rows.count()
    assert not [p for p in (tmp_path / "b").rglob("*.parquet") if "zstd" not in p.name]


def test_a_lake_write_deletes_its_shuffle_files(spark, tmp_path, monkeypatch):
    inside, seen = lake.spent_shuffles, []
    monkeypatch.setattr(lake, "spent_shuffles", lambda s: seen.append(s) or inside(s))
    lake.write(notices(spark, SF).where("month < '1993-01'"), str(tmp_path / "lake"))
    assert seen == [spark]


def test_a_term_is_hashed_once_for_all_its_probes(spark, indexed):
    path, index = indexed
    rows = file_index.describe(lake.read(spark, path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(lambda") == 1 and "RepartitionByExpression [path" in plan
    bits = 1 << 12
    found = spark.range(500).select(F.xxhash64(F.col("id").cast("string")).alias("h"), file_index._probes(F.col("id").cast("string"), F.lit(bits)).alias("p")).collect()
    places = file_index._places(file_index.np.array([r["h"] for r in found]), bits)
    assert [r["p"] for r in found] == places.T.tolist() and len({tuple(r["p"]) for r in found}) == 500
