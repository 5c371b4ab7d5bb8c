"""Corpus operators on odd input against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlake.llm import (
    chat, decontam, exact_dedup, ngram_join, packing, quality_fm, suffix_dedup, tokens, toxicity, warc, wavelet,
)
from spendlake.llm.common import staged


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- exact copies

def test_exact_groups(docs):
    source = [(r.doc_id, fold(r.text)) for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in source:
        groups[t].append(d)
    top = lambda v: max((d for d in v if d is not None), default=None)
    want = Counter((d, top(groups[t]), len(groups[t]), d == top(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in source)
    assert rows_of(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_drop_keeps_one_row_per_text_and_all_columns(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(fold(r.text) for r in kept.collect()) == sorted({fold(r.text) for r in docs.collect()})


@pytest.mark.parametrize("table_bytes", [1, 300, 1 << 20])
def test_grace_grouping_spills_recursively(table_bytes):
    rng = random.Random(1)
    contents = [bytes([rng.randrange(4)]) * rng.randrange(40) for _ in range(3000)]
    records = [(hashlib.sha256(c).digest(), k, 0, 0, c) for k, c in enumerate(contents)]
    got = {c: sorted(a for a, _, _ in found) for _, c, found in exact_dedup.GraceGrouper(table_bytes, 1).groups(iter(records))}
    want = defaultdict(list)
    for k, c in enumerate(contents):
        want[c].append(k)
    assert got == want


def test_grace_table_compares_content_not_digests():
    same = b"\0" * 32
    found = list(exact_dedup.GraceGrouper().groups(iter([(same, 1, 0, 0, b"a"), (same, 2, 0, 0, b"b"), (same, 3, 0, 0, b"a")])))
    assert {c: [a for a, _, _ in f] for _, c, f in found} == {b"a": [1, 3], b"b": [2]}


# --- near copies

def sets_of(rows):
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", fold(t))
        yield d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(rows):
    items = list(sets_of(rows))
    up = {d: d for d, _ in items}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return Counter((d, len(s), None if d is None else top(d)) for d, s in items)


def test_near_groups(docs):
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(ngram_join.near_groups(docs), "doc_id", "n_shingles", "component_id") == want


def families(groups, size, seed=3):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{g}_{i}" for i in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8])):
                copy[rng.randrange(120)] = f"u{rng.random()}"
            rows.append((len(rows), " ".join(copy[: rng.choice([120, 120, 100, 90])])))
    return rows


@pytest.mark.parametrize("block, piece", [(4, 1024), (4, 3), (192, 5)])
def test_near_groups_in_small_blocks_and_pieces(spark, monkeypatch, block, piece):
    rows = families(4, 30)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.near_groups(df), "doc_id", "n_shingles", "component_id") == near_brute(rows)


@pytest.mark.parametrize("size", [200, 800])
def test_texts_of_a_family_travel_a_bounded_number_of_times(spark, monkeypatch, size):
    fetched, staged = [], ngram_join.staged

    def counted(df, name):
        out = staged(df, name)
        if name == "near-plausible":
            fetched.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    monkeypatch.setattr(ngram_join, "staged", counted)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*base[:k % 90], f"own{k}", *base[k % 90 :]])) for k in range(size)]
    got = ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct()
    assert got.collect() == [(0,)]
    # Once, and their leader once more in each of the blocks.
    assert sum(fetched) < 1.3 * size


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: rng.integers(0, 400)], rng.integers(1, 1 << 63, rng.integers(0, 150), dtype=np.uint64)]) for _ in range(60)]
    sets = [s for s in sets if len(s)] + [base[:3], base[:4], base[:16], base[:15]]
    sizes = np.array([len(s) for s in sets])
    ok = ngram_join.may_link(np.arange(len(sets)), sizes, [ngram_join.bitmap(s) for s in sets], 75)
    shared = ngram_join.overlaps(sets)
    linked = 100 * shared >= 75 * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(linked, False)
    assert (ok | ~linked.any(axis=1)).all()
    apart = [rng.integers(1, 1 << 63, 300, dtype=np.uint64) for _ in range(20)]
    assert not ngram_join.may_link(np.arange(20), np.full(20, 300), [ngram_join.bitmap(s) for s in apart], 75).any()


def test_contained_documents_link_whichever_prefix_ends_first(spark):
    """Isolated pairs at 0.75 to 0.9 where the larger one's own shingles are rarer, and pairs that ask for unequal matches."""
    words = lambda name, n: [f"{name}_{i}" for i in range(n)]
    texts = []
    for n in (20, 75, 76, 150, 301):
        for percent in (74, 75, 76, 80, 85, 90):
            base = words(f"p{n}_{percent}", n + 4)
            texts += [base, base + words(f"own{n}_{percent}", n * (100 - percent) // percent)]
    for g in range(3):
        # The core is frequent but stands behind the prefixes of its 40 hosts: only the smaller document asks for many matches.
        core = words(f"core{g}", 78)
        texts += [words(f"host{g}_{k}", 400) + core for k in range(40)]
        texts += [[f"rare{g}", *core], [f"rare{g}", *core, *words(f"more{g}", 25)]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = near_brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 25
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(ngram_join.near_groups(df), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("piece", [2, 3, 1024])
def test_shared_lists_need_two_documents(monkeypatch, piece):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rng = np.random.default_rng(8)
    for _ in range(200):
        rows = sorted((int(t), int(d)) for t, d in zip(rng.integers(0, 6, 14), rng.integers(0, 4, 14)))
        cuts = sorted({0, 14, *rng.integers(0, 15, 4).tolist()})
        batches = []
        for a, b in zip(cuts, cuts[1:]):
            columns = [pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)]
            batches.append(pa.RecordBatch.from_arrays(columns, names=["token", "doc"]))
        found = [r for out in ngram_join._shared_lists(iter(batches)) for r in out.to_pylist()]
        lists = defaultdict(list)
        for t, d in rows:
            lists[t].append(d)
        whole = sorted((v for v in lists.values() if len(set(v)) > 1 and len(v) <= piece))
        assert sorted(r["docs"] for r in found if not r["long"]) == whole
        cut = defaultdict(list)
        for r in found:
            if r["long"]:
                cut[r["sig"]] += r["docs"]
                assert r["first"] == lists[r["sig"]][0]
        assert all(lists[t] == v for t, v in cut.items())
        assert {t for t, v in lists.items() if len(v) > piece and len(set(v)) > 1} <= set(cut)


def test_near_drop_keeps_the_first_of_each_component(docs):
    roots = {(d, root) for d, _, root in near_brute([(r.doc_id, r.text) for r in docs.collect()])}
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    gone = {d for d, root in roots if d != root}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in gone)


def test_overlaps_are_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(20)]
    got = ngram_join.overlaps(sets, columns=16)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


# --- decontamination

def words13(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text))


def test_contamination(spark, docs):
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = words13(next(t for _, t in all_rows if t and len(t) > 1500))
    items = [(1, " ".join(long[20:60])), (2, "one"), (10, "Two, THREE"), (3, None), (4, "..."), (None, " ".join(long[100:113])), (2, "c d e"), (5, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = [("" if i is None else str(i), w[k : k + min(13, len(w))]) for i, t in items for w in [words13(t)] if w for k in range(max(1, len(w) - 12))]
    want = Counter()
    for d, t in all_rows:
        w, hit, names = words13(t), set(), set()
        for name, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want[d, len(w), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    got = rows_of(decontam.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])


def test_contamination_stays_native(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontam.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_contamination_does_not_group_texts(spark, docs, monkeypatch):
    """Repeated rows are united after verification: a grouping by id would shuffle every text once more."""
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(decontam, "staged", seen)
    decontam.drop_contaminated(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert "first(text" not in plans["decontam-found"]


def test_staged_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().toString()))
    before = files()
    rows = staged(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    assert not files() - before and rows.count() == 7


def test_close_families_take_in_members_that_have_not_met(spark):
    """Leader 0: two blocks that met and a few members that did not. Leader 1: most did not."""
    rows = [(d, d % 2, 0, int(d >= 20)) for d in range(100)] + [(d, 2 + d % 2, 1, int(d < 120)) for d in range(100, 200)]
    homes = spark.createDataFrame(rows, "doc long, block long, leader long, met int")
    plausible = spark.createDataFrame([(d,) for d in range(200)], "doc long")
    roots = spark.createDataFrame([(d, 20) for d in range(20, 60)], "node long, root long")
    placed = ngram_join._close_families(homes, plausible, roots)
    got = {r.leader: r.n for r in placed.where("met = 1").groupBy("leader").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 100, 1: 20} and placed.count() == 200
    keys = defaultdict(set)
    for r in ngram_join._rest_of_families(placed).collect():
        keys[r.key].add(r.doc)
    met = {frozenset((a, b)) for docs in keys.values() for a in docs for b in docs}
    linked = set(range(20, 60))
    assert all(frozenset((a, b)) in met for a in range(100) for b in range(a) if not {a, b} <= linked)


# --- tokens, packing, shards

def test_pieces_encode_like_whole_texts():
    rng, encoder, plain = random.Random(1), tokens.encoder(tokens.vocabulary_path()), tokens.load(tokens.vocabulary_path())
    parts = ["a", "Be", "ñ", "ß", "日本", "\n", " ", "  ", "\t", "\x85", "\xa0", "'s", "1", ".", ",", "!!", "😀", "<|endoftext|>", "x​"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_special_strings_encode_as_the_library_does():
    from tokenizers import Tokenizer

    rng, encoder, plain = random.Random(2), tokens.encoder(tokens.vocabulary_path()), Tokenizer.from_file(tokens.vocabulary_path())
    of = lambda text: np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert of("a <|endoftext|>b") == [*of("a "), 50256, *of("b")]
    parts = ["<|endoftext|>", "<|endoftext|>", "<|", "|>", "a", "Be c", "ñ", " ", "  ", "\n", "\t", ".", "'s", "\xa0"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert of(text) == plain.encode(text, add_special_tokens=False).ids, text


def ids_of(text, end):
    return [*tokens.load(tokens.vocabulary_path()).encode(text or "", add_special_tokens=False).ids, end]


def test_packing_is_lossless(docs):
    pieces = packing.pack(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(ids_of(r.text, 1))
    tokens_in = Counter(t for v in texts.values() for ids in v for t in ids)
    assert Counter(t for r in pieces for t in np.frombuffer(bytes(r.ids), "<u4").tolist()) == tokens_in
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert any(ids == v[r.start : r.start + r.length] and r.doc_tokens == len(v) for v in texts[r.doc_id])
    whole = packing.sequences(packing.pack(docs)).collect()
    assert all(sum(r.lengths) == len(r.ids) // 4 <= 2048 for r in whole)


def test_cuts():
    assert packing.cuts(2048 * 2 + 1024 + 65) == [2048, 2048, 1024, 64, 1]
    assert all(sum(packing.cuts(n)) == n for n in range(1, 5000, 7))


def test_memory_of_pieces_keeps_the_early_ones(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    encoder, plain = tokens.Encoder(tokens.vocabulary_path()), tokens.load(tokens.vocabulary_path())
    text = "the same of and " + " ".join(f"word{chr(97 + k)}%%%" for k in range(26)) + " a_b it's. it.'s don't!'ll é.%%% x--y ...'s"
    assert list(np.frombuffer(encoder.encode(text), "<u4")) == plain.encode(text, add_special_tokens=False).ids
    assert "same" in encoder.after_space


def test_wavelet_planes_part_and_merge(monkeypatch):
    monkeypatch.setattr(wavelet, "RUN", 16)
    rng = np.random.default_rng(3)
    for n in (0, 1, 15, 16, 17, 100):
        values, bits = rng.integers(0, 60_000, n).astype(np.uint16), rng.random(n) < 0.3
        parted = wavelet.part(values, bits)
        assert parted.tolist() == [*values[~bits].tolist(), *values[bits].tolist()]
        assert wavelet.merged(parted, bits, int((~bits).sum())).tolist() == values.tolist()


def test_wavelet_shard_answers():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 3), (200_000, 50_257)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = wavelet.Shard(io.BytesIO(wavelet.build(ids, [None, 4], [n - 1, 1])))
        assert (shard.all() == ids).all() and shard.documents()[0] == [None, 4]
        for i in rng.integers(0, n, 10):
            t, at = int(ids[i]), np.flatnonzero(ids == ids[i])
            assert shard.access(int(i)) == t and shard.count(t) == len(at)
            assert [shard.find(t, j) for j in (0, len(at) - 1)] == [at[0], at[-1]]
            assert shard.count(t, 1, int(i)) == ((at >= 1) & (at < i)).sum()
        assert shard.count(60_000) == 0
        with pytest.raises(IndexError):
            shard.find(int(ids[0]), n)


def test_wavelet_rows(docs):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    got, at = wavelet.token_shards(docs, shard_tokens=500).orderBy("start").collect(), 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, at, len(ids_of(r.text, 2)))
        at += g.n_tokens


# --- archives

def test_archives(spark):
    pages = [(1, "u", "same"), (2, "u\r\nx", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (2, "v", "same"), (9, "w", "é" * 9000), (7, "w", "Same")]
    df = spark.createDataFrame([(*p, "x", True) for p in pages], "page_id long, url string, html string, sha string, first boolean")
    got = rows_of(warc.archived(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = Counter()
    for p, _, h in pages:
        top = max(q for q, _, g in pages if (g or "") == (h or "") and q is not None)
        body = (h or "").encode()
        want[p, len(body), warc.digest(body), "response" if p == top else "revisit", None if p == top else top] += 1
    assert got == want
    assert warc.archived(df.limit(0)).count() == 0


def archive(records, dictionary=b""):
    out = io.BytesIO()
    w = warc.Writer(out, dictionary)
    for headers, block in records:
        w.record(headers, block)
    return out.getvalue()


HEADERS = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2020-01-01T00:00:00Z")]


def test_archive_format():
    rng = random.Random(2)
    samples = [(" ".join(rng.choice(["alpha", "beta", "<p>", "</p>", "delta"]) for _ in range(400))).encode() for _ in range(60)]
    dictionary = warc.train_dictionary(samples, 4096)
    data = archive([(HEADERS, s) for s in samples], dictionary)
    assert dictionary and int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert [warc.parse(f)[1] for f in warc.frames(memoryview(data))] == samples
    with pytest.raises(warc.BadRecord):
        list(warc.frames(memoryview(data[:-3])))
    with pytest.raises(warc.BadRecord):
        list(warc.frames(memoryview(data + b"junk")))


@pytest.mark.parametrize(
    "raw",
    [
        b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nno colon\r\n\r\n\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: i\r\nWARC-Date: d\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n",
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: i\r\nWARC-Date: d\r\nWARC-Block-Digest: sha1:X\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
    ],
)
def test_broken_records_are_refused(raw):
    with pytest.raises(warc.BadRecord):
        warc.parse(raw)


def page_record(extra=(), block=None, **changed):
    body = b"<p>x</p>"
    block = warc.HTTP_HEAD % len(body) + body if block is None else block
    own = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z", "X-Page-ID": "7",
           "WARC-Payload-Digest": f"sha1:{warc.digest(body)}"}
    return [*(own | {k.replace("_", "-"): v for k, v in changed.items()}).items(), *extra], block


@pytest.mark.parametrize("headers, block", [
    page_record(X_Page_ID="x7"), page_record(X_Page_ID="٣"), page_record(X_Page_ID="1" * 30), page_record(WARC_Date="not a date"),
    page_record(WARC_Date="2020-13-01T00:00:00Z"), page_record(WARC_Record_ID="x"), page_record(block=b"HTTP/1.1 200 OK\r\nContent-Length: abc\r\n\r\n<p>x</p>"),
    page_record(block="HTTP/1.1 200 OK\r\nContent-Length: ٨\r\n\r\n<p>x</p>".encode()), page_record(block=b"no head"), page_record([("X-Payload-Length", "9")]),
    page_record(WARC_Type="warcinfo", block=b"records: many\r\n"),
])
def test_a_broken_record_costs_only_itself(headers, block):
    import pyarrow as pa

    good = page_record()
    data = archive([good, (headers, block), good])
    rows = [r for b in warc._read(iter([pa.RecordBatch.from_pydict({"path": ["a"], "content": [data]})]), True) for r in b.to_pylist()]
    assert [r["page_id"] for r in rows] == [7, None, 7] and [r["error"] is None for r in rows] == [True, False, True]


def test_content_length_is_ascii_digits():
    raw = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: ٣\r\n\r\nabc\r\n\r\n".encode()
    with pytest.raises(warc.BadRecord):
        warc.parse(raw)


def test_an_archive_cut_between_frames_is_noticed():
    import pyarrow as pa

    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>"), ("WARC-Date", "2020-01-01T00:00:00Z")], b"records: 2\r\n"
    for kept, errors in ((2, [None, None]), (1, [None, "1 of 2 records"])):
        data = archive([info, *[page_record()] * kept])
        rows = [r for b in warc._read(iter([pa.RecordBatch.from_pydict({"path": ["a"], "content": [data]})]), False) for r in b.to_pylist()]
        assert [r["error"] for r in rows] == errors


# --- conversations

def test_chat_round_trip(spark):
    odd = ["<|endoftext|>", "<|", "\\", "\\<|", " lead", "trail ", "", None, "日本 😀", "\n\n", "</turn>", "x" * 30_000]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["assistant", "user", None, "a<|b"]), rng.choice(odd)) for c in (1, 2, 3, None) for t in [*range(6), None]]
    rows.append(rows[0])
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, ids int")
    want = set()
    for c in (1, 2, 3, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: (*v[:2], v[2].encode(), v[3].encode()))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        want.add((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.digests(chat.formatted(df))
    assert set(rows_of(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_token_slices_follow_overlap():
    starts, stops = np.array([0, 2, 2, 5, 9]), np.array([2, 5, 5, 9, 12])
    assert chat.token_slices(starts, stops, [(0, 2), (3, 6), (9, 9), (9, 30)]) == [(0, 1), (1, 4), (4, 4), (4, 5)]


# --- repeats

def repeats_brute(rows, size):
    grams = Counter(b[i : i + size] for _, b in rows for i in range(len(b) - size + 1))
    out = Counter()
    for d, b in rows:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - size + 1):
            if grams[b[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        gone = gone.cumsum()[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("settled", [4096, 2])
def test_repeats(docs, monkeypatch, settled):
    monkeypatch.setattr(suffix_dedup, "SETTLED", settled)
    got = suffix_dedup.removal_digests(suffix_dedup.without_repeats(docs))
    want = repeats_brute([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 200)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


# --- classifiers

def labelled(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for d in range(300):
        bad, toxic = d % 4 == 0, d % 3 == 0
        text = " ".join(word() for _ in range(60))
        text = text.upper() + "!!" * 20 if bad else text
        text = text + (" you scumbag." if toxic else " fine.")
        rows.append((d, text, len(text)))
        labels.append((d, int(not bad), int(toxic)))
    labels += [(0, None, None), (None, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("run, label", [(quality_fm.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_learn_and_score_everything(spark, docs, no_docs, run, label):
    known, labels = labelled(spark)
    got = run(known, labels).join(labels.where(f"{label} IS NOT NULL"), "doc_id").where("held_out").toPandas()
    assert len(got) and (got.predicted == got[label]).mean() > 0.95
    odd = run(docs, labels)
    assert odd.columns == ["doc_id", "held_out", "score", "predicted"] and odd.count() == docs.count()
    assert odd.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert run(no_docs, labels).count() == 0
    assert run(known, labels.limit(0)).count() == 300


def test_held_out_labels_are_never_used(spark):
    known, labels = labelled(spark)
    for run, folds, held in ((quality_fm.quality, 5, 0), (toxicity.toxicity, 4, 2)):
        from spendlake.llm.labels import fold_of
        from pyspark.sql import functions as F

        flipped = labels.withColumns(
            {c: F.when(fold_of(F.col("doc_id"), folds) == held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")}
        )
        assert rows_of(run(known, labels), "doc_id", "score") == rows_of(run(known, flipped), "doc_id", "score")


def test_keep_good_keeps_columns(spark, docs):
    kept = quality_fm.keep_good(docs, labelled(spark)[1])
    assert kept.columns == docs.columns


def test_pair_sum_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.SIZE), rng.normal(size=(quality_fm.SIZE, 3)))
    at, x = rng.integers(0, quality_fm.SIZE, 12), rng.normal(size=12)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(m.margins(at, x, np.array([0]))[0], 0.3 + m.linear[at] @ x + pairs)


def kinds(text):
    reader = toxicity.Reader(toxicity.Model({"moron": 1.0}, {"scum": 1.0}, toxicity.PRIOR, -2.0))
    return {k for k, v in zip(toxicity.KINDS, reader.features(text)) if v > 0}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a moron.", {"I"}), ("you moron!", {"It"}), ("Moron, you", {"It"}), ("you are not a moron", {"Int"}), ("not never a moron", {"I"}),
        ("she said moron", {"Ir"}), ("she said you kill", {"Hrt"}), ("scumbags; we kill them", {"I", "Ht"}), ("not one two three four moron", {"I"}),
        ("moron, not a moron", {"I"}), ("fine", set()), ("", set()),
    ],
)
def test_clause_grammar(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "run",
    [exact_dedup.exact_groups, ngram_join.near_groups, packing.pack, wavelet.token_shards, suffix_dedup.without_repeats, exact_dedup.drop_exact_copies],
)
def test_empty_tables(no_docs, run):
    assert run(no_docs).count() == 0
