"""Registered corpus queries against DuckDB, and what SQL cannot express against the libraries' plain use."""

import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from oracle import compare
from spendlake.llm import queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(spark, name):
    _, diffs = compare(spark, queries.QUERIES[name], queries.SQL[name], SF)
    assert not diffs


def test_all_are_registered():
    names = set(contract.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.fixture(scope="module")
def plain_ids():
    t = tokens.load(tokens.vocabulary_path())
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_wavelet_query(spark, plain_ids):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op2_wavelet_token_shards"](spark, SF).collect()}
    want, at = {}, 0
    for d, ids in plain_ids.items():
        want[d] = (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1
    assert got == want


def test_packing_query(spark, plain_ids):
    rows = queries.QUERIES["op6_harmonic_packing"](spark, SF).collect()
    seen, sequences = {}, {}
    for r in rows:
        ids = [*plain_ids[r.doc_id], 1]
        assert r.doc_tokens == len(ids) and crc(ids[r.start : r.start + r.length]) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places, total in [(seen[d], len(ids) + 1) for d, ids in plain_ids.items()] + [(v, None) for v in sequences.values()]:
        end = 0
        for at, n in sorted(places):
            assert at == end and n > 0
            end += n
        assert end == total if total else end <= 2048
    used = sum(n for v in sequences.values() for _, n in v)
    full = sum(2048 if (n := sum(x for _, x in v)) & (n - 1) else n for v in sequences.values())
    assert (full - used) / used < 0.02


@pytest.mark.parametrize("name, label, least", [("op8_factorisation_quality", "quality", 0.95), ("op10_toxicity_grammar", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known[label]).mean() >= least


def test_repeats_query_against_counting(spark):
    from collections import Counter

    texts = dict(duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    grams = Counter(b[i : i + 200] for t in texts.values() for b in [t.encode()] for i in range(len(b) - 199))
    for r in queries.QUERIES["op9_sparse_prefix_doubling"](spark, SF).collect():
        b = texts[r.doc_id].encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 199):
            if grams[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = gone.cumsum()[:-1] > 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), gone.sum(), (np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
