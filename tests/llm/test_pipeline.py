"""The pipeline against a plain version of its stages."""

import pytest

import corpus_pipeline
from spendlake.llm import tokens
from test_corpus_operators import fold, near_brute, words13

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words13(r.text))]
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]

    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns
    left = {r.doc_id: r.text for r in good.collect()}
    known = [d for d in labels if labels[d] is not None]
    # The few labelled rows of this table: rejects are almost exactly those labelled so.
    assert sum((d in left) == bool(labels[d]) for d in known) >= 0.97 * len(known)

    newest = {}
    for d, t in left.items():
        newest[fold(t)] = max(d, newest.get(fold(t), d))
    left = {d: left[d] for d in newest.values()}
    left = {d: left[d] for d, _, root in near_brute(list(left.items())) if d == root}

    grams = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(max(1, len(w) - 12))}
    sizes = {len(g) for g in grams}

    def clean(text):
        w, hit = words13(text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
        return not hit or 20 * len(hit) < len(w)

    left = {d: t for d, t in left.items() if clean(t)}
    plain = tokens.load(tokens.vocabulary_path())
    want = {d: len(plain.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_documents(spark, docs, no_docs, name, stage):
    """Null ids and texts, repeated rows, very long texts, clashing column names, and no rows at all."""
    assert stage(spark, no_docs, SF).count() == 0
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    else:
        given = {(r.doc_id, r.text) for r in docs.collect()}
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and rows and {(r.doc_id, r.text) for r in rows} <= given
