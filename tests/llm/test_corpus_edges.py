"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns in every operator."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from data import EDGES, clashing, frame, nulls  # noqa: E402

from ledgerlens.llm import bagminhash, bpe, digest, exact, mixing, notices, pseudonyms, suffix_tree, toxicity  # noqa: E402


def _labels(spark, rows=((1, 0, 0), (2, 0, 1), (6, 1, 0), (None, 1, 1), (7, 1, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


ROWWISE = {
    "digest": digest.compare_edited,
    "suffix_tree": suffix_tree.score_texts,
    "bagminhash": bagminhash.near_duplicates,
    "pseudonyms": pseudonyms.pseudonymise,
    "notices": notices.scan_notices,
    "mixing": mixing.mix,
    "exact": exact.exact_duplicates,
    "bpe": bpe.digests,
    "toxicity": lambda d: toxicity.score_toxicity(d, _labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_every_row_has_a_result(spark, name):
    for table, n in ((frame(spark), len(EDGES)), (clashing(frame(spark)), len(EDGES)), (nulls(frame(spark)), 3)):
        assert len(ROWWISE[name](table).collect()) == n


@pytest.mark.parametrize("name", ROWWISE)
def test_empty_table(spark, name):
    assert ROWWISE[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["exact", "near", "mix", "toxic"])
def test_filters_keep_all_columns(spark, name):
    step = {
        "exact": exact.drop_duplicates,
        "near": bagminhash.drop_near_duplicates,
        "mix": mixing.mixed_documents,
        "toxic": lambda d: toxicity.drop_toxic(d, _labels(spark)),
    }[name]
    for table in (frame(spark), clashing(frame(spark)), frame(spark, []), nulls(frame(spark))):
        out = step(table)
        assert out.columns == table.columns
        seen = {tuple(r) for r in table.collect()}
        assert all(tuple(r) in seen for r in out.collect())


def test_pages_edges(spark):
    from ledgerlens.llm.html import extract_pages

    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<" * 5000), (3, "u", "<p>" + "y " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("row", F.lit(1))
    out = extract_pages(pages).select("page_id", "text").collect()
    assert [r["text"] for r in out[:3]] == ["", "", "x"]
    assert len(out) == 5 and len(out[4]["text"]) == 399_999
    assert extract_pages(pages.limit(0)).collect() == []


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("some", EDGES), ("none", [])):
        folder = str(tmp_path / name)
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        _labels(spark).write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in out} <= {r[0] for r in rows}
        assert bool(out) == bool(rows)
