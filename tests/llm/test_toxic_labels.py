"""Toxicity: the learnt lexicon by plain counting, recall by language, and labels that teach nothing."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from data import frame  # noqa: E402

from ledgerlens.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.1"


def test_recall_by_language(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = toxicity.score_toxicity(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id")
    held = scored.where("held_out AND toxic IS NOT NULL").select("lang", "toxic", "predicted").collect()
    seen = defaultdict(Counter)
    for r in held:
        seen[r["lang"]][r["toxic"], r["predicted"]] += 1
    assert len(seen) == 4
    for lang, c in seen.items():
        assert c[1, 1] >= 0.9 * (c[1, 1] + c[1, 0]), (lang, c)
        assert c[0, 1] <= 0.02 * (c[0, 0] + c[0, 1]) + 1, (lang, c)


def test_lexicon_by_plain_counting(spark):
    rows = [(f"{'vile' if i % 4 == 0 else 'kind'}{i % 3} stone w{i % 7}, Road.", float(i % 4 == 0)) for i in range(80)]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label double")).odds
    toxic, other = Counter(), Counter()
    for text, label in rows:
        found = set()
        for token in text.lower().split():
            word = token.strip(".,")
            found |= {word} | {"^" + word[:k] for k in (4, 5, 6) if len(word) > k}
        (toxic if label else other).update(found)
    share = 0.25
    want = {}
    for e, n in toxic.items():
        odds = math.log((n + 0.5 * share) / (20 + share)) - math.log((other[e] + 0.5 * (1 - share)) / (60 + 1 - share))
        if n >= toxicity.LEAST and odds >= toxicity.LEAST_ODDS:
            want[e] = odds
    assert got == pytest.approx(want) and "^vile" in got and "stone" not in got


@pytest.mark.parametrize(
    "labels",
    [
        [],
        [(i, 0, 1) for i in range(40)],
        [(i, 0, 0) for i in range(40)],
        [(1, 0, 1)],
        [(i % 3, 0, i % 2) for i in range(40)],
        [(i, 0, None) for i in range(40)],
    ],
    ids=["none", "toxic", "clean", "one", "repeated", "null"],
)
def test_labels_that_teach_nothing_drop_nothing(spark, labels):
    docs = frame(spark, [(i, f"text {i} of idiots", "en", "a", 0) for i in range(40)])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert toxicity.drop_toxic(docs, table).count() == 40
    assert all(r["predicted"] == 0 and r["score"] < 0.5 for r in toxicity.score_toxicity(docs, table).collect())


def test_repeated_documents_are_learnt_once(spark):
    docs = frame(spark, [(i, "calm" if i % 3 else "vile words", "en", "a", 0) for i in range(300)])
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    once = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs, labels).collect()}
    again = toxicity.score_toxicity(docs.unionByName(docs.where(F.col("doc_id") == 3)), labels.unionByName(labels)).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == once and len(again) == 301
