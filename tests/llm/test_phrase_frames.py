"""Collocations send counts back in frames of bounded size and never broadcast tables that grow with the corpus."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations as col


class _Corpus:
    """Runs the task function on rows of codes where Spark would."""

    def __init__(self, rows):
        self.rows = rows

    def mapInPandas(self, run, schema):
        raise _Frames(list(run(iter([pd.DataFrame({"codes": pd.Series(self.rows, dtype=object)})]))))


class _Frames(Exception):
    pass


class _All:
    value = np.full(1 << 19, np.uint64(0xFFFFFFFFFFFFFFFF))


@pytest.fixture
def rows():
    rng = np.random.default_rng(1)
    return [rng.integers(1, 1 << 62, 1_000) for _ in range(250)]


def frames(call):
    with pytest.raises(_Frames) as caught:
        call()
    return caught.value.args[0]


def test_grown_phrases_come_in_bounded_frames(rows):
    found = frames(lambda: col.grow(_Corpus(rows), 2, _All, None))
    assert max(map(len, found)) <= 65_536
    pairs = Counter((int(r[i]), int(r[i + 1])) for r in rows for i in range(len(r) - 1))
    both = pd.concat(found)
    assert len(both) == len(pairs) and both["a"].sum() == sum(pairs.values())
    assert set(zip(both["prefix"], both["last"])) == set(pairs)


def test_looked_up_phrases_come_in_bounded_frames(rows):
    found = frames(lambda: col.look_up(_Corpus(rows), _All))
    assert max(map(len, found)) <= 65_536
    assert pd.concat(found)["n"].sum() == sum(len(r) - k for r in rows for k in (1, 2, 3))


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    plans = {}
    plain = col.materialize

    def noted(df, name="stage", **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name, **options)

    monkeypatch.setattr(col, "materialize", noted)
    docs = spark.range(200).select(F.lit("en").alias("lang"), F.concat(F.lit("red fox runs "), "id").alias("text"))
    out = {r["phrase"]: r["a"] for r in col.collocations(docs, 10, 100, 3).collect()}
    assert out == {"red fox runs": 200}
    for name in ("phrases-2", "phrases-3", "collocations"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], name
