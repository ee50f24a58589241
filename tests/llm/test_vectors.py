"""Near vectors against all pairs: recall, links, components."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import pivots, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, cosine=0.98):
    """(links of each row, component of each row) by every pair; rows as (vec_id, embedding, label)."""
    n = len(rows)

    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    by = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and usable(v):
            by.setdefault((label, len(v)), []).append(i)
    links, low = [set() for _ in rows], list(range(n))
    for own in by.values():
        x = pivots.unit(np.array([rows[i][1] for i in own], dtype=np.float64))
        for i, j in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if i != j:
                links[own[i]].add(own[j])
    done: set[int] = set()
    for i in range(n):
        if i in done:
            continue
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        done |= seen
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        for j in seen:
            low[j] = min(ids, default=None)
    return [len(x) for x in links], low


def _dense(seed=3, groups=12, size=60, width=24):
    draw = np.random.default_rng(seed)
    rows, vec_id = [], 0
    for g in range(groups):
        centre = draw.normal(size=width)
        for k in range(size if g else 5 * size):
            v = centre + draw.normal(size=width) * (0.02 if g % 2 else 0.2) if k % 7 else draw.normal(size=width)
            rows.append((vec_id, [float(np.float32(x)) for x in v], g % 3))
            vec_id += 1
    return rows


@pytest.mark.parametrize("block", [2048, 64])
def test_recall_and_precision(spark, block):
    rows = _dense()
    got = {r["vec_id"]: r for r in pivots.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    links, low = plain(rows)
    assert sum(links) > 2000
    found = [got[r[0]]["n_links"] for r in rows]
    assert all(f <= w for f, w in zip(found, links, strict=True))
    assert sum(found) >= 0.99 * sum(links)
    assert np.mean([got[r[0]]["component_id"] == w for r, w in zip(rows, low, strict=True)]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_on_the_registered_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links, low = plain(rows)
    got = {r["vec_id"]: r for r in queries.op12_pivot_index(spark, sf).collect()}
    assert len(got) == len(rows)
    assert sum(got[r[0]]["n_links"] for r in rows) >= 0.9 * sum(links)
    assert sum(got[r[0]]["component_id"] == w for r, w in zip(rows, low, strict=True)) >= 0.9 * len(rows)


def test_copies_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base, near, far = [1.0, 2.0, 3.0, 0.0], [1.0, 2.0, 3.1, 0.0], [3.0, -2.0, 0.0, 1.0]
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None]]
    rows = [(100 + i, base, 1) for i in range(400)]  # one vector very often
    rows += [(7, near, 1), (7, near, 1), (8, far, 1), (9, base, 2), (10, base, None), (None, near, 1)]
    rows += [(11, [2.0, 4.0, 6.0, 0.0], 1), (12, [1.0, 2.0, 3.0], 1), (13, [1e-30, 2e-30, 3e-30, 0.0], 1), (14, [1e30, 2e30, 3e30, 0.0], 1)]
    rows += [(20 + i, v, 1) for i, v in enumerate(odd)] + [(None, None, None)]
    links, low = plain(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    table = frame.withColumns({n: F.lit(0) for n in ("cls", "v", "n", "pair", "dim", "group", "ok")})
    for own in (frame, table):
        got = sorted(map(tuple, pivots.near_vectors(own).collect()), key=str)
        want = sorted(((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, low, strict=True)), key=str)
        assert got == want


def test_double_vectors_far_apart_in_size(spark):
    rows = [(1, [1e200, 2e200, 1e-200], 1), (2, [1.0, 2.0, 0.0], 1), (3, [1.0, -2.0, 0.0], 1), (4, [0.1, 0.2, 0.3], 1)]
    out = pivots.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_empty(spark):
    assert pivots.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pivots_lie_apart():
    draw = np.random.default_rng(2)
    centre = draw.normal(size=16)
    sample = pivots.unit(np.concatenate([centre + 0.01 * draw.normal(size=(500, 16)), draw.normal(size=(300, 16))]))
    chosen = pivots.choose_pivots(sample, 32)
    assert (chosen @ pivots.unit(centre[None])[0] > 0.98).sum() <= 1
    assert pivots.choose_pivots(sample[:1], 8).shape == (8, 16)
    assert (pivots.nearest_pivots(chosen[:5], chosen, 3)[:, 0] == np.arange(5)).all()
