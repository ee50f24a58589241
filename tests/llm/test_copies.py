"""Exact and near duplicates, and mixing, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from data import frame  # noqa: E402

from ledgerlens.llm import bagminhash, exact, mixing, queries  # noqa: E402
from ledgerlens.llm.common import UPPER  # noqa: E402

LOWER = str.maketrans(UPPER, UPPER.lower())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    from oracle import connect, differences

    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) == []


def test_directory_splits_overfull_buckets(spark):
    hashes = spark.range(5000).selectExpr("xxhash64(id) AS h")
    directory, bits = exact.build_directory(hashes, capacity=64)
    rows = directory.collect()
    assert bits > 6 and len({r["slot"] for r in rows}) == len(rows)
    filled: dict[str, int] = {}
    bucket = {r["slot"]: r["bucket"] for r in rows}
    for r in hashes.collect():
        b = bucket[(r["h"] & (2**64 - 1)) >> (64 - bits)]
        filled[b] = filled.get(b, 0) + 1
    assert sum(filled.values()) == 5000 and max(filled.values()) <= 64
    assert {r["depth"] for r in rows} != {bits}


def test_exact_small_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    groups: dict[str, list[int]] = {}
    for r in rows:
        groups.setdefault((r["text"] or "").translate(LOWER), []).append(r["doc_id"])
    want = {i: (max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact.exact_duplicates(docs, capacity=4).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == {max(g) for g in groups.values()}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a = (np.sort(words[:45]), rng.integers(1, 9, 45))
    b = (np.sort(words[15:]), rng.integers(1, 9, 45))
    want = bagminhash.similarity(a, b)
    h = bagminhash.signatures([a, b], m=20_000)
    assert np.isfinite(h).all()
    assert abs((h[0] == h[1]).mean() - want) < 0.015
    counts = (np.sort(words[:1]), np.array([3])), (np.sort(words[:1]), np.array([7]))
    h = bagminhash.signatures(list(counts), m=20_000)
    assert abs((h[0] == h[1]).mean() - 3 / 7) < 0.015


def _groups(bags, threshold):
    root = list(range(len(bags)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where: dict[int, list[int]] = {}
    for i, b in enumerate(bags):
        for h in b[0].tolist():
            where.setdefault(h, []).append(i)
    pairs = {p for g in where.values() for p in itertools.combinations(g, 2)}
    pairs |= set(itertools.combinations([i for i, b in enumerate(bags) if not len(b[0])], 2))
    for i, j in pairs:
        if top(i) != top(j) and bagminhash.similarity(bags[i], bags[j]) >= threshold:
            root[top(i)] = top(j)
    return [top(i) for i in range(len(bags))]


def test_near_duplicates_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    for i in range(60):  # a chain of edits: neighbours are alike, ends are not
        base[rng.randrange(300)] = f"e{i}"
        rows.append((100_000 + i, " ".join(base)))
    rows += [(200_000 + i, "one two three") for i in range(30)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    bags = [bagminhash.bag((t or "").translate(LOWER)) for _, t in rows]
    want: dict[int, list[int]] = {}
    for (i, _), g in zip(rows, _groups(bags, 0.8), strict=True):
        want.setdefault(g, []).append(i)
    got = bagminhash.near_duplicates(docs).collect()
    classes: dict[int, list[int]] = {}
    for r in got:
        classes.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))
    assert {r["doc_id"] for r in got if r["kept"]} == {max(g) for g in want.values()}


def test_mix_shares_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 40), "en", rng.choice(["hot"] * 6 + ["b", "c", None]), 0) for i in range(3000)]
    docs = frame(spark, rows)
    out = mixing.mix(docs, rows_per_slice=200).collect()
    again = mixing.mix(docs.repartition(7), rows_per_slice=3000).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    source = {r[0]: r[3] for r in rows}
    taken: dict = {}
    target: dict = {}
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    total = sum(r["size"] for r in out)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    copies = mixing.mixed_documents(docs, rows_per_slice=200).collect()
    assert sum(len(r["text"].split()) for r in copies) == sum(taken.values())


def test_prefix_filter_and_sketches_lose_no_pair(spark):
    """All pairs at or above the threshold, of different groups, come out; repetitions and blocks included."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = draw.choices(words, k=draw.randint(30, 160))
        for _ in range(9):
            own = list(base)
            for _ in range(draw.randint(0, 1 + len(own) // 60)):
                own[draw.randrange(len(own))] = draw.choice(words)
            texts.append(" ".join(own + own[: draw.choice((0, 0, 40))]))
    bags = {bagminhash.bag_digest(b): b for b in map(bagminhash.bag, texts)}
    group = {d: d if i % 3 else "one" for i, d in enumerate(bags)}
    rows = [(d, group[d], bagminhash._pack(b)) for d, b in bags.items()]
    table = spark.createDataFrame(rows, "bag string, group string, packed binary")
    want = {
        tuple(sorted(p)) for p in itertools.combinations(bags, 2)
        if group[p[0]] != group[p[1]] and bagminhash.similarity(bags[p[0]], bags[p[1]]) >= 0.8
    }
    assert len(want) > 30
    found = {(r["b"], r["a"]) for r in bagminhash.prefix_pairs(table, 0.8).collect()}
    assert want <= found and len(found) < 4 * len(want)
    block, bagminhash.BLOCK = bagminhash.BLOCK, 3
    try:
        assert {(r["b"], r["a"]) for r in bagminhash.prefix_pairs(table, 0.8).collect()} == found
    finally:
        bagminhash.BLOCK = block
