"""A pair that shares many occurrences leaves the tasks it meets in once, and none is lost."""

import numpy as np

from ledgerlens.llm import bagminhash


def test_pairs_leave_one_of_their_meetings(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[: 10 * i], f"x{i}", *base[10 * i + 1 :]]) for i in range(12)]
    bags = [bagminhash.bag(t) for t in texts]
    rows = [(str(i), str(i), bagminhash._pack(b)) for i, b in enumerate(bags)]
    table = spark.createDataFrame(rows, "bag string, group string, packed binary")
    monkeypatch.setattr(type(table), "distinct", lambda df: df)
    pairs = [tuple(r) for r in bagminhash.prefix_pairs(table, 0.8).collect()]
    want = {
        (str(max(str(i), str(j))), min(str(i), str(j)))
        for i in range(12)
        for j in range(i)
        if bagminhash.similarity(bags[i], bags[j]) >= 0.8
    }
    assert want and want <= set(pairs) and len(pairs) == len(set(pairs))


def test_a_pair_has_one_home_or_leaves_every_meeting():
    rng = np.random.default_rng(3)
    for shared in (1, 5, 40):
        own = [rng.integers(0, 2**63, 40).astype(np.uint64) for _ in range(2)]
        common = rng.integers(0, 2**63, shared).astype(np.uint64)
        a, b = (np.concatenate([common, o])[None, :] for o in own)
        left, right = (bagminhash.homes(x[0])[None, :] for x in (a, b))
        left_at = [bool(bagminhash.paired_at(left, right, o)[0]) for o in common]
        assert sum(left_at) == (1 if (left == right).any() else shared)
    assert (bagminhash.homes(np.zeros(0, dtype=np.uint64)) == 0).all()
