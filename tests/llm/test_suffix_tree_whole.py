"""The sharded suffix tree against the small one, and its growth with the corpus."""

from __future__ import annotations

import os
import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from data import EDGES, frame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ledgerlens.llm import suffix_tree  # noqa: E402
from ledgerlens.llm.common import lower_ascii, whole  # noqa: E402
from ledgerlens.session import materialize  # noqa: E402


@pytest.mark.parametrize("shard_grams", [7, 10**6])
def test_shards_score_as_the_small_tree(spark, shard_grams):
    docs = frame(spark, EDGES + [(20 + i, "éa banana abracadabra über 漢字", "en", "a", 9) for i in range(9)])
    rows = docs.select(F.lit(False).alias("held_out"), lower_ascii(whole()).alias("text"))
    units = suffix_tree.count_units(rows, 5)
    got = {r["uid"]: r["log"] for r in suffix_tree.score_units(units, 3, 0.5, 5, shard_grams).collect()}
    small = suffix_tree.fit_tree(suffix_tree.corpus_counts(rows.select("text")), worth=0.5, min_count=3)
    assert sum(len(level[0]) for level in small.levels[1:]) > 20
    for r in units.collect():
        unit = bytes(r["unit"])
        codes = [int.from_bytes(unit[i - 5 : i][::-1], "big") << 8 | unit[i] for i in range(5, len(unit))]
        assert got[r["uid"]] == pytest.approx(small.log10(np.array(codes, dtype=np.int64)).sum(), rel=1e-9)


def test_a_context_stays_however_large_the_corpus(spark):
    """A context of two words, far below a share of 1e-5 of the symbols, still predicts."""
    rare = [(i, "green zebra") for i in range(40)] + [(40 + i, "brown zebu") for i in range(40)]
    many = [(1000 + i, " ".join(f"w{(i * 7919 + j) % 5003}" for j in range(1500))) for i in range(1200)]
    docs = spark.createDataFrame(rare + many, "doc_id bigint, text string").repartition(8)
    rows = docs.select(F.lit(False).alias("held_out"), F.col("text"))
    tree = suffix_tree.fit_levels(suffix_tree.in_shards(suffix_tree.count_grams(suffix_tree.count_units(rows)), []))
    assert tree.where("k > 5").count() > 0
    found = tree.where("k >= 5").select("k", "hi", "lo").distinct().collect()
    spelled = [
        ((r["hi"] & (1 << 64) - 1).to_bytes(8, "big")[-min(r["k"], 8):] + r["lo"].to_bytes(8, "big")[8 - max(0, r["k"] - 8):])[::-1]
        for r in found
    ]
    assert any(b"n zeb" in c for c in spelled)


def test_packed_grams_and_logs_come_back():
    rng = np.random.default_rng(3)
    text = np.array([b"the ", b"of ", b"\xc3\xa9t", b"an"], dtype=object)[rng.integers(0, 4, 9000)]
    units = [b"\n" * 8 + b"".join(text[i : i + 90]) + b"\n" for i in range(0, 9000, 90)]
    n = rng.integers(0, 2, len(units))
    frame = pd.DataFrame({"uid": np.arange(len(units)), "unit": units, "n": n})
    row = suffix_tree._packed(0, [frame]).iloc[0]
    pack = suffix_tree.Pack(row["size"], row["body"], 8)
    want: Counter = Counter()
    for unit, times in zip(units, n.tolist(), strict=True):
        for i in range(8, len(unit)):
            want[unit[i - 8 : i], unit[i]] += times
    values, first = np.unique(row["n"], return_index=True)
    got = {}
    for lead, at in pack.leads():
        keys, sums = suffix_tree.count_keys(pack.keys(at), values, np.searchsorted(at, (pack.ends - pack.size)[first]))
        planes = suffix_tree.encode_keys(keys, sums * 200, 8)
        again, counts = suffix_tree.decode_keys(planes, len(keys), 8)
        assert (again == keys).all() and (counts == sums * 200).all() and sum(map(len, planes)) < 9 * len(keys) + 400
        for context, key, times in zip(suffix_tree._context(lead, keys, 8), keys.tolist(), sums.tolist(), strict=True):
            got[int(context).to_bytes(8, "big")[::-1], key & 255] = times
    assert got == dict(want)
    logs = np.log10(rng.random(50))[rng.integers(0, 50, 1000)]
    sent = suffix_tree.encode_logs(logs)
    assert suffix_tree.decode_logs(sent, 1000) == pytest.approx(logs, rel=1e-12)
    assert sum(map(len, sent)) < 8 * len(logs) / 4


def test_no_gram_is_a_row(spark):
    """Before, every word with the bytes before it was a row of a written table: 4 times the input at depth 8."""
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 107, (400, 3000)).astype(np.uint8)
    letters[:, 7::8] = 32
    docs = spark.createDataFrame([(i, bytes(row).decode()) for i, row in enumerate(letters)], "doc_id bigint, text string")
    written: list = []

    def counted(df, name="stage", **options):
        out = materialize(df, name, **options)
        written.append((name, out.count()))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_tree, "materialize", counted)
        assert suffix_tree.score_texts(docs.repartition(4)).count() == 400
    assert dict(written)["unit-logs"] == 400 and not {"units", "grams", "states", "tree"} & set(dict(written))


def test_bounds_begin_short_contexts():
    """Before, every bound was a whole context, whose eight prefixes every pack had to count."""
    drawn = sorted(int.from_bytes(bytes([a, b, *b"etaoin"]), "big") for a in range(97, 123) for b in range(97, 123))
    bounds = suffix_tree.short_bounds(drawn)
    assert len(bounds) == len(drawn) and all(b & (1 << 40) - 1 == 0 for b in bounds[:-1])
    assert suffix_tree.short_bounds([5, 6, 7]) == [5, 6, 7] and suffix_tree.short_bounds([]) == []
