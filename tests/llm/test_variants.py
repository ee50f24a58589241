"""Spelling variants against every pair of words compared."""

from __future__ import annotations

import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from data import EDGES, clashing, frame, nulls  # noqa: E402

from ledgerlens.llm import queries, spelling  # noqa: E402
from ledgerlens.llm.bloom import bloom_filter, may_hold  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_words(rows) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def result(rows) -> dict[str, tuple]:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def _texts(seed: int, count: int = 150):
    """Words of few syllables and their misspellings: many are near each other, some in long chains."""
    draw = random.Random(seed)
    parts = ["an", "ber", "é", "tion", "x", "the", "ü", "in"]
    stock = ["".join(draw.choices(parts, k=draw.randint(2, 6))) for _ in range(120)]
    rows = []
    for i in range(count):
        words = []
        for w in draw.choices(stock, weights=[1 / (k + 1) for k in range(len(stock))], k=60):
            turn = draw.random()
            at = draw.randrange(len(w))
            if turn < 0.1:
                w = w[:at] + draw.choice("abzé") + w[at + 1 :]
            elif turn < 0.2:
                w = w[:at] + draw.choice("abzé") + w[at:]
            words.append(w.upper() if turn > 0.95 else w)
        rows.append((i, " ".join(words) + "."))
    chain = {"chainaaa": 4, "chainaab": 9, "chainabb": 20, "chainbbb": 44}
    return rows + [(1000 + i, w) for i, w in enumerate(w for w, n in chain.items() for _ in range(n))]


@pytest.mark.parametrize("longest_list", [1, 4, 64])
def test_all_pairs(spark, longest_list):
    rows = _texts(longest_list)
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = result(spelling.spelling_variants(docs, longest_list=longest_list).collect())
    want = plain_variants(plain_words(rows))
    assert len(want) > 100 and any(v[1] != (v[0] or w) for w, v in want.items())
    assert got == want


def test_whole_table(spark, sf):
    """The registered query with its own parameters."""
    got = result(queries.op11_gram_variants(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == plain_variants(plain_words([tuple(r) for r in docs]))


def test_words_in_any_list_order(spark):
    """Ties in n: the smaller word; ratio at exactly 2; chains of forms."""
    words = {"abcdef": 12, "abcdeg": 6, "abcdxg": 3, "zbcdef": 12, "ubcdef": 24, "ñbcdef": 24, "abcdefg": 5}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    pairs = {(r["a"], r["b"]) for r in spelling.near_words(table, 2).collect()}
    assert pairs == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    roots = spelling.follow(spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)], "word string, form string"))
    assert {(r["word"], r["root"]) for r in roots.collect()} == {(str(i), "37") for i in range(37)}


def test_edges(spark):
    rows = [*EDGES, *EDGES, *EDGES, (20, ("w" * 30_000 + " ") * 3 + ("w" * 30_001 + " ") * 7, "en", "a", 0)]
    want = plain_variants(plain_words([(r[0], r[1]) for r in rows]))
    assert result(spelling.spelling_variants(frame(spark, rows)).collect()) == want
    assert result(spelling.spelling_variants(clashing(frame(spark, rows))).collect()) == want
    assert want["w" * 30_000][3] == 1
    for empty in (frame(spark, []), nulls(frame(spark))):
        assert spelling.spelling_variants(empty).collect() == []


def test_filter_holds_what_was_put_in(spark):
    hashes = spark.range(2000).selectExpr("xxhash64(id) AS h")
    put = np.array([r["h"] for r in hashes.collect()], dtype=np.int64).view(np.uint64)
    words = bloom_filter(hashes, "h", 16)
    assert may_hold(words, put).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    assert may_hold(words, others).mean() < 0.02
