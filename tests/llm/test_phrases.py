"""Collocations against all phrases counted."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from data import EDGES, clashing, frame, nulls  # noqa: E402

from ledgerlens.llm import collocations as c  # noqa: E402
from ledgerlens.llm import queries  # noqa: E402

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(rows, top=2000, least=100):
    """rows: (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in found.items():
            parts = (p[s:e] for s in range(len(p)) for e in range(s + 2, len(p) + 1) if e - s < len(p))
            inside.update(q for q in parts if 100 * a >= 100 * found[q])
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


def _rows(seed, count=200):
    draw = random.Random(seed)
    stock = [f"{w}{i}" for i in range(30) for w in ("a", "É", "x-")]
    idioms = [draw.choices(stock, k=draw.randint(2, 7)) for _ in range(15)]
    rows = []
    for _ in range(count):
        words = []
        for _ in range(40):
            words += draw.choice(idioms) if draw.random() < 0.2 else [draw.choice(stock[: draw.choice((3, 20, 90))])]
            if draw.random() < 0.1:
                words.append(draw.choice([".", "!?", "\n", ",", "\t"]))
        rows.append((draw.choice(["en", "de", None, ""]), " ".join(words)))
    return rows


@pytest.mark.parametrize("top,least", [(5, 3), (40, 10), (2000, 3)])
def test_all_phrases(spark, top, least):
    rows = _rows(top)
    docs = frame(spark, [(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)])
    want = plain(rows, top, least)
    assert len(want) > 10
    assert result(c.collocations(docs, top, least)) == want


def test_whole_table(spark, sf):
    """The registered query with its own parameters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    assert result(queries.op13_collocations(spark, sf)) == plain([tuple(r) for r in docs])


def test_frontier_is_expanded_until_settled(spark, monkeypatch):
    """Turns end once no first word left can reach the last score, and not before."""
    rows = _rows(7)
    docs = frame(spark, [(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)])
    turns = []
    monkeypatch.setattr(c, "FIRST_SHARE", 1 / 200)
    expand = c._expand
    monkeypatch.setattr(c, "_expand", lambda *a: turns.append(a[2].count()) or expand(*a))
    assert result(c.collocations(docs, 2, 3)) == plain(rows, 2, 3)
    few = len(turns), sum(turns)
    assert result(c.collocations(docs, 2000, 3)) == plain(rows, 2000, 3)
    assert few[0] > 1 and sum(turns) - few[1] > few[1]


def test_edges(spark):
    repeats = [(30 + i, "so so so so so so so so; Ünder THE sea\tunder the sea", "fr", "a", 0) for i in range(60)]
    rows = [*EDGES, *EDGES, *repeats, (99, "same words " * 300, None, None, None)]
    want = plain([(r[2], r[1]) for r in rows])
    assert {w[0] for w in want} >= {"fr", "und"}
    assert result(c.collocations(frame(spark, rows))) == want
    assert result(c.collocations(clashing(frame(spark, rows)))) == want
    for empty in (frame(spark, []), nulls(frame(spark))):
        out = c.collocations(empty)
        assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
