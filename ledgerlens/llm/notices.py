"""Short license notices: exact phrases, and notices with a bounded number of edits.

Texts are compared as words joined by single spaces. A notice of n characters may differ by k edits;
cut into k + 1 pieces, one piece of every such match is unchanged (pigeonhole). Exact places of the
pieces give windows, in which the regex library's bounded-error matching finds the match and counts
its edits. Spans are word positions.

Null text counts as empty: no words, no labels, score 0. The score is the best match's likeness,
1 - edits / length of the notice; an exact phrase scores 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from bisect import bisect_right

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, small_batches, whole

# Exact phrases and notices, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license": "gpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
CHARS_PER_EDIT = 12
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Notice:
    def __init__(self, text: str, label: str):
        self.text, self.label = text, label
        self.edits = max(1, len(text) // CHARS_PER_EDIT)
        cuts = [len(text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rf"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={self.edits}}}")

    def windows(self, text: str) -> list[tuple[int, int]]:
        """Stretches that hold every match, from the exact places of the pieces."""
        k, found = self.edits, []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                found.append((max(0, at - offset - k), min(len(text), at - offset + len(self.text) + k)))
                at = text.find(piece, at + 1)
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the verified matches, left to right."""
        for a, b in self.windows(text):
            # A match starts and ends at words, else "small rights reserved" would be one.
            for m in self.pattern.finditer(text, a, b):
                start, end = m.start(), m.end()
                while start < end and text[start] == " ":
                    start += 1
                while end > start and text[end - 1] == " ":
                    end -= 1
                before = start == 0 or text[start - 1] == " "
                after = end == len(text) or text[end] == " "
                edits = sum(m.fuzzy_counts)
                if edits < self.edits or (before and after):
                    yield start, end, edits


_notices = [Notice(t, label) for t, label in NOTICES.items()]


def scan(text: str) -> dict:
    """Words, exact places and verified notices of one text (A-Z already lower-cased)."""
    words = WORD.findall(text)
    joined = " ".join(words)
    padded = f" {joined} "
    starts: list[int] = []

    def word_at(char: int) -> int:
        if not starts:
            at = 0
            for w in words:
                starts.append(at)
                at += len(w) + 1
        return bisect_right(starts, char) - 1

    places, spans = [], []
    for phrase, label in PHRASES.items():
        key = f" {phrase} "
        at = padded.find(key)
        while at >= 0:
            places.append((word_at(at), label))
            at = padded.find(key, at + 1)
    best = 1.0 if places else 0.0
    for notice in _notices:
        for start, end, edits in notice.matches(joined):
            spans.append((notice.label, word_at(start), word_at(max(start, end - 1)), edits))
            best = max(best, 1 - edits / len(notice.text))
    labels = {label for _, label in places}
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min((w for w, _ in places), default=None),
        "last_word": max((w for w, _ in places), default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {s[0] for s in spans})),
        "score": best,
        "spans": [dict(zip(("label", "first", "last", "edits"), s, strict=True)) for s in spans],
    }


def scan_notices(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, labels, score and the spans of verified notices."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([scan(t) for t in batch["text"]], index=batch.index)
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    return docs.select("doc_id", lower_ascii(whole()).alias("text")).mapInPandas(
        scanned,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, edits: int>>",
    )
