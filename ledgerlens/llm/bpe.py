"""Byte-level BPE over a table of distinct words.

A task splits its texts into the words of the tokenizer's own pattern, encodes every distinct word
once (a bounded table that is emptied when full), and joins the ids back by position. Decoding joins
ids with their pieces. The vocabulary file is read on the driver and travels with the function.

Null text counts as empty and has no ids. The marker of the end-of-text token is a word of its own,
as the tokenizers library treats it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, whole

TABLE_WORDS = 200_000
WORDS_PER_CALL = 1_000
# Fixed value: the split pattern of this vocabulary family; white space is the Unicode property.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def _byte_of_sign() -> dict[str, int]:
    """Vocabulary files write each byte as a printable sign; unprintable bytes follow after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_table(vocabulary: str) -> list[bytes]:
    """The bytes of every id."""
    spec, signs = json.loads(vocabulary), _byte_of_sign()
    pieces = {i: bytes(signs[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def decoded_text(pieces: list[bytes], ids: np.ndarray) -> str:
    return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")


class WordTable:
    """Ids of distinct words, as the bytes of little-endian 32-bit integers."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
        marks = "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))
        self.added = regex.compile(f"({marks})") if marks else None
        self.split = regex.compile(SPLIT)
        self.ids: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.split.findall(text)
        out = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else self.split.findall(part)
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode words that are not in the table yet.

        Words of a space and letters split again where they were joined, so many share one call;
        the library says which word a token belongs to.
        """
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        single = [w for w in new if not (w[0] == " " and w[1:].isalpha())]
        for i in range(0, len(plain), WORDS_PER_CALL):
            part = plain[i : i + WORDS_PER_CALL]
            found = self.tokenizer.encode("".join(part), add_special_tokens=False)
            owner = np.array(found.word_ids)
            if owner[-1] + 1 != len(part):  # split elsewhere: one by one
                single += part
                continue
            raw = np.array(found.ids, dtype="<u4").tobytes()
            cuts = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
            for word, a, b in zip(part, cuts, cuts[1:], strict=False):
                self.ids[word] = raw[a:b]
        for i in range(0, len(single), WORDS_PER_CALL):
            part = single[i : i + WORDS_PER_CALL]
            for word, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                self.ids[word] = np.array(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.ids) > TABLE_WORDS:
            self.ids.clear()
        self._learn(list({w for words in split for w in words if w not in self.ids}))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text."""
    small_batches(docs.sparkSession)
    vocabulary = _read(path)

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = WordTable(vocabulary)
        for batch in batches:
            yield pd.Series([np.frombuffer(b, dtype="<i4") for b in table.encode(list(batch))], dtype=object)

    return docs.withColumn(ids, encoded(whole(text)))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids; bytes that are no UTF-8 become the replacement sign."""
    vocabulary = _read(path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = piece_table(vocabulary)
        for batch in batches:
            yield pd.Series([decoded_text(pieces, row) for row in batch], dtype=object)

    return df.withColumn(text, decoded(ids))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes as ``encode`` and ``decode`` do, in one pass that only sends digests back.
    """
    small_batches(docs.sparkSession)
    vocabulary = _read(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, pieces = WordTable(vocabulary), piece_table(vocabulary)
        for batch in batches:
            ids = table.encode(list(batch["text"]))
            texts = [decoded_text(pieces, np.frombuffer(b, dtype="<u4")) for b in ids]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_tokens": [len(b) // 4 for b in ids],
                    "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                }
            )

    rows = docs.select("doc_id", whole().alias("text"))
    return rows.mapInPandas(digested, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
