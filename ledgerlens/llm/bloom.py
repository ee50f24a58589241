"""Bloom filters of a fixed size over 64-bit hashes, filled by Spark and looked up in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 4 MB, whatever goes in: a fuller filter lets more through, and never holds back what was put in.
BITS = 25
_WORD = 6


def bloom_filter(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter's 64-bit words, with two bits for each hash in ``column`` (well mixed bigints)."""

    def bit(shift: int) -> Column:
        return F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << bits) - 1))

    places = hashes.select(F.explode(F.array(bit(64 - bits), bit(0))).alias("bit"))
    mask = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(bit & {(1 << _WORD) - 1} AS INT))")
    words = places.groupBy(F.shiftright("bit", _WORD).alias("at")).agg(F.bit_or(mask).alias("mask")).toPandas()
    out = np.zeros(1 << (bits - _WORD), dtype=np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64, any shape) may be in the filter; True for all that were put in."""
    bits = int(len(words)).bit_length() - 1 + _WORD
    found = np.ones(hashes.shape, dtype=bool)
    for bit in (hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)):
        found &= (words[bit >> np.uint64(_WORD)] >> (bit & np.uint64((1 << _WORD) - 1))) & np.uint64(1) == 1
    return found
