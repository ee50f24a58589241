"""Document fingerprints from statistically improbable features.

Every window of 64 bytes gets the entropy of its bytes, in 1,000 steps. Entropies that are rare in
the whole corpus rank first. In every run of 64 neighbouring windows the best rank (leftmost on ties)
gets a point; windows with enough points are the features. Features enter Bloom filters of 2,048
bits with five bits each; a full filter (160 features) is followed by the next one of the chain.

Two fingerprints are compared filter by filter: shared bits above what chance would share, over the
most that could be shared. Each filter of the shorter chain takes its best partner; the mean, weighted
by features, is the likeness (0 to 1). Null counts as empty; a text under 64 bytes is one feature; two
empty texts are alike (1), an empty and another one are not (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_batches, whole

WIDTH = 64
RUN = 64
POINTS = 16
STEPS = 1000
BITS = 2048
PER_FILTER = 160
HASHES = 5
ROWS_PER_BUCKET = 500
# Larger tables get longer buckets, not more: tasks read them as a stream.
MAX_BUCKETS = 2_000
TOGETHER = 500_000
_ONE = 1 << 20
# c * log2(c) as whole numbers: sums along a text then do not depend on where it starts.
_PLOGP = np.array([0] + [round(c * np.log2(c) * _ONE) for c in range(1, WIDTH + 1)], dtype=np.int64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def entropies(raw: np.ndarray) -> np.ndarray:
    """Entropy step of every window of WIDTH bytes; empty for shorter texts."""
    n = len(raw)
    if n < WIDTH:
        return np.zeros(0, dtype=np.int64)
    ahead, behind = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    for d in range(1, WIDTH):
        same = (raw[:-d] == raw[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    leaves, enters = ahead[: n - WIDTH].astype(np.int64), behind[WIDTH:].astype(np.int64)
    # Moving on by one byte: one count falls, then one rises.
    change = _PLOGP[leaves - 1] - _PLOGP[leaves] + _PLOGP[enters] - _PLOGP[enters - 1]
    counts = np.bincount(raw[:WIDTH], minlength=256)
    spread = np.empty(n - WIDTH + 1, dtype=np.int64)
    spread[0] = _PLOGP[counts].sum()
    np.cumsum(change, out=spread[1:])
    spread[1:] += spread[0]
    return (STEPS * (6 * WIDTH * _ONE - spread)) // (6 * WIDTH * _ONE)


def entropies_of(raws: list[np.ndarray]) -> Iterator[np.ndarray]:
    """``entropies`` of many texts: short ones are strung together, as a window's step only depends on it."""
    held: list[np.ndarray] = []
    size = 0

    def steps() -> Iterator[np.ndarray]:
        all_steps, at = entropies(np.concatenate(held)), 0
        for raw in held:
            yield all_steps[at : at + max(0, len(raw) - WIDTH + 1)]
            at += len(raw)

    for raw in raws:
        held.append(raw)
        size += len(raw)
        if size > TOGETHER:
            yield from steps()
            held, size = [], 0
    if held:
        yield from steps()


def _bytes(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8) for t in texts]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(raw: np.ndarray, steps: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the selected windows in text order, each hash once."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    wide = min(WIDTH, len(raw))
    if len(steps):
        key = (ranks[steps].astype(np.int64) << 32) | np.arange(len(steps))
        best, size = key, 1
        while size * 2 <= min(RUN, len(steps)):
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        points = np.bincount(best & 0xFFFFFFFF, minlength=len(steps))
        chosen = np.flatnonzero(points >= min(POINTS, points.max()))
    else:
        chosen = np.zeros(1, dtype=np.int64)
    windows = raw[chosen[:, None] + np.arange(wide)].astype(np.uint64)
    h = np.full(len(chosen), wide, dtype=np.uint64)
    for start in range(0, wide, 8):
        word = np.zeros(len(chosen), dtype=np.uint64)
        for i in range(start, min(start + 8, wide)):
            word = (word << np.uint64(8)) | windows[:, i]
        h = _mix(h * _GOLDEN + word)
    return h[np.sort(np.unique(h, return_index=True)[1])]


def _filters(h: np.ndarray) -> np.ndarray:
    filters = -(-len(h) // PER_FILTER)
    bits = np.zeros((filters, BITS), dtype=bool)
    row = np.arange(len(h)) // PER_FILTER
    place = h
    for _ in range(HASHES):
        place = place + _ODD
        bits[row, (_mix(place) % np.uint64(BITS)).astype(np.int64)] = True
    return bits


def fingerprint_many(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of every text: one row of BITS booleans per filter."""
    raws = _bytes(texts)
    return [_filters(features(raw, steps, ranks)) for raw, steps in zip(raws, entropies_of(raws), strict=True)]


def fingerprint(text: str, ranks: np.ndarray) -> np.ndarray:
    return fingerprint_many([text], ranks)[0]


def to_hex(bits: np.ndarray) -> str:
    return f"{len(bits)}:" + np.packbits(bits, axis=1).tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    n, _, body = text.partition(":")
    raw = np.frombuffer(bytes.fromhex(body), dtype=np.uint8)
    return np.unpackbits(raw.reshape(int(n), BITS // 8), axis=1).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if (len(a), a.sum()) > (len(b), b.sum()):
        a, b = b, a
    ones_a, ones_b = a.sum(axis=1).astype(float), b.sum(axis=1).astype(float)
    shared = a.astype(np.float32) @ b.astype(np.float32).T
    chance = ones_a[:, None] * ones_b[None, :] / BITS
    most = np.minimum(ones_a[:, None], ones_b[None, :])
    score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    weights = ones_a / ones_a.sum()
    return float(min(1.0, (score.max(axis=1) * weights).sum()))


def entropy_ranks(docs: DataFrame, text: str = "text") -> list[int]:
    """Rank of every entropy step: the rarer in the whole corpus, the lower; ties by the step."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(STEPS + 1, dtype=np.int64)
        for batch in batches:
            for steps in entropies_of(_bytes(batch["text"].tolist())):
                total += np.bincount(steps, minlength=STEPS + 1)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"step": used, "n": total[used]})

    found = docs.select(whole(text).alias("text")).mapInPandas(count, "step int, n bigint")
    counts = {r["step"]: r["n"] for r in found.groupBy("step").agg(F.sum("n").alias("n")).collect()}  # at most STEPS + 1
    order = sorted(range(STEPS + 1), key=lambda s: (counts.get(s, 0), s))
    ranks = [0] * (STEPS + 1)
    for place, step in enumerate(order):
        ranks[step] = place
    return ranks


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the text, as the number of filters and their bits in hex."""
    small_batches(docs.sparkSession)
    ranks = np.array(entropy_ranks(docs, text))

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([to_hex(f) for f in fingerprint_many(texts.tolist(), ranks)], dtype=object)

    return docs.withColumn(out, made(whole(text)))


def with_neighbours(
    docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS
) -> DataFrame:
    """Rows dealt to buckets of falling ids, each bucket ended by the first row of the next one.

    Columns: place (the id, null lowest), digest, doc_id, text, bucket, extra (the borrowed row).
    The bucket borders are fixed numbers, so a task that runs again sees the same rows.
    """
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    rows = docs.select(place.alias("place"), "doc_id", whole().alias("text")).withColumn("digest", F.xxhash64("text"))
    total = rows.count()
    buckets = max(1, min(max_buckets, total // rows_per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    borders = rows.agg(F.percentile_approx("place", shares, 100 * buckets).alias("q")).first()["q"] if shares else []
    borders = sorted(set(borders or []), reverse=True)
    above = F.lit(0)
    if borders:
        # Number of borders above the id.
        above = F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b > F.col("place")))
    rows = rows.withColumn("bucket", above)
    heads = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("place").alias("top")).collect()}
    used = sorted(heads)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first bucket's head ends the last one
    if not used:
        return rows.withColumn("extra", F.lit(False))
    to = F.create_map(*[F.lit(int(x)) for pair in before.items() for x in pair])
    first = rows.where(F.col("place").isin(list(heads.values()))).withColumn("bucket", to[F.col("bucket")])
    both = rows.withColumn("extra", F.lit(False)).unionByName(first.withColumn("extra", F.lit(True)))
    dealt = both.repartitionByRange(len(used), "bucket")
    return dealt.sortWithinPartitions("bucket", "extra", F.desc("place"), "digest")


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and both likenesses."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranks = np.array(entropy_ranks(docs))

    columns = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the row that waits for the one after it: id, text, fingerprint
        finished = None  # the bucket whose borrowed row has come
        for batch in batches:
            own = fingerprint_many(batch["text"].tolist(), ranks)
            pairs = []
            for doc_id, text, bucket, extra, made in zip(
                batch["doc_id"].tolist(), batch["text"], batch["bucket"], batch["extra"], own, strict=True
            ):
                if bucket == finished:
                    continue  # more borrowed rows than needed
                if last is not None:
                    half = len(last[1]) // 2
                    pairs.append((*last, last[1][: len(last[1]) - half] + text[:half], made))
                finished, last = (bucket, None) if extra else (finished, (doc_id, text, made))
            changed = fingerprint_many([p[3] for p in pairs], ranks)
            out = [
                (i, len(text), edited, to_hex(mine), to_hex(new), likeness(mine, new), likeness(mine, following))
                for (i, text, mine, edited, following), new in zip(pairs, changed, strict=True)
            ]
            frame = pd.DataFrame(out, columns=columns)
            frame["doc_id"] = pd.array([None if pd.isna(p[0]) else int(p[0]) for p in pairs], dtype="Int64")
            yield frame

    schema = (
        f"doc_id {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_neighbours(docs).select("doc_id", "text", "bucket", "extra").mapInPandas(compared, schema)
