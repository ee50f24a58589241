"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its words, A-Z lower-cased, joined by single spaces and closed by an end sign; every byte is
predicted from up to ``DEPTH`` bytes before it (end signs before the first), which reach over word
borders. A byte and its context are a gram.

A context stays in the tree if it occurs ``MIN_COUNT`` times and if the divergence of its next-symbol
counts from those of its suffix is worth its size: an absolute count, so the tree grows with the
corpus. Nothing holds the tree: grams in the order of their contexts (latest byte first) are cut into
shards, and in that order a context lies around all longer ones, so a shard has every context of its
grams whole, but for those that reach over its two ends. These few are counted beforehand. A shard
therefore counts, fits and scores its grams by itself. Distributions are smoothed along the suffixes in
the tree (Witten-Bell), down to an even one; the longest suffix state scores a symbol.

Texts go in packs of some megabytes. A pack sends every shard the sorted distinct grams of its range,
each as what differs from the one before, and gets their logarithms back in the same order. No gram is
a row of a table. ``fit_levels`` writes the same tree as a table, for whoever wants to read it.

The base is a unigram model over words; only the most frequent words are looked up on the spot. Null
text counts as empty: one token, the end. Without training rows every context is unknown. Rows that
repeat are scored one by one. A null id counts as the empty text in the choice of fold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, remainder, small_batches, whole
from ledgerlens.session import materialize

DEPTH = 8
# Bytes of a context in the first of the two numbers of a gram.
HIGH = 8
MIN_COUNT = 5
# Divergence, in nats weighted by counts, that a context must bring per next symbol it stores.
WORTH = 2.0
HEAD_WORDS = 100_000
HEAD_BYTES = 64
HELD_OUT = (7, 2)
# Bytes of text a shard has on average.
SHARD_GRAMS = 3_000_000
PACK_BYTES = 28 << 20
# Depth of the trees that one process holds: small corpora, with which the shards are compared.
SMALL_DEPTH = 5
_CHUNK = 1_000_000
_FLUSH_UNITS = 300_000
# Positions that are looked at together, and texts of which all give borders of shards.
_GROUP = 1 << 22
_SAMPLED = 32 << 20
# Words are counted and looked up over so many bytes or texts at once.
_WORD_BYTES = 32 << 20
_WORD_ROWS = 4096
_LOG_BITS = 12  # of 52, that a logarithm sent back does without
END = 10  # no byte of a word


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def gram_codes(texts: list[list[str]], depth: int = SMALL_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts after the ``depth`` bytes before it, as one number, and where texts start.

    The context stands in the high bytes, the latest byte first, so that numbers in order have the
    contexts of every length in order.
    """
    pad = bytes([END]) * depth
    bodies = [" ".join(t).encode("utf-8", "surrogatepass") + bytes([END]) for t in texts]
    raw = np.frombuffer(b"".join([pad + b for b in bodies]), dtype=np.uint8)
    lengths = np.array([len(b) for b in bodies], dtype=np.int64)
    code = np.zeros(max(0, len(raw) - depth), dtype=np.int64)
    for j in range(depth):
        code = (code << 8) | raw[depth - 1 - j : len(raw) - 1 - j]
    code = (code << 8) | raw[depth:]
    # The first `depth` places after a text belong to the next one's padding.
    starts = np.cumsum(np.concatenate([[0], lengths + depth]))[:-1]
    keep = np.ones(len(code), dtype=bool)
    for j in range(depth):
        at = starts[1:] - depth + j
        keep[at] = False
    return code[keep], np.cumsum(np.concatenate([[0], lengths]))[:-1]


def _chunks(texts: list[str]) -> Iterator[list[list[str]]]:
    held, size = [], 0
    for t in texts:
        held.append(words_of(t))
        size += len(t)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def corpus_counts(training: DataFrame) -> DataFrame:
    """(gram, n) over all training texts, for a small tree."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in _chunks(batch["text"].tolist()):
                codes, n = np.unique(gram_codes(chunk)[0], return_counts=True)
                yield pd.DataFrame({"gram": codes, "n": n})

    return training.mapInPandas(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


class SuffixTree:
    """A small tree as sorted arrays per level: contexts with their totals and fan-out, symbol counts."""

    def __init__(self, rows: pd.DataFrame, depth: int = SMALL_DEPTH):
        self.depth, self.levels = depth, []
        for k in range(depth + 1):
            own = rows[rows["k"] == k].sort_values("gram")
            grams, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
            contexts, first = np.unique(grams >> 8, return_index=True)
            totals = own["total"].to_numpy(np.float64)[first]
            fan = np.diff(np.append(first, len(grams))).astype(np.float64)
            self.levels.append((contexts, totals, fan, grams, n))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of every gram."""
        p = np.full(len(codes), 1 / 256)
        for k, (contexts, totals, fan, grams, n) in enumerate(self.levels):
            if not len(contexts):
                continue
            context = codes >> 8 * (self.depth - k + 1)
            gram = (context << 8) | (codes & 255)
            at, known = _find(contexts, context)
            where, seen = _find(grams, gram)
            c = np.where(seen, n[where], 0.0)
            p = np.where(known, (c + fan[at] * p) / (totals[at] + fan[at]), p)
        return np.log10(p)


def fit_tree(
    counts: DataFrame, min_share: float = 0.0, worth: float = WORTH, depth: int = SMALL_DEPTH, min_count: int = MIN_COUNT
) -> SuffixTree:
    """A small tree, in this process: contexts that pass the count and the divergence test."""
    grams = counts.select("gram", "n")
    symbols = grams.agg(F.sum("n")).first()[0] or 0
    symbol = F.col("gram").bitwiseAND(F.lit(255))
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("k"), (F.shiftright("gram", 8 * (depth - k + 1)) * 256 + symbol).alias("gram"))
            for k in range(depth + 1)
        ]
    )
    every = grams.select("n", F.explode(levels).alias("level")).groupBy("level.k", "level.gram").agg(F.sum("n").alias("n"))
    every = every.withColumn("context", F.shiftright("gram", 8))
    totals = every.groupBy("k", "context").agg(F.sum("n").alias("total"))
    frequent = totals.where((F.col("k") == 0) | (F.col("total") >= max(min_count, symbols * min_share)))
    states = materialize(every.join(frequent, ["k", "context"]), "states")
    # The suffix of a context drops its earliest byte, the lowest one.
    child = states.where("k > 0").select(
        "k", "context", "n", "total", (F.shiftright("gram", 16) * 256 + symbol).alias("suffix_gram"), (F.col("k") - 1).alias("below")
    )
    parent = states.select(
        F.col("k").alias("below"), F.col("gram").alias("suffix_gram"), F.col("n").alias("pn"), F.col("total").alias("ptotal")
    )
    gain = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pn") / F.col("ptotal")))
    kept = (
        child.join(parent, ["below", "suffix_gram"])
        .groupBy("k", "context")
        .agg(F.sum(gain).alias("divergence"), F.count(F.lit(1)).alias("fan"))
        .where(F.col("divergence") >= F.col("fan") * worth)
        .select("k", "context")
    )
    tree = states.where("k = 0").unionByName(states.where("k > 0").join(kept, ["k", "context"], "left_semi"))
    return SuffixTree(tree.select("k", "gram", "n", "total").toPandas(), depth)


def units_of(words: list[str], depth: int = DEPTH) -> list[bytes]:
    """The text's words, each with the ``depth`` bytes before it and the sign after it."""
    body = " ".join(words).encode("utf-8", "surrogatepass")
    raw = bytes([END]) * depth + body + bytes([END])
    out, at = [], 0
    for piece in body.split(b" "):
        end = at + len(piece) + 1
        out.append(raw[at : end + depth])
        at = end
    return out


def unit_grams(units: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, hi, lo) per byte of the units after their context.

    ``hi`` holds the latest ``HIGH`` bytes of the context, the latest first, ``lo`` the ones before and
    the symbol last; pairs in order have the contexts of every length in order.
    """
    high = min(depth, HIGH)
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    raw = np.frombuffer(b"".join(units), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(units)), lengths - depth)
    first = np.cumsum(lengths) - lengths + depth
    before = np.cumsum(lengths - depth) - (lengths - depth)
    at = np.arange(len(owner)) + np.repeat(first - before, lengths - depth)
    hi, lo = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for j in range(depth):
        if j < high:
            hi = (hi << 8) | raw[at - 1 - j]
        else:
            lo = (lo << 8) | raw[at - 1 - j]
    return owner, hi, (lo << 8) | raw[at]


def _at_level(hi: np.ndarray, lo: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of the last ``k`` bytes of full contexts."""
    high = min(depth, HIGH)
    if k > high:
        return hi, lo >> 8 * (depth - k + 1)
    return (hi >> 8 * (high - k) if k else np.zeros_like(hi)), np.zeros_like(lo)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def count_units(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(uid, unit, n) of all texts; n counts the training texts only; written."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"unit": list(tokens), "n": list(tokens.values())})
            tokens.clear()
            return frame

        for batch in batches:
            for text, held in zip(batch["text"].tolist(), batch["held_out"].tolist(), strict=True):
                units = units_of(words_of(text), depth)
                if held:
                    for u in units:
                        tokens.setdefault(u, 0)
                else:
                    tokens.update(units)
                if len(tokens) > _FLUSH_UNITS:
                    yield out()
        if tokens:
            yield out()

    found = rows.select("text", "held_out").mapInPandas(count, "unit binary, n bigint")
    units = found.groupBy("unit").agg(F.sum("n").alias("n"))
    return materialize(units.select(F.monotonically_increasing_id().alias("uid"), "unit", "n"), "units")


def _slices(units: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, u in enumerate(units):
        size += len(u)
        if size >= _CHUNK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(units):
        yield slice(start, len(units))


def count_grams(units: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(hi, lo, n) of all distinct grams; written."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_units, n = batch["unit"].tolist(), batch["n"].to_numpy(np.int64)
            for part in _slices(all_units):
                owner, hi, lo = unit_grams(all_units[part], depth)
                order = np.lexsort((lo, hi))
                hi, lo = hi[order], lo[order]
                starts = np.flatnonzero(_runs(hi, lo))
                yield pd.DataFrame({"hi": hi[starts], "lo": lo[starts], "n": np.add.reduceat(n[part][owner[order]], starts)})

    found = units.select("unit", "n").mapInPandas(count, "hi bigint, lo bigint, n bigint")
    return materialize(found.groupBy("hi", "lo").agg(F.sum("n").alias("n")), "grams")


def in_shards(grams: DataFrame, bounds: list[int]) -> DataFrame:
    @F.pandas_udf("int")
    def shard(hi: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), hi.to_numpy(np.int64), side="right"))

    return grams.withColumn("shard", shard("hi") if bounds else F.lit(0))


LEVEL = "k int, hi bigint, lo bigint, symbol int, n bigint"


def fit_levels(sharded: DataFrame, min_count: int = MIN_COUNT, worth: float = WORTH, depth: int = DEPTH) -> DataFrame:
    """(k, hi, lo, symbol, n, total): the contexts that pass the count and the divergence test; written."""

    def levels(own: pd.DataFrame) -> pd.DataFrame:
        """Counts at all levels; contexts at either end of the shard may go on in the next one."""
        own = own.sort_values(["hi", "lo"])
        hi, lo, n = (own[c].to_numpy(np.int64) for c in ("hi", "lo", "n"))
        symbol, out = lo & 255, []
        for k in range(depth + 1):
            high, low = _at_level(hi, lo, k, depth)
            new = _runs(high, low)
            run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            kept = np.add.reduceat(n, starts) >= min_count
            kept[[0, -1]] = True
            here = np.flatnonzero(kept[run])
            keys, where = np.unique((run[here] << 8) | symbol[here], return_inverse=True)
            at = starts[keys >> 8]
            sums = np.bincount(where, weights=n[here]).astype(np.int64)
            out.append(pd.DataFrame({"k": k, "hi": high[at], "lo": low[at], "symbol": keys & 255, "n": sums}))
        return pd.concat(out, ignore_index=True)

    found = sharded.where("n > 0").groupBy("shard").applyInPandas(levels, LEVEL)
    context = ["k", "hi", "lo"]
    every = found.repartition(*context).groupBy(*context, "symbol").agg(F.sum("n").alias("n"))
    every = every.withColumn("total", F.sum("n").over(Window.partitionBy(*context)))
    states = materialize(every.where((F.col("k") == 0) | (F.col("total") >= min_count)), "states")
    # The suffix of a context drops its earliest byte, the lowest one.
    high = min(depth, HIGH)
    child = states.where("k > 0").select(
        *context, "n", "total", "symbol", (F.col("k") - 1).alias("below"),
        F.when(F.col("k") == 1, 0).when(F.col("k") <= high, F.shiftright("hi", 8)).otherwise(F.col("hi")).alias("shi"),
        F.when(F.col("k") <= high, 0).otherwise(F.shiftright("lo", 8)).cast("bigint").alias("slo"),
    )
    parent = states.select(
        F.col("k").alias("below"), F.col("hi").alias("shi"), F.col("lo").alias("slo"), "symbol",
        F.col("n").alias("pn"), F.col("total").alias("ptotal"),
    )
    gain = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("pn") / F.col("ptotal")))
    kept = (
        child.join(parent, ["below", "shi", "slo", "symbol"])
        .groupBy(*context)
        .agg(F.sum(gain).alias("divergence"), F.count(F.lit(1)).alias("fan"))
        .where(F.col("divergence") >= F.col("fan") * worth)
        .select(*context)
    )
    tree = states.where("k = 0").unionByName(states.where("k > 0").join(kept, context, "left_semi"))
    return materialize(tree, "tree")


PACK = "pack bigint, uid array<bigint>, size array<bigint>, n array<bigint>, body binary"
GRAMS = "shard int, pack bigint, lead int, size bigint, planes array<binary>"
TRUNK = "k int, context bigint, symbol int, n bigint"
LOGS = "pack bigint, lead int, shard int, size bigint, logs array<binary>"


def pack_units(units: DataFrame) -> DataFrame:
    """Some megabytes of (uid, unit, n) a row, by n. ``units`` is a written table, so every reading packs alike."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for batch in batches:
            lengths = batch["unit"].map(len).to_numpy(np.int64)
            if held and size + lengths.sum() > PACK_BYTES:
                yield _packed(number, held)
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += lengths.sum()
        if held:
            yield _packed(number, held)

    return units.select("uid", "unit", "n").mapInPandas(pack, PACK)


def _packed(number: int, held: list[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(held, ignore_index=True).sort_values("n", kind="stable")
    body = pa.compress(b"".join(rows["unit"].tolist()), codec="zstd", asbytes=True)
    sizes = rows["unit"].map(len).to_numpy(np.int64)
    row = {"pack": number, "uid": rows["uid"].to_numpy(np.int64), "size": sizes, "n": rows["n"].to_numpy(np.int64), "body": body}
    return pd.DataFrame([row])


class Pack:
    """The bytes of a pack, and where those are that a context stands before."""

    def __init__(self, size: np.ndarray, body: bytes, depth: int):
        self.size, self.depth = np.asarray(size, dtype=np.int64), depth
        padded = bytes(8) + pa.decompress(body, int(self.size.sum()), codec="zstd", asbytes=True)
        self.raw = np.frombuffer(padded, dtype=np.uint8)[8:]
        # The eight bytes before every place as one number, the latest first.
        self.before = np.ndarray(len(self.raw), dtype="<u8", buffer=padded, strides=(1,))
        self.ends = np.cumsum(self.size)
        self.scored = np.ones(len(self.raw), dtype=bool)
        for j in range(depth):
            self.scored[self.ends - self.size + j] = False

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The units of places in order."""
        return np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(at, self.ends), prepend=0))

    def leads(self) -> Iterator[tuple[int, np.ndarray]]:
        """Places by the byte before them, in its order."""
        before = np.zeros_like(self.raw)
        before[1:] = self.raw[:-1]
        sums = np.cumsum(np.bincount(before, minlength=256))
        low = 0
        while low < 256:
            done = sums[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sums, done + _GROUP, side="right")))
            at = np.flatnonzero(self.scored & (before >= low) & (before < high))
            lead = before[at]
            at = at[np.argsort(lead, kind="stable")]
            cuts = np.cumsum(np.bincount(lead, minlength=256))
            for b in range(low, min(high, 256)):
                if own := int(cuts[b] - (cuts[b - 1] if b else 0)):
                    yield b, at[cuts[b] - own : cuts[b]]
            low = high

    def keys(self, at: np.ndarray) -> np.ndarray:
        """The context without its latest byte, which is known, and the symbol: one number."""
        context = self.before[at] >> np.uint64(8 * (8 - self.depth))
        return ((context & np.uint64(256 ** (self.depth - 1) - 1)) << np.uint64(8)) | self.raw[at]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts = np.flatnonzero(_runs(keys))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def count_keys(keys: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and what ``n`` adds up to for each; ``n`` holds up to the next of ``cuts``."""
    ends = np.append(cuts[1:], len(keys))
    if len(n) > 2:
        found, where = np.unique(keys, return_inverse=True)
        return found, np.bincount(where, weights=np.repeat(n, ends - cuts)).astype(np.int64)
    found, times = _distinct(keys)
    if len(n) == 1:
        return found, times * n[0]
    counts = np.zeros(len(found), dtype=np.int64)
    for times_n, low, high in zip(n.tolist(), cuts, ends, strict=True):
        if times_n and high > low:
            counted, times = _distinct(keys[low:high])
            counts[np.searchsorted(found, counted)] += times * times_n
    return found, counts


def _squeeze(column: np.ndarray) -> bytes:
    return pa.compress(column.tobytes(), codec="zstd", asbytes=True)


def _expand(raw: bytes, n: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), dtype=kind)


def encode_keys(keys: np.ndarray, n: np.ndarray, depth: int) -> list[bytes]:
    """Sorted keys: how many bytes are those of the key before, the others place by place, and the counts."""
    differs = np.zeros(len(keys), dtype=bool)
    differs[0] = True
    same, planes = np.zeros(len(keys), dtype=np.uint8), []
    for j in range(depth):
        plane = (keys >> np.uint64(8 * (depth - 1 - j))).astype(np.uint8)
        differs[1:] |= plane[1:] != plane[:-1]
        same += ~differs
        planes.append(_squeeze(plane[differs]))
    return [_squeeze(same), *planes, _squeeze(np.minimum(n, 255).astype(np.uint8)), _squeeze(n[n >= 255].astype(np.int64))]


def decode_keys(planes: list[bytes], size: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    same = _expand(planes[0], size)
    keys = np.zeros(size, dtype=np.uint64)
    for j in range(depth):
        differs = same <= j
        times = np.cumsum(differs)
        keys = (keys << np.uint64(8)) | _expand(planes[1 + j], int(times[-1]))[times - 1]
    n = _expand(planes[1 + depth], size).astype(np.int64)
    large = np.flatnonzero(n == 255)
    n[large] = _expand(planes[2 + depth], len(large), np.int64)
    return keys, n


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of numbers, first all lowest ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def encode_logs(logs: np.ndarray) -> list[bytes]:
    """Each value once, where new ones stand, and how far the others go back. Kept to a relative 5e-13."""
    rounded = ((logs.view(np.uint64) + np.uint64(1 << _LOG_BITS - 1)) >> np.uint64(_LOG_BITS)) << np.uint64(_LOG_BITS)
    codes, values = pd.factorize(rounded)
    latest = np.maximum.accumulate(codes)
    new = np.append(True, latest[1:] > latest[:-1])
    back = (latest - codes)[~new].astype(np.uint32)
    return [_squeeze(np.packbits(new)), _squeeze(_planes(values)), _squeeze(_planes(back))]


def decode_logs(columns: list[bytes], size: int) -> np.ndarray:
    new = np.unpackbits(_expand(columns[0], -(-size // 8)), count=size).astype(bool)
    codes = np.cumsum(new) - 1
    n = int(codes[-1]) + 1
    back = np.ascontiguousarray(_expand(columns[2], 4 * (size - n)).reshape(4, -1).T).view(np.uint32).ravel()
    codes[~new] -= back
    return np.ascontiguousarray(_expand(columns[1], 8 * n).reshape(8, -1).T).view(np.float64).ravel()[codes]


def _context(lead: int, keys: np.ndarray, depth: int) -> np.ndarray:
    """The whole contexts of keys, the latest byte first."""
    return (keys >> np.uint64(8)) | np.uint64(lead << 8 * (depth - 1))


def _prefix(contexts: np.ndarray, k: int, depth: int) -> np.ndarray:
    """The last ``k`` bytes of whole contexts."""
    return contexts >> np.uint64(8 * (depth - k)) if k else np.zeros_like(contexts)


def shard_bounds(units: DataFrame, shard_grams: int = SHARD_GRAMS, depth: int = DEPTH) -> list[int]:
    """Fixed contexts at which shards begin, drawn evenly from the distinct grams of texts."""
    total = units.agg(F.sum(F.octet_length("unit"))).first()[0] or 0
    shards = -(-total // shard_grams)
    if shards < 2:
        return []
    every = 1 if total < _SAMPLED else 8
    draws = 50 * shards * every / total

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, size, body in zip(batch["pack"], batch["size"], batch["body"], strict=True):
                pack = Pack(size, body, depth)
                found = np.concatenate([_context(b, _distinct(pack.keys(at))[0], depth) for b, at in pack.leads()])
                rng = np.random.default_rng(number)
                yield pd.DataFrame({"context": rng.choice(found, int(np.ceil(draws * len(pack.raw)))).view(np.int64)})

    sample = units.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0)
    drawn = pack_units(sample).mapInPandas(draw, "context bigint").toPandas()["context"].to_numpy(np.int64).view(np.uint64)
    drawn.sort()
    return short_bounds(sorted({int(drawn[i * len(drawn) // shards]) for i in range(1, shards)}) if len(drawn) else [], depth)


def short_bounds(bounds: list[int], depth: int = DEPTH) -> list[int]:
    """Bounds moved, by half a shard at most, to where the shortest context begins: few contexts then reach over."""
    out = set()
    for i, bound in enumerate(bounds):
        low = (bounds[i - 1] + bound) // 2 if i else 0
        high = (bound + bounds[i + 1]) // 2 if i + 1 < len(bounds) else bound
        starts = (high >> 8 * (depth - k) << 8 * (depth - k) for k in range(1, depth + 1))
        out.add(next(c for c in starts if c > low or c == high))
    return sorted(out)


def count_trunk(packs: DataFrame, bounds: list[int], depth: int = DEPTH) -> DataFrame:
    """(shard, k, context, symbol, n): counts of the contexts that may reach over an end of the shard."""

    def trunk_levels() -> list[np.ndarray]:
        edges = np.array(bounds, dtype=np.uint64)
        return [_prefix(edges, k, depth) for k in range(depth)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array(bounds, dtype=np.uint64)
        # A context that begins at a bound lies on one side of it.
        levels = [np.unique(level[level << np.uint64(8 * (depth - k)) != edges] if k else level) for k, level in enumerate(trunk_levels())]
        for batch in batches if bounds else ():
            for size, n, body in zip(batch["size"], batch["n"], batch["body"], strict=True):
                pack = Pack(size, body, depth)
                values, first = np.unique(n, return_index=True)
                starts = (pack.ends - pack.size)[first].tolist()
                for times, low, high in zip(values.tolist(), starts, [*starts[1:], len(pack.raw)], strict=True):
                    for start in range(max(low, min(depth, 2)), high if times else 0, _GROUP):
                        yield from slice_counts(pack, start, min(high, start + _GROUP), times, levels)

    def slice_counts(pack: Pack, low: int, high: int, times: int, levels: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        def rows(k: int, contexts: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
            some = np.flatnonzero(sums)
            context = contexts[some >> 8].view(np.int64)
            return pd.DataFrame({"k": k, "context": context, "symbol": some & 255, "n": sums[some] * times})

        # The first levels from pairs and triples of bytes, the deeper ones where the level above has the context.
        latest, scored = pack.raw[low - 1 : high - 1].astype(np.uint16) << 8, pack.scored[low:high]
        pairs = np.bincount((latest | pack.raw[low:high])[scored], minlength=1 << 16).reshape(256, 256)
        yield rows(0, levels[0], pairs.sum(axis=0))
        if depth > 1:
            yield rows(1, levels[1], pairs[levels[1].astype(np.int64)].ravel())
        at = np.empty(0, dtype=np.int64)
        if depth > 2:
            reached = np.zeros(1 << 16, dtype=bool)
            reached[levels[2].astype(np.int64)] = True
            at = low + np.flatnonzero(scored & reached[latest | pack.raw[low - 2 : high - 2]])
        for k in range(2, depth):
            place, known = _find(levels[k], _prefix(pack.before[at], k, 8))
            at, place = (at, place) if known.all() else (at[known], place[known])
            if not len(at):
                return
            yield rows(k, levels[k], np.bincount((place << 8) | pack.raw[at]))

    def to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = trunk_levels()
        for rows in batches:
            for k, own in rows.groupby("k"):
                context = own["context"].to_numpy(np.int64).view(np.uint64)
                first = np.searchsorted(levels[k], context)
                times = np.searchsorted(levels[k], context, side="right") - first + 1
                out = own.loc[own.index.repeat(times)].reset_index(drop=True)
                out["shard"] = np.arange(len(out)) - np.repeat(np.cumsum(times) - times - first, times)
                yield out

    found = packs.mapInPandas(count, TRUNK).groupBy("k", "context", "symbol").agg(F.sum("n").alias("n"))
    return found.mapInPandas(to_shards, f"{TRUNK}, shard int")


def score_shard(
    context: np.ndarray, symbol: np.ndarray, n: np.ndarray, trunk: pd.DataFrame, min_count: int, worth: float, depth: int
) -> np.ndarray:
    """log10 probability of the symbol of every gram, given in order; the tree is fitted level by level."""
    levels, size = [], len(context)
    for k in range(depth, -1, -1):
        if k < depth:
            context = context >> np.uint64(8) if k else np.zeros_like(context)
            new = _runs(context)
            run, contexts = np.cumsum(new) - 1, context[new]
            # A context that reaches over an end has its whole counts, and the symbols it only has elsewhere.
            whole_n = trunk[trunk["k"] == k]
            place, here = _find(contexts, whole_n["context"].to_numpy(np.int64).view(np.uint64))
            whole_n, place = whole_n[here], place[here]
            keys = np.concatenate([(run << 8) | symbol, (place << 8) | whole_n["symbol"].to_numpy(np.int64)])
            order = np.argsort(keys, kind="stable")
            new = _runs(keys[order])
            up = np.empty(len(keys), dtype=np.int64)
            up[order] = np.cumsum(new) - 1
            rows = keys[order[new]]
            n = np.bincount(up[: len(n)], weights=n, minlength=len(rows)).astype(np.int64)
            n[np.isin(rows >> 8, place)] = 0
            n[up[len(run) :]] = whole_n["n"].to_numpy(np.int64)
            context, symbol = contexts[rows >> 8], rows & 255
            levels[-1]["up"] = up[: len(run)]
        starts = np.flatnonzero(_runs(context))
        fan = np.add.reduceat((n > 0).astype(np.int64), starts)
        times = np.diff(np.append(starts, len(context)))
        levels.append({"n": n, "starts": starts, "times": times, "total": np.add.reduceat(n, starts), "fan": fan})
    p = np.empty(0)
    for k in range(depth + 1):
        own = levels[depth - k]
        n, total, fan = own["n"].astype(np.float64), np.repeat(own["total"], own["times"]), np.repeat(own["fan"], own["times"])
        if k:
            below, up = levels[depth - k + 1], own["up"]
            p = p[up]
            share = below["n"][up] / np.maximum(np.repeat(below["total"], below["times"])[up], 1)
            some = np.flatnonzero(n)
            gain = np.zeros(len(n))
            gain[some] = n[some] * np.log(n[some] / total[some] / share[some])
            kept = (own["total"] >= min_count) & (np.add.reduceat(gain, own["starts"]) >= own["fan"] * worth)
        else:
            p, kept = np.full(len(n), 1 / 256), own["total"] > 0
        p = np.where(np.repeat(kept, own["times"]), (n + fan * p) / np.maximum(total + fan, 1), p)
    return np.log10(p[:size])


def score_units(
    units: DataFrame, min_count: int = MIN_COUNT, worth: float = WORTH, depth: int = DEPTH, shard_grams: int = SHARD_GRAMS
) -> DataFrame:
    """(uid, log): log10 probability of the bytes of every unit, by the tree of the counts ``n``.

    ``units`` (uid, unit, n) is a written table; a unit is any bytes with the ``depth`` bytes before them.
    """
    bounds = shard_bounds(units, shard_grams, depth)
    packs = pack_units(units)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The distinct grams of a pack, those of a shard in a row for each byte before the symbol."""
        edges = np.array(bounds, dtype=np.uint64)
        for batch in batches:
            for number, size, n, body in zip(batch["pack"], batch["size"], batch["n"], batch["body"], strict=True):
                pack = Pack(size, body, depth)
                values, first = np.unique(n, return_index=True)
                starts = (pack.ends - pack.size)[first]
                for lead, at in pack.leads():
                    keys, counts = count_keys(pack.keys(at), values, np.searchsorted(at, starts))
                    cuts = np.searchsorted(_context(lead, keys, depth), edges)
                    first = np.append(0, cuts)
                    last = np.append(cuts, len(keys))
                    shards = np.flatnonzero(last > first)
                    parts = [slice(first[i], last[i]) for i in shards]
                    planes = [encode_keys(keys[part], counts[part], depth) for part in parts]
                    sizes = (last - first)[shards]
                    yield pd.DataFrame({"shard": shards, "pack": number, "lead": lead, "size": sizes, "planes": planes})

    def score(grams: pd.DataFrame, trunk: pd.DataFrame) -> pd.DataFrame:
        """The logarithms of the grams of a shard, row by row as they came."""
        contexts, symbols, counts, places, base = [], [], [], {}, 0
        for lead, rows in grams.groupby("lead", sort=True):
            sent = [decode_keys(p, n, depth) for p, n in zip(rows["planes"], rows["size"], strict=True)]
            keys = np.concatenate([k for k, _ in sent])
            order = np.argsort(keys, kind="stable")
            new = _runs(keys[order])
            where = np.empty(len(keys), dtype=np.int64)
            where[order] = np.cumsum(new) - 1
            keys = keys[order[new]]
            contexts.append(_context(int(lead), keys, depth))
            symbols.append((keys & np.uint64(255)).astype(np.int64))
            counts.append(np.bincount(where, weights=np.concatenate([n for _, n in sent])).astype(np.int64))
            for i, part in zip(rows.index, np.split(where + base, np.cumsum(rows["size"])[:-1]), strict=True):
                places[i] = part
            base += len(keys)
        if not base:
            return pd.DataFrame(columns=["pack", "lead", "shard", "size", "logs"], dtype=object)
        logs = score_shard(*map(np.concatenate, (contexts, symbols, counts)), trunk, min_count, worth, depth)
        out = grams[["pack", "lead", "shard", "size"]].copy()
        out["logs"] = [encode_logs(logs[places[i]]) for i in grams.index]
        return out

    def add_up(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The logarithms of every place of a pack, added up by unit."""
        size, body, uid = rows["size"].iloc[0], rows["body"].iloc[0], rows["uid"].iloc[0]
        pack = Pack(size, body, depth)
        sums = np.zeros(len(pack.size))
        by_lead = dict(list(found.sort_values("shard").groupby("lead")))
        for lead, at in pack.leads():
            own = by_lead[lead]
            logs = np.concatenate([decode_logs(z, n) for z, n in zip(own["logs"], own["size"], strict=True)])
            keys = pack.keys(at)
            order = np.argsort(keys)
            each = np.empty(len(at))
            each[order] = logs[np.cumsum(_runs(keys[order])) - 1]
            sums += np.bincount(pack.owners(at), weights=each, minlength=len(sums))
        return pd.DataFrame({"uid": uid, "log": sums})

    sent = packs.mapInPandas(send, GRAMS).groupBy("shard")
    logs = sent.cogroup(count_trunk(packs, bounds, depth).groupBy("shard")).applyInPandas(score, LOGS)
    out = packs.groupBy("pack").cogroup(logs.groupBy("pack")).applyInPandas(add_up, "uid bigint, log double")
    return materialize(out, "unit-logs")


def _words(units: list[bytes]) -> pa.Array:
    return pa.array(b"".join(units).split(), pa.binary())


def score_texts(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [t.lower().split() for t in batch.pop("text")]
            batch["n_tokens"] = [len(w) + 1 for w in words]
            batch["unit"] = [bytes([END]) * DEPTH + b" ".join(w) + bytes([END]) for w in words]
            yield batch

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Bytes are lower-cased and split at ASCII signs only.
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (remainder("doc_id", HELD_OUT[0]) != HELD_OUT[1]).cast("bigint").alias("n"),
        whole().cast("binary").alias("text"),
    )
    rows = rows.mapInPandas(spell, f"uid bigint, doc_id {kind}, n bigint, n_tokens bigint, unit binary")
    rows = materialize(rows, "texts", compression="zstd")
    unit_logs = score_units(rows.select("uid", "unit", "n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            found = pc.value_counts(_words(held))
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

        for batch in batches:
            held += batch.column("unit").to_pylist()
            if sum(map(len, held)) > _WORD_BYTES:
                yield out()
                held.clear()
        if held:
            yield out()

    training = rows.where("n > 0")
    # An end sign splits as a space does.
    words = training.select("unit").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    in_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = training.count()
    total, mass = in_words + ends, in_words + ends + distinct + int(ends > 0) + 1
    log_end, log_new = math.log10((ends + 1) / mass), math.log10(1 / mass)
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    head = {bytes(r["word"]): int(r["n"]) for r in short.orderBy(F.desc("n"), "word").limit(head_words).collect()}

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per text, and a row per text and word that is not among the frequent ones."""
        known_words = pa.array(list(head), pa.binary())
        known_logs = np.array([math.log10((n + 1) / mass) for n in head.values()] + [0.0])
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(len(h) for h in held) >= _WORD_ROWS:
                yield looked_up(pd.concat(held, ignore_index=True), known_words, known_logs)
                held = []
        if held:
            yield looked_up(pd.concat(held, ignore_index=True), known_words, known_logs)

    def looked_up(rows: pd.DataFrame, known_words: pa.Array, known_logs: np.ndarray) -> pd.DataFrame:
        coded = _words(rows["unit"].tolist()).dictionary_encode()
        owner = np.repeat(np.arange(len(rows)), rows["n_tokens"] - 1)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known_words), -1).to_numpy(zero_copy_only=False)[code]
        known, uid = place >= 0, rows["uid"].to_numpy(np.int64)
        logs = np.bincount(owner, weights=known_logs[place], minlength=len(uid))
        frame = pd.DataFrame({"uid": uid, "known": int(ends > 0) + np.bincount(owner[known], minlength=len(uid)), "base": log_end + logs})
        pairs, times = np.unique((owner[~known] << 32) | code[~known], return_counts=True)
        rare = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).to_pylist()
        out = pd.concat([frame, pd.DataFrame({"uid": uid[pairs >> 32], "times": times})], ignore_index=True)
        out["word"] = pd.Series([None] * len(frame) + rare, dtype=object)
        return out[["uid", "known", "base", "word", "times"]].astype({"uid": "int64", "known": "Int64", "times": "Int64"})

    passed = rows.select("uid", "n_tokens", "unit").mapInPandas(look_up, "uid bigint, known bigint, base double, word binary, times bigint")
    passed = materialize(passed, "base-scores")
    tail = passed.where("word IS NOT NULL").select("uid", "word", "times").join(words, "word", "left")
    rare = tail.groupBy("uid").agg(
        F.sum(F.col("times") * F.coalesce(F.log10((F.col("n") + 1) / F.lit(float(mass))), F.lit(log_new))).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    main = rows.select("uid", "doc_id", (F.col("n") == 0).alias("held_out"), "n_tokens")
    main = main.join(passed.where("word IS NULL").select("uid", "known", "base"), "uid").join(rare, "uid", "left")
    return main.join(unit_logs, "uid").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        F.col("log").alias("score"),
    )
