"""Near duplicates by weighted MinHash over bags of five-word shingles.

The weight of a shingle is how often it occurs. Its weight axis is cut into dyadic blocks (0,1],
(1,2], (2,4], ...; every block runs its own Poisson process, whose rate is the block's width, and each
point carries a hash-chosen component and level. A point counts if its level is within the weight, so
two bags share the smallest point of a component with probability equal to their weighted Jaccard
similarity. A process ends once its points come later than every component's smallest one.

Signatures are banded. In a bucket every bag is compared with one hub, not with all others; links
that were confirmed make groups. Buckets that still mix groups are compared once more with other hubs;
what is mixed after that goes through a prefix filter, which loses no pair: the occurrences of a bag
(a shingle and its i-th repetition) are put in one order for all bags, about the rarest first, and two
bags of similarity t share one of the first |b| - ceil(t |b|) + 1 of each. Bags that share one are
compared inside the task they meet in, in blocks of bounded size, by sketches that bound from below in
how much they differ; only pairs of different groups that can be similar enough leave it, and a pair that
meets often leaves one of its meetings: the occurrence that is least for both under the first of a few
orders in which they agree. A pair is confirmed by the exact weighted Jaccard similarity of the two bags. A pair of similarity 0.8 shares no band with probability
5e-5.

Words are runs without ASCII white space, A-Z lower-cased. A text of one to four words is one
shingle; texts without words are one group. Null text counts as empty. Equal bags form one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerlens.llm.bloom import bloom_filter, may_hold
from ledgerlens.llm.common import WORD, keep_rows, lower_ascii, small_batches, whole
from ledgerlens.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
STAR_ROUNDS = 2
# A table of word hashes is emptied when it is full: it only saves time.
KNOWN_WORDS = 50_000
# Texts a packing task remembers, so that it does not send copies more than once; a full table is emptied.
KNOWN_TEXTS = 100_000
# Slots in which occurrences are counted for their order.
SLOT_BITS = 18
# Bags that meet under one occurrence and task; bits by which they are compared there.
BLOCK = 512
SKETCH_BITS = 2048
# Orders under which two bags look for the occurrence they are paired at.
HOMES = 16
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_word_hashes: dict[str, int] = {}


def bag(text: str, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text (A-Z already lower-cased) and their counts."""
    known = _word_hashes
    if len(known) > KNOWN_WORDS:
        known.clear()
    hashes = []
    for w in WORD.findall(text):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    words = np.array(hashes, dtype=np.uint64)
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    wide = min(width, len(words))
    out = np.full(len(words) - wide + 1, wide, dtype=np.uint64)
    for i in range(wide):
        out = _mix(out * _GOLDEN + words[i : len(words) - wide + 1 + i])
    return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """Smallest points per bag and component; infinite for an empty bag."""
    h = np.full((len(bags), m), np.inf)
    if not any(len(b[0]) for b in bags):
        return h
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    element = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags])
    block, seeds, docs, floors, rates, weights = 0, [], [], [], [], []
    while True:
        floor = 0 if block == 0 else 1 << (block - 1)
        on = weight > floor
        if not on.any():
            break
        seeds.append(_mix(element[on] ^ _mix(np.full(1, block + 1, dtype=np.uint64) * _GOLDEN)))
        docs.append(doc[on])
        weights.append(weight[on])
        floors.append(np.full(on.sum(), floor, dtype=np.int64))
        rates.append(np.full(on.sum(), max(1, floor), dtype=np.int64))
        block += 1
    seed, doc, weight, floor, rate = map(np.concatenate, (seeds, docs, weights, floors, rates))
    at = np.zeros(len(seed))
    step = np.zeros(1, dtype=np.uint64)
    while len(seed):
        step += _GOLDEN
        a = _mix(seed + step)
        b = _mix(a ^ _GOLDEN)
        at = at - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / (m * rate)
        component = ((b >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        level = floor + 1 + ((b & np.uint64(0xFFFFFFFF)).astype(np.int64) % rate)
        counts = level <= weight
        np.minimum.at(h, (doc[counts], component[counts]), at[counts])
        goes_on = at < h.max(axis=1)[doc]
        seed, doc, weight, floor, rate, at = (x[goes_on] for x in (seed, doc, weight, floor, rate, at))
    return h


def band_hashes(h: np.ndarray) -> np.ndarray:
    bits = h.view(np.uint64).reshape(len(h), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN, (len(h), BANDS)).copy()
    for i in range(ROWS):
        out = _mix(out ^ _mix(bits[:, :, i] + _GOLDEN))
    return out.view(np.int64)


def bag_digest(b: tuple[np.ndarray, np.ndarray]) -> str:
    return xxhash.xxh3_128_hexdigest(b[0].tobytes() + b[1].astype("<i8").tobytes())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def _pack(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    return b[0].astype("<u8").tobytes() + b[1].astype("<u4").tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bags = [bag(t) for t in batch["text"]]
        bands = band_hashes(signatures(bags))
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "digest": batch["digest"],
                "bag": [bag_digest(b) for b in bags],
                "bands": list(bands),
            }
        )


def occurrences(b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number for every shingle of the bag and each of its repetitions."""
    first = np.cumsum(b[1]) - b[1]
    nth = (np.arange(int(b[1].sum())) - np.repeat(first, b[1])).astype(np.uint64)
    return _mix(np.repeat(b[0], b[1]) + nth * _GOLDEN)


def prefix_length(size: int, threshold: float) -> int:
    """How many of its first occurrences a bag must be met by."""
    return size - math.ceil(threshold * size - 1e-9) + 1 if size else 0


def pack_members(rows: DataFrame, digests) -> DataFrame:
    """(bag, packed) of the texts whose digest is in the filter, each bag once."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[int] = set()
        for batch in batches:
            held = may_hold(digests.value, batch["digest"].to_numpy(np.int64).view(np.uint64))
            own = batch[held]
            own = own[~own["digest"].isin(known)].drop_duplicates("digest")
            if len(known) > KNOWN_TEXTS:
                known.clear()
            known.update(own["digest"].tolist())
            bags = [bag(t) for t in own["text"]]
            names, packed = [bag_digest(b) for b in bags], [_pack(b) for b in bags]
            yield pd.DataFrame({"bag": pd.Series(names, dtype=object), "packed": pd.Series(packed, dtype=object)})

    return rows.select("digest", "text").mapInPandas(pack, "bag string, packed binary").dropDuplicates(["bag"])


@F.pandas_udf(DoubleType())
def bag_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(_unpack(x), _unpack(y)) for x, y in zip(a, b, strict=True)])


def components(links: DataFrame, node: str = "bag", label: str = "group") -> DataFrame:
    """(node, label) for every node of the links (a, b): the smallest node it is connected with.

    Alternates two star steps until the edges no longer change; every step is a written table.
    """
    pair = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(links.select(pair.alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias(node), F.col("b").alias(label)).unionByName(
                edges.select(F.col("b").alias(node), F.col("b").alias(label)).distinct()
            )
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        out = small.select("a", F.col("low").alias("b")).unionByName(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        edges = materialize(out.distinct(), "edges")


def _mixed(buckets: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(band, bag, group) of the buckets with more than one group."""
    if groups is None:
        return buckets.withColumn("group", F.col("bag"))
    rows = buckets.join(groups, "bag", "left").withColumn("group", F.coalesce("group", "bag"))
    mixed = rows.groupBy("band").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y")
    return rows.join(mixed.select("band"), "band", "left_semi")


def _ordered(a: str = "a", b: str = "b") -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bag and the hub of its bucket, if their groups differ."""
    rank = F.col("bag") if turn == 0 else F.md5(F.concat(F.lit(str(turn)), F.col("bag")))
    hubs = rows.groupBy("band").agg(F.min(F.struct(rank.alias("r"), F.col("bag"), F.col("group"))).alias("h"))
    hubs = hubs.select("band", F.col("h.bag").alias("b"), F.col("h.group").alias("other"))
    pairs = rows.withColumnRenamed("bag", "a").join(hubs, "band").where("`group` <> other")
    return pairs.select(*_ordered()).distinct()


def prefix_pairs(bags: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of ``bags`` (bag, group, packed) of different groups that pass the prefix filter."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [occurrences(_unpack(p)) for p in batch["packed"]]
            if found:
                slots, n = np.unique(np.concatenate(found) >> np.uint64(64 - SLOT_BITS), return_counts=True)
                yield pd.DataFrame({"slot": slots.astype(np.int64), "n": n})

    counted = bags.mapInPandas(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    often[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    order = bags.sparkSession.sparkContext.broadcast(often)

    def first(own: np.ndarray) -> np.ndarray:
        times = order.value[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        return own[np.lexsort((own, times))][: prefix_length(len(own), threshold)]

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            firsts, sizes = [], []
            for packed in batch["packed"]:
                own = occurrences(_unpack(packed))
                firsts.append(first(own))
                sizes.append(len(own))
            lengths = [len(f) for f in firsts]
            columns = {c: pd.Series(np.repeat(batch[c].to_numpy(dtype=object), lengths), dtype=object) for c in ("bag", "group")}
            occurrence = np.concatenate(firsts).view(np.int64)
            yield pd.DataFrame({"occurrence": occurrence, **columns, "size": np.repeat(np.array(sizes, dtype=np.int64), lengths)})

    rows = materialize(bags.mapInPandas(prefix, "occurrence bigint, bag string, group string, size bigint"), "prefixes")
    sizes = rows.groupBy("occurrence").agg(
        F.count(F.lit(1)).alias("n"), F.min("group").alias("x"), F.max("group").alias("y")
    )
    shared = sizes.where("x <> y").select("occurrence", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(shared, "occurrence").withColumn("own", F.pmod(F.xxhash64("bag"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    turn = ["occurrence", "i", "j"]
    placed = placed.select(
        "occurrence", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "bag", "group"
    )

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = [occurrences(_unpack(p)) for p in batch["packed"]]
            sketches = pd.Series([odd_sketch(o).tobytes() for o in own], dtype=object)
            places = pd.Series([homes(first(o)).tobytes() for o in own], dtype=object)
            yield pd.DataFrame(
                {"bag": batch["bag"].to_numpy(dtype=object), "size": [len(o) for o in own], "sketch": sketches, "homes": places}
            )

    short = bags.select("bag", "packed").mapInPandas(shorten, "bag string, size bigint, sketch binary, homes binary")
    short = materialize(short, "odd-sketches")
    placed = placed.join(short, "bag").select(*turn, "own", "bag", "group", "size", "sketch", "homes")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of each occurrence, or of two blocks of it, that may be alike; a run of equal keys is one."""

        def pairs(rows: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
            i, j, own, size = (rows[c].to_numpy(np.int64) for c in ("i", "j", "own", "size"))
            bag, group, sketch = (rows[c].to_numpy(dtype=object) for c in ("bag", "group", "sketch"))
            occurrence = rows["occurrence"].to_numpy(np.int64).view(np.uint64)
            home = np.frombuffer(b"".join(rows["homes"]), dtype=np.uint64).reshape(len(rows), HOMES)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for start, end in zip(edges, edges[1:], strict=False):
                at = np.arange(start, end)
                left, right = (at[own[at] == i[start]], at[own[at] == j[start]]) if i[start] != j[start] else (at, at)
                a, b = may_be_alike(left, right, sketch, size, threshold)
                new = (group[a] != group[b]) & ((a < b) | (i[start] != j[start]))
                a, b = a[new], b[new]
                here = paired_at(home[a], home[b], occurrence[start])
                found.append((bag[a[here]], bag[b[here]]))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], []]
            return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip("ab", columns, strict=True)})

        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            edges = (rows[turn] != rows[turn].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            if len(edges) > 1:
                yield pairs(rows, edges)
            held = rows.iloc[edges[-1] :].reset_index(drop=True) if edges else None
        if held is not None:
            yield pairs(held, [0, len(held)])

    met = placed.repartition(*turn).sortWithinPartitions(*turn).mapInPandas(meet, "a string, b string")
    return met.select(*_ordered()).distinct()


def homes(prefix: np.ndarray) -> np.ndarray:
    """The occurrence of a bag's prefix that comes first under each of ``HOMES`` orders."""
    if not len(prefix):  # meets nobody
        return np.zeros(HOMES, dtype=np.uint64)
    seeds = _mix(np.arange(1, HOMES + 1, dtype=np.uint64) * _GOLDEN)
    return prefix[_mix(prefix[None, :] ^ seeds[:, None]).argmin(axis=1)]


def paired_at(left: np.ndarray, right: np.ndarray, occurrence: np.uint64) -> np.ndarray:
    """Whether the pairs with these homes leave their meeting under ``occurrence``.

    An equal home is in both prefixes, so the pair meets there as well: the first such one is where it is
    paired. Without one, every meeting counts.
    """
    equal = left == right
    at = left[np.arange(len(left)), equal.argmax(axis=1)]
    return ~equal.any(axis=1) | (at == occurrence)


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """Which of ``SKETCH_BITS`` slots hold an odd number of the occurrences, as bytes.

    An occurrence that only one of two bags has changes one bit, so the bits in which two sketches
    differ are never more than the occurrences in which the bags do.
    """
    slots = (own & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=SKETCH_BITS) & 1).astype(np.uint8))


def may_be_alike(
    left: np.ndarray, right: np.ndarray, sketch: np.ndarray, size: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches leave a similarity of ``threshold`` possible."""
    if not len(left) or not len(right):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def bits(rows: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(b"".join(sketch[rows]), dtype=np.uint8).reshape(len(rows), -1)
        return np.unpackbits(raw, axis=1).astype(np.float32)

    x, y = bits(left), bits(right)
    differ = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)
    most = (size[left][:, None] + size[right][None, :]) * ((1 - threshold) / (1 + threshold))
    a, b = np.nonzero(differ <= most + 1e-6)
    return left[a], right[b]


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of the text), bag, class_id, class_size, kept.

    ``class_id`` is the largest id of the group; that row is the one that is kept.
    """
    small_batches(docs.sparkSession)
    norm = lower_ascii(whole())
    rows = docs.select("doc_id", F.xxhash64(norm).alias("digest"), norm.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = materialize(
        rows.mapInPandas(_sketch, f"doc_id {kind}, digest bigint, bag string, bands array<bigint>"), "sketches"
    )
    one = sketch.groupBy("bag").agg(F.min("digest").alias("digest"), F.first("bands").alias("bands"))
    one = materialize(one, "bags")
    places = one.select("bag", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(places.join(shared.select("band"), "band", "left_semi"), "buckets")
    members = one.join(buckets.select("bag").distinct(), "bag", "left_semi")
    # The bags themselves are made once more, only for the texts that share a bucket.
    digests = docs.sparkSession.sparkContext.broadcast(bloom_filter(members, "digest"))
    stored = materialize(pack_members(rows, digests), "packed-bags")
    groups, links = None, None
    for turn in [*range(STAR_ROUNDS), None]:
        mixed = materialize(_mixed(buckets, groups), "mixed-buckets")
        if not mixed.head(1):
            break
        if turn is None:
            found = prefix_pairs(stored.join(mixed.select("bag", "group").distinct(), "bag"), threshold)
        else:
            found = hub_pairs(mixed, turn)
        pairs = materialize(found, "pairs")
        left = stored.select(F.col("bag").alias("a"), F.col("packed").alias("x"))
        right = stored.select(F.col("bag").alias("b"), F.col("packed").alias("y"))
        close = pairs.join(left, "a").join(right, "b").where(bag_similarity("x", "y") >= threshold).select("a", "b")
        found = materialize(close, "links")
        links = found if links is None else links.unionByName(found)
        groups = materialize(components(links), "groups")
    if groups is None:
        placed = sketch.withColumn("group", F.col("bag"))
    else:
        placed = sketch.join(groups, "bag", "left").withColumn("group", F.coalesce("group", "bag"))
    placed = placed.drop("bands")
    classes = placed.groupBy("group").agg(
        F.max(F.struct("doc_id", "digest")).alias("top"), F.count(F.lit(1)).alias("class_size")
    )
    key = F.col("top.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("top.digest") == F.col("digest"))
    nth = F.row_number().over(Window.partitionBy("group", "stays").orderBy(F.lit(0)))
    out = placed.join(classes, "group").withColumn("stays", key).withColumn("class_id", F.col("top.doc_id")).drop("top")
    # Of rows that repeat the id and text that stays, one is kept.
    stays = out.where("stays").withColumn("kept", nth == 1)
    out = stays.unionByName(out.where("NOT stays").withColumn("kept", F.lit(False)))
    return out.select("doc_id", "digest", "bag", "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each group, with all its columns."""
    kept = near_duplicates(docs, threshold).where("kept")
    return keep_rows(docs, kept, F.xxhash64(lower_ascii(whole())), "digest")
