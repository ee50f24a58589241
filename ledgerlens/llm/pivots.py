"""Near duplicates among embeddings by a pivot-permutation index.

A bounded sample (``SAMPLE`` distinct vectors, by a hash) gives ``PIVOTS`` reference points that lie far
apart: each is the sample's vector least like the ones chosen before. A vector is described by its
``NEAREST`` reference points in order of likeness. Inverted lists hold the vectors under every two of
these, so two vectors meet in as many lists as they share pairs of pivots: at least one list for two
shared pivots, the smallest shared-pivot count that is looked at. All vectors are indexed; a pair that
meets is verified by its cosine in double precision. On the test tables every pair of cosine 0.98 or
more shared two pivots (recall 0.999 or more against all pairs; checked by a test).

Equal vectors of a label are one class, indexed once with its size. A list of more than ``BLOCK``
classes is cut into blocks, and every two blocks are a task of their own; inside a task the cosines are
one matrix product, and only totals and one edge per class leave it, so a dense group costs rows in
proportion to its classes times its blocks. A pair that meets in several lists counts in the one of its
two smallest shared pivots. Groups are the connected components of the links.

Vectors that are null, empty, all zero or hold null or non-finite components, and those without a label,
link with nothing. Vectors of different lengths do not link. Rows that repeat a ``vec_id`` are vectors of
their own. A null id is never the smallest one; a group without ids has a null component. Other columns
of the input are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bagminhash import components
from ledgerlens.session import materialize

COSINE = 0.98
SAMPLE = 4096
PIVOTS = 96
NEAREST = 4
BLOCK = 2048


def _usable(vector: Column) -> Column:
    """Finite numbers only, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Rows of ``sample`` (unit vectors) that are least alike; fixed random directions fill what is missing."""
    width = sample.shape[1]
    fill = unit(np.random.default_rng(11).normal(size=(pivots, width)))
    chosen, most = [], np.full(len(sample), -1.0)
    while len(chosen) < min(pivots, len(sample)):
        at = int(np.argmin(most))
        if most[at] > 1 - 1e-9:
            break
        chosen.append(sample[at])
        most = np.maximum(most, sample @ sample[at])
    return np.concatenate([np.array(chosen).reshape(-1, width), fill[: pivots - len(chosen)]])


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of the most alike pivots of every row, the most alike first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :nearest]


def _of_width(pivots: np.ndarray, width: int) -> np.ndarray:
    """Pivots cut or filled with zeros to another length."""
    if width <= pivots.shape[1]:
        return pivots[:, :width]
    return np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))


def link_block(vectors: np.ndarray, near: np.ndarray, size: np.ndarray, side: np.ndarray, pair: int, cosine: float):
    """(linked vectors, smallest row linked or own row) of every row of one list, or of two blocks of it.

    ``near`` holds each row's pivots, sorted; ``side`` is 0 or 1, and with both sides only pairs across
    count. Links count if the two smallest shared pivots are this list's.
    """
    rows = len(vectors)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (np.arange(rows),) * 2
    linked, low = np.zeros(rows, dtype=np.int64), np.arange(rows)
    i, j = np.nonzero(vectors[left] @ vectors[right].T >= cosine)
    i, j = left[i], right[j]
    i, j = i[i != j], j[i != j]
    if not len(i):
        return linked, low
    shared = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
    first = shared.argmax(axis=1)
    shared[np.arange(len(i)), first] = False
    second = shared.argmax(axis=1)
    here = near[i, first] * PIVOTS + near[i, second] == pair
    np.add.at(linked, i[here], size[j[here]])
    if left is not right:
        np.add.at(linked, j[here], size[i[here]])
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return linked, low


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = rows.withColumn("ok", _usable(F.col("v")) & F.col("label").isNotNull())
    digest = F.md5(F.concat_ws("|", F.length("label").cast("string"), "label", F.col("v").cast("string")))
    members = usable.where("ok").select("vec_id", "label", "v", digest.alias("cls"))
    classes = members.groupBy("cls").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("n")
    )
    classes = materialize(classes, "vector-classes")
    drawn = classes.orderBy(F.md5("cls"), "cls").limit(SAMPLE).select("v").toPandas()["v"].tolist()
    width = max(map(len, drawn), default=1)
    sample = unit(np.array([np.pad(np.asarray(v, dtype=np.float64), (0, width - len(v))) for v in drawn])) if drawn else np.zeros((0, width))
    pivots = choose_pivots(sample)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per class and list; the vector in single precision where nothing is lost by that."""
        for batch in batches:
            batch["width"] = batch["v"].map(len)
            for dim, own in batch.groupby("width"):
                x = np.stack(own["v"].to_list()).astype(np.float64)
                near = np.sort(nearest_pivots(unit(x), _of_width(pivots, dim)), axis=1)
                single = x.astype(np.float32)
                if (single.astype(np.float64) == x).all():
                    packed = [r.tobytes() for r in single]
                else:
                    packed = [r.tobytes() for r in x]
                for a in range(NEAREST):
                    for b in range(a + 1, NEAREST):
                        yield pd.DataFrame(
                            {
                                "label": own["label"].to_numpy(),
                                "dim": dim,
                                "pair": near[:, a] * PIVOTS + near[:, b],
                                "cls": own["cls"].to_numpy(),
                                "n": own["n"].to_numpy(),
                                "near": [r.astype("<u2").tobytes() for r in near],
                                "packed": packed,
                            }
                        )

    key = ["label", "dim", "pair"]
    index = classes.select("cls", "label", "v", "n").mapInPandas(
        describe, "label string, dim int, pair int, cls string, n bigint, near binary, packed binary"
    )
    index = materialize(index, "pivot-lists")
    lengths = index.groupBy(*key).agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    blocks = lengths.select(*key, F.ceil(F.col("length") / block).cast("int").alias("blocks"))
    placed = index.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        *key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "n", "near", "packed"
    )
    turn = [*key, "i", "j"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of each list, or of two blocks of it; a run of equal keys is one list."""

        def links(rows: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
            """Totals and edges of the runs that begin at ``edges``; the last of these is the end."""
            dim, pair, i, j, own, n = (rows[c].to_numpy(np.int64) for c in ("dim", "pair", "i", "j", "own", "n"))
            cls, near, packed = (rows[c].to_numpy(dtype=object) for c in ("cls", "near", "packed"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges, edges[1:], strict=False):
                side = (own[a:b] == j[a]).astype(np.int64) if i[a] != j[a] else np.zeros(b - a, dtype=np.int64)
                if b - a < 2 or i[a] != j[a] and side.all() == side.any():
                    continue
                single = 4 * dim[a]
                if all(len(p) == single for p in packed[a:b]):
                    x = np.frombuffer(b"".join(packed[a:b]), "<f4").reshape(b - a, dim[a]).astype(np.float64)
                else:
                    x = np.stack([np.frombuffer(p, "<f4" if len(p) == single else "<f8").astype(np.float64) for p in packed[a:b]])
                places = np.frombuffer(b"".join(near[a:b]), "<u2").reshape(b - a, NEAREST).astype(np.int64)
                linked, low = link_block(unit(x), places, n[a:b], side, int(pair[a]), cosine)
                found = np.flatnonzero((linked > 0) | (low != np.arange(b - a)))
                if len(found):
                    out.append((cls[a:b][found], cls[a:b][low[found]], linked[found]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
            kinds = {"cls": object, "low": object, "links": np.int64}
            return pd.DataFrame({c: pd.Series(x, dtype=k) for (c, k), x in zip(kinds.items(), columns, strict=True)})

        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            edges = (rows[turn] != rows[turn].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            if len(edges) > 1:
                yield links(rows, edges)
            held = rows.iloc[edges[-1] :].reset_index(drop=True) if edges else None
        if held is not None:
            yield links(held, [0, len(held)])

    runs = placed.repartition(*turn).sortWithinPartitions(*turn)
    found = materialize(runs.mapInPandas(verify, "cls string, low string, links bigint"), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("low").alias("b")), "cls", "group")
    placed_classes = classes.select("cls", "low_id", "n").join(groups, "cls", "left").join(counts, "cls", "left")
    placed_classes = placed_classes.withColumn("group", F.coalesce("group", "cls"))
    lowest = placed_classes.groupBy("group").agg(F.min("low_id").alias("component_id"))
    facts = placed_classes.join(lowest, "group").select(
        "cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = members.select("vec_id", "cls").join(facts, "cls").select("vec_id", "n_links", "component_id")
    alone = usable.where("NOT ok").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
