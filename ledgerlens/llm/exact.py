"""Exact duplicates through an extendible-hash index kept in shared files.

An index entry is one distinct normalised text: its 64-bit hash, its place in the chain of texts
with that hash, the id that stays and the number of rows. The directory is indexed by the leading
bits of the hash; it doubles until no bucket holds more than ``capacity`` entries, and a bucket only
takes as many bits as it needs. Entries are written to the shared folder ordered by bucket, so each
owner task writes one range of keys.

Null text counts as empty. Rows without an id never stay while a row with an id has the same text.
Of rows that repeat both id and text one stays. Extra columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep_rows, lower_ascii, whole
from ledgerlens.session import materialize

CAPACITY = 4096
# A group is looked up by broadcast if it has more than this share of all rows: at most 10,000 are.
HOT_SHARE = 1e-4


def _leading(h: Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("bigint")


def build_directory(hashes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for every used slot of the directory, and the number of bits of a slot.

    ``hashes`` has one row per distinct hash ``h``.
    """
    keys = hashes.count()
    bits = 0 if keys <= capacity else min(40, math.ceil(math.log2(keys / capacity)) + 4)
    slots = hashes.groupBy(_leading(F.col("h"), bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # Filling at every depth; a bucket splits as long as it is overfull.
    depths = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    shift = F.lit(bits) - F.col("depth")
    depths = depths.withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    fill = depths.groupBy("depth", "prefix").agg(F.sum("n").alias("filled"))
    chosen = (
        depths.join(fill, ["depth", "prefix"])
        .where((F.col("filled") <= capacity) | (shift == 0))
        .groupBy("slot")
        .agg(F.min(F.struct("depth", "prefix")).alias("b"))
        .select("slot", F.concat_ws("/", "b.depth", "b.prefix").alias("bucket"), F.col("b.depth").alias("depth"))
    )
    return chosen, bits


def build_index(docs: DataFrame, narrow: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written index, one row per distinct text. Equal hashes are told apart by their bytes."""
    directory, bits = build_directory(narrow.select("h").distinct(), capacity)
    norm = lower_ascii(whole())
    entries = (
        docs.select("doc_id", norm.alias("norm"))
        .withColumn("h", F.xxhash64("norm"))
        .groupBy("h", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    chain = F.row_number().over(Window.partitionBy("h").orderBy("text_sha256")) - 1
    placed = entries.withColumn("chain", chain).withColumn("slot", _leading(F.col("h"), bits))
    placed = placed.join(directory, "slot").repartitionByRange(F.col("slot"), F.col("h"))
    return materialize(placed.sortWithinPartitions("slot", "h", "chain"), "hash-index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain, h."""
    norm = lower_ascii(whole())
    narrow = materialize(
        docs.select("doc_id", F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256")), "hashes"
    )
    index = build_index(docs, narrow, capacity)
    key = ["h", "text_sha256"]
    limit = max(1.0, narrow.count() * HOT_SHARE)
    hot = index.where(F.col("group_size") > limit)
    found = ["keep_id", "group_size", "bucket", "chain"]
    # Rows of the few large groups meet their entry by broadcast, all others by a shuffled join.
    large = narrow.join(F.broadcast(hot.select(*key, *found)), key)
    rest = narrow.join(F.broadcast(hot.select(*key)), key, "left_anti")
    small = rest.join(index.where(F.col("group_size") <= limit).select(*key, *found), key)
    rows = large.unionByName(small)
    # Only rows that could stay are numbered, to tell repeated rows apart.
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    nth = F.row_number().over(Window.partitionBy("h", "text_sha256", stays).orderBy(F.lit(0)))
    kept = rows.where(stays).withColumn("kept", nth == 1)
    return kept.unionByName(rows.where(~stays).withColumn("kept", F.lit(False)))


def drop_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    norm = lower_ascii(whole())
    return keep_rows(docs, exact_duplicates(docs, capacity).where("kept"), F.sha2(norm, 256), "text_sha256")
