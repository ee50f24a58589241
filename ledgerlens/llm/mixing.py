"""Mixing sources to target weights by weighted fair queueing.

Every document waits in the queue of its source in a shuffled order that only depends on its id and
the seed. Its virtual finish time is the number of words its source has sent by then, divided by
the source's target. Sorting all queues by that time and cutting at the total budget gives each
source its share. A source may be sent ``max_repeats`` times; its target never exceeds that.

Null text has size 0, a null source is a source of its own (the last one). Rows of size 0 are never
taken. Rows that repeat are independent rows. With no words at all every target is 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import whole
from ledgerlens.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
ROWS_PER_SLICE = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size).

    A target is min(cap, level x weight); the level is what is left for the sources below their cap,
    per unit of weight. Sources come in the order in which a rising level reaches their caps.
    """
    one = F.lit(0)
    place = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    caps = (
        sizes.withColumn("place", place)
        .withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    along = Window.partitionBy(one).orderBy("ratio", "place")
    before = F.coalesce(F.sum("cap").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(along.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy(one)) * F.lit(float(share))
    levels = caps.withColumn("budget", budget).withColumn("level", (F.col("budget") - before) / open_weight)
    is_open = F.col("level") < F.col("ratio")
    level = F.min(F.when(is_open, F.struct("ratio", "place", "level"))).over(Window.partitionBy(one))
    target = F.when(is_open, level["level"] * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return levels.select("source", "place", "source_size", "budget", target.alias("target"))


def _running(df: DataFrame, keys: list[str], part: str, order: list[str], value: str) -> Column | DataFrame:
    """Running total of ``value`` along (part, order) within keys: totals per part first, so a task
    only ever holds one part of a key."""
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [*keys, part]).withColumn("running", F.col("_before") + F.sum(value).over(within))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = 0,
    payload: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, payload (a struct)."""
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        "doc_id",
        "source",
        F.regexp_count(whole(), F.lit(WORDS)).cast("bigint").alias("size"),
        shuffled.alias("turn"),
        *([F.struct(*payload).alias("payload")] if payload else []),
    )
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = materialize(sizes, "source-sizes")
    targets = materialize(source_targets(sizes.select("source", "source_size"), weights, share, max_repeats), "targets")
    known = F.col("a.source").eqNullSafe(F.col("b.source"))
    rows = rows.alias("a").join(targets.alias("b"), known).select("a.*", "b.place", "b.source_size", "b.budget", "b.target")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, total / rows_per_slice), 16)) + 1)
    rows = rows.withColumn("part", F.substring("turn", 1, digits))
    queued = _running(rows, ["place"], "part", ["turn", "doc_id", "size"], "size")
    queued = materialize(queued.withColumnRenamed("running", "sent").drop("_before", "part"), "queues")
    # One copy per pass over the source, in the order of the virtual finish times.
    finish = (F.col("sent") + F.col("pass") * F.col("source_size")) / F.col("target")
    copies = (
        queued.where("size > 0 AND target > 0")
        .select("doc_id", "place", "size", "turn", "sent", "source_size", "budget", "target")
        .withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(max_repeats)])))
        .withColumn("finish", finish)
    )
    slices = max(16, math.ceil(total / rows_per_slice))
    # Finish times of 2 and more share a last slice: the budget is spent long before.
    copies = copies.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(2 * slices)))
    spent = copies.groupBy("slice").agg(F.sum("size").alias("_sum"), F.max("budget").alias("budget"))
    along = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    spent = spent.withColumn("_before", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    # The budget ends in one slice; only that one is sorted.
    last = spent.where("_before <= budget AND _before + _sum > budget").select("slice", "_before")
    order = ["finish", "place", "turn", "doc_id", "pass"]
    within = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = copies.join(F.broadcast(last), "slice").withColumn("running", F.col("_before") + F.sum("size").over(within))
    cut = over.where("running > budget").agg(F.min(F.struct(*order)).alias("cut"))
    out = queued.crossJoin(F.broadcast(cut))  # one row
    taken = F.lit(0).cast("bigint")
    for i in range(max_repeats):
        at = (F.col("sent") + F.lit(i) * F.col("source_size")) / F.col("target")
        key = F.struct(at.alias("finish"), "place", "turn", "doc_id", F.lit(i).alias("pass"))
        goes = (F.col("size") > 0) & (F.col("target") > 0) & (F.col("cut").isNull() | (key < F.col("cut")))
        taken = taken + F.when(goes, F.col("size")).otherwise(F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["payload"] if payload else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, repeated as often as they are taken."""
    columns = docs.columns
    out = mix(docs, payload=columns, **options).where("taken > 0")
    times = F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))
    return out.withColumn("_copy", F.explode(times)).select(*[F.col(f"payload.`{c}`").alias(c) for c in columns])
