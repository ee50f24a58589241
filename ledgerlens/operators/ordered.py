"""Order-dependent totals that stay distributed when one group holds much of the data.

A window over ``partitionBy(key)`` puts a whole group into one task. Here the rows of groups larger
than a task should hold are range-partitioned along (group, order) and written; every partition is a
slice. A slice is scanned on its own and receives what the slices before it add up to. Order columns
must not be null.

No list of groups, borders or slices reaches the driver: they are tables, and a join with them is a
broadcast only where the engine measures them as small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

ROWS_PER_TASK = 2_000_000
SLICE = "_slice"
# Ties of the order are broken by the hash of the row id: a fixed order that can be cut into
# ranges even if one value (say, a default timestamp) is carried by a third of all rows.
TIE = "_tie"


@dataclass(frozen=True)
class Sliced:
    """Rows with a slice number (0 = group small enough for one task) and the tie-break value."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    id_col: str | None
    any_hot: bool

    def window(self):
        """The one window specification of a scan: every total over it shares one sort."""
        ties = [TIE, self.id_col] if self.id_col else []
        return Window.partitionBy(*self.keys, SLICE).orderBy(self.order, *ties)


@dataclass(frozen=True)
class HotGroups:
    """Table of the keys of the groups above the limit, and how many rows they have together."""

    keys: DataFrame
    rows: int


def find_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    rows_per_task: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
) -> HotGroups | None:
    """One counting pass (combined before its shuffle) for the groups too large for a task.

    ``sizes`` (keys and ``_n``) saves the pass where group sizes are known already.
    """
    counts = sizes if sizes is not None else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = materialize(counts.where(F.col("_n") > rows_per_task).select(*keys, "_n"), "hot-groups")
    rows = found.agg(F.sum("_n").alias("n")).first()["n"]
    return HotGroups(found.drop("_n"), rows) if rows else None


def same_keys(keys: Sequence[str], left: str = "a", right: str = "b") -> list[Column]:
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def slice_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    id_col: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
) -> Sliced:
    """Cut the groups that exceed ``rows_per_task`` into slices along ``order``.

    Without keys the whole table is the group. Slices aim at half of ``rows_per_task``, since range
    borders come from a sample; the rows are written, so that a lost task finds the same slices.
    """
    keys = tuple(keys)
    tied = df.withColumn(TIE, F.xxhash64(F.col(id_col))) if id_col else df
    whole = F.lit(0).cast("bigint")
    if keys:
        hot = find_hot_groups(df, keys, rows_per_task, sizes)
        n = hot.rows if hot else 0
    else:
        n = df.count()
    if n <= rows_per_task:
        return Sliced(tied.withColumn(SLICE, whole), keys, order, id_col, False)
    large = tied
    if keys:
        large = tied.alias("a").join(hot.keys.alias("b"), same_keys(keys), "left_semi")
    along = [*keys, order, *([TIE, id_col] if id_col else [])]
    ranged = large.repartitionByRange(math.ceil(2 * n / rows_per_task), *along)
    cut = materialize(ranged.withColumn(SLICE, (F.spark_partition_id() + 1).cast("bigint")), "slices")
    if keys:
        rest = tied.alias("a").join(hot.keys.alias("b"), same_keys(keys), "left_anti")
        cut = cut.unionByName(rest.withColumn(SLICE, whole))
    return Sliced(cut, keys, order, id_col, True)


def carry(sliced: Sliced, table: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach the per-slice table to the rows of the cut groups."""
    same = same_keys((*sliced.keys, SLICE))
    extra = [c for c in table.columns if c not in (*sliced.keys, SLICE)]
    return (
        rows.alias("a")
        .join(table.alias("b"), same, "left")
        .select("a.*", *[F.col(f"b.{c}") for c in extra])
    )


def slices_before(sliced: Sliced):
    """Window over the slice table of a group: everything before the current slice."""
    w = Window.partitionBy(*sliced.keys) if sliced.keys else Window.partitionBy(F.lit(0))
    return w.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    id_col: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, the totals over the strictly earlier rows of its group.

    ``values`` maps the new column to the expression to add up; use integers or decimals where
    the result must not depend on the order of addition.
    """
    named = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    sliced = slice_groups(named, keys, order, id_col, rows_per_task, sizes)
    before = sliced.window().rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.lit(0).cast(sliced.df.schema[f"_v_{n}"].dataType) for n in values}
    rows = sliced.df.select(
        "*",
        *[F.coalesce(F.sum(f"_v_{n}").over(before), zero[n]).alias(f"_p_{n}") for n in values],
    )
    if not sliced.any_hot:
        out = {n: F.col(f"_p_{n}") for n in values}
    else:
        cells = (
            sliced.df.where(F.col(SLICE) > 0)
            .groupBy(*sliced.keys, SLICE)
            .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
        )
        prior = slices_before(sliced)
        table = cells.select(
            *sliced.keys,
            SLICE,
            *[F.coalesce(F.sum(f"_t_{n}").over(prior), zero[n]).alias(f"_o_{n}") for n in values],
        )
        rows = carry(sliced, table, rows)
        out = {n: F.col(f"_p_{n}") + F.coalesce(F.col(f"_o_{n}"), zero[n]) for n in values}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def row_rank(
    df: DataFrame,
    order: str,
    id_col: str,
    name: str = "rank",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Global 0-based position in the order, without a single-partition window."""
    return running_totals(
        df, [], order, {name: F.lit(1).cast("bigint")}, id_col, rows_per_task
    )


def rows_at(
    df: DataFrame,
    order: str,
    id_col: str,
    positions: Sequence[int],
    rows_per_task: int = ROWS_PER_TASK,
) -> list[tuple]:
    """(value, tie, id) of the rows at the given 0-based positions of the global order.

    Ranks only the narrow (order, id) columns; with :func:`at_or_after` the table itself can then
    be cut there without a shuffle.
    """
    ranked = row_rank(df.select(order, id_col), order, id_col, "_pos", rows_per_task)
    found = (
        ranked.where(F.col("_pos").isin(list(positions)))
        .select("_pos", order, F.xxhash64(id_col).alias(TIE), id_col)
        .orderBy("_pos")
        .collect()  # one row per position
    )
    return [(r[order], r[TIE], r[id_col]) for r in found]


def at_or_after(mark: tuple, order: Column, id_col: str) -> Column:
    """Whether a row comes at or after a marked row in the global order."""
    value, tie, row_id = mark
    own_tie = F.xxhash64(id_col)
    return (order > value) | (
        (order == value) & ((own_tie > tie) | ((own_tie == tie) & (F.col(id_col) >= row_id)))
    )


# Groups above this are searched by brackets: one rank is then less than a tenth of the slack around a bracket.
BRACKET_ROWS = 100_000
_ACCURACY = 10_000
_SLACK = 3e-4


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    rows_per_task: int = ROWS_PER_TASK,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one line per group.

    Groups of more than ``bracket_rows`` rows are searched by selection: sketches bracket each quantile,
    one pass counts what lies below the bracket and up to its end, and only the rows inside are shuffled
    and ordered. A bracket that the counts show to miss its quantile is not used. The other groups count
    equal values first, so no group is collected: what is ordered is the table of distinct values, and
    that one is cut into slices where it is large.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    large = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bracket_rows)
    # Written, so that its size is known before it is joined: the rows are then not shuffled by group.
    sizes = materialize(large, "large-groups")
    if not sizes.head(1):
        return _counted_quantiles(present, keys, value, probs, rows_per_task)
    marks = materialize(_brackets(present, sizes, keys, value, probs), "brackets")
    sure = marks.where("_sure")
    narrow = _selected_quantiles(present, sure, keys, value, probs, rows_per_task)
    if keys:
        rest = present.alias("a").join(sure.alias("b"), same_keys(keys), "left_anti")
    else:
        rest = present.where(F.lit(not sure.head(1)))
    wide = _counted_quantiles(rest, keys, value, probs, rows_per_task)
    if not keys:  # a group of no rows is not a group
        return narrow if sure.head(1) else wide
    return narrow.unionByName(wide)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], *take: str) -> DataFrame:
    """``left`` with columns of ``right``, which holds each key once (a single row without keys)."""
    if not keys:
        return left.crossJoin(F.broadcast(right.select(*take)))
    return left.alias("a").join(right.alias("b"), same_keys(keys)).select("a.*", *[f"b.{c}" for c in take])


def _ranks(probs: dict[str, float]) -> list[tuple[Column, Column, Column]]:
    """(lower place, upper place, share of the upper one) of each quantile in ``_n`` ordered values."""
    out = []
    for p in probs.values():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(at)
        out.append((low, F.least(low + 1, F.col("_n") - 1), at - low))
    return out


def _brackets(present: DataFrame, sizes: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """keys, _n, _ends (low, high of each quantile), _below (values before each low), _sure."""
    v = F.col(value).cast("double")
    ends = [min(1.0, max(0.0, p + s)) for p in probs.values() for s in (-_SLACK, _SLACK)]
    own = _joined(present, sizes, keys, "_n")
    sketched = own.groupBy(*keys).agg(F.first("_n").alias("_n"), F.percentile_approx(v, ends, _ACCURACY).alias("_ends"))
    sketched = materialize(sketched, "sketches")
    tested = _joined(present, sketched, keys, "_n", "_ends")
    n = len(probs)
    counts = tested.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.first("_ends").alias("_ends"),
        F.array(*[F.count_if(v < F.col("_ends")[2 * i]) for i in range(n)]).alias("_below"),
        F.array(*[F.count_if(v <= F.col("_ends")[2 * i + 1]) for i in range(n)]).alias("_upto"),
    )
    inside = [(F.col("_below")[i] <= low) & (high < F.col("_upto")[i]) for i, (low, high, _) in enumerate(_ranks(probs))]
    sure = inside[0]
    for one in inside[1:]:
        sure = sure & one
    return counts.withColumn("_sure", sure).drop("_upto")


def _selected_quantiles(
    present: DataFrame, sure: DataFrame, keys: list[str], value: str, probs: dict[str, float], rows_per_task: int
) -> DataFrame:
    v = F.col(value).cast("double")
    rows = _joined(present.select(*keys, v.alias("_v")), sure, keys, "_ends")
    hits = [
        F.when(F.col("_v").between(F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]), F.lit(i)) for i in range(len(probs))
    ]
    held = rows.select(*keys, "_v", F.explode(F.array_compact(F.array(*hits))).alias("_q"))
    counted = held.groupBy(*keys, "_q", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(counted, [*keys, "_q"], "_v", {"_lo": F.col("_c")}, None, rows_per_task)
    placed = _joined(placed, sure, keys, "_n", "_below")
    first = F.col("_lo") + F.get("_below", F.col("_q"))
    holds = lambda place: (first <= place) & (place < first + F.col("_c"))
    aggs = []
    for i, (name, (low, high, share)) in enumerate(zip(probs, _ranks(probs), strict=True)):
        part = F.when(holds(low), F.col("_v") * (1 - share)).otherwise(0.0) + F.when(holds(high), F.col("_v") * share).otherwise(0.0)
        aggs.append(F.sum(F.when(F.col("_q") == i, part)).alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def _counted_quantiles(present: DataFrame, keys: list[str], value: str, probs: dict[str, float], rows_per_task: int) -> DataFrame:
    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(counted, keys, value, {"_lo": F.col("_c")}, None, rows_per_task)
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        joined = placed.alias("a").join(totals.alias("b"), same_keys(keys)).select("a.*", "b._n")
    else:
        joined = placed.crossJoin(F.broadcast(totals))  # totals is a single row
    v = F.col(value).cast("double")
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        low, frac = F.floor(pos), pos - F.floor(pos)
        holds = lambda i: (F.col("_lo") <= i) & (i < F.col("_lo") + F.col("_c"))
        part = F.when(holds(low), v * (1 - frac)).otherwise(F.lit(0.0)) + F.when(
            holds(F.least(low + 1, F.col("_n") - 1)), v * frac
        ).otherwise(F.lit(0.0))
        aggs.append(F.sum(part).alias(name))
    return joined.groupBy(*keys).agg(*aggs)
