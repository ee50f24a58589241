"""Category encoders: fitted state is a table, applying it is a join or an expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import as_category, logit, smoothed_mean
from ledgerlens.operators.ordered import ROWS_PER_TASK, exact_quantiles, running_totals
from ledgerlens.operators.split import fold_number, fold_starts
from ledgerlens.session import materialize

RARE = "RARE"
LOW_CARD_MAX = 8
MAX_STATE_CATEGORIES = 10_000


@dataclass(frozen=True)
class TargetStats:
    """Smoothing of target means; 50 / 20 / no logit unless a training run says otherwise."""

    alpha: float = 50
    min_count: int = 20
    use_logit: bool = False
    eps: float = 1e-6
    n_splits: int = 5

    def encode(self, positives: Column, n: Column, prior: float | Column) -> Column:
        mean = smoothed_mean(positives, n, prior, self.alpha)
        return logit(mean, self.eps) if self.use_logit else mean

    def default(self, prior: float | Column) -> Column:
        p = prior if isinstance(prior, Column) else F.lit(float(prior))
        return logit(p, self.eps) if self.use_logit else p


def category_counts(
    df: DataFrame, cols: Sequence[str], label: str, extra: Sequence[str] = ()
) -> DataFrame:
    """``(col, category, n, positives)`` for all columns in one pass and one shuffle."""
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("col"), as_category(F.col(c)).alias("category")) for c in cols])
    )
    return (
        df.select(F.col(label).cast("bigint").alias("_y"), *extra, pairs)
        .groupBy("col", "category", *extra)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))
    )


def fold_rare(counts: DataFrame, min_count: int, extra: Sequence[str] = ()) -> DataFrame:
    """Categories seen fewer than ``min_count`` times become one category per column."""
    name = F.when(F.col("n") < min_count, F.lit(RARE)).otherwise(F.col("category"))
    return (
        counts.groupBy("col", *extra, name.alias("category"))
        .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    )


def rare_categories(df: DataFrame, cols: Sequence[str], label: str, min_count: int = 20) -> DataFrame:
    counts = category_counts(df, cols, label)
    return counts.where(F.col("n") < min_count).select("col", "category", "n")


def label_mean(df: DataFrame, label: str) -> float:
    return float(df.agg(F.avg(F.col(label).cast("double"))).first()[0])


def fit_target_state(
    df: DataFrame, cols: Sequence[str], label: str, prior: float, how: TargetStats = TargetStats()
) -> DataFrame:
    """State table ``(col, category, n, positives, enc)``; rare categories are one line."""
    state = fold_rare(category_counts(df, cols, label), how.min_count)
    return state.withColumn("enc", how.encode(F.col("positives"), F.col("n"), prior))


def apply_target_state(
    df: DataFrame,
    state: DataFrame,
    cols: Sequence[str],
    prior: float,
    how: TargetStats = TargetStats(),
    suffix: str = "_enc",
) -> DataFrame:
    """Encode by lookup: own value, else that of the rare ones, else the default.

    The size of the state decides between broadcast and shuffled join (left to the engine, which
    measures it); a hot category is split by the skew-join rule, since the rows are the left side.
    """
    state = state.select("col", "category", "enc")
    rare = {r["col"]: r["enc"] for r in state.where(F.col("category") == RARE).collect()}
    out = df
    for c in cols:
        lookup = state.where(F.col("col") == c).select(
            F.col("category").alias("_cat"), F.col("enc").alias(f"{c}{suffix}")
        )
        fallback = F.lit(rare[c]) if c in rare else how.default(prior)
        out = (
            out.join(lookup, as_category(F.col(c)) == F.col("_cat"), "left")
            .drop("_cat")
            .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), fallback))
        )
    return out


def causal_target_means(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    prior: float,
    time_col: str = "timestamp",
    id_col: str = "event_id",
    how: TargetStats = TargetStats(),
    suffix: str = "_enc",
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Encode each row from strictly earlier rows of its category; rare categories share one.

    ``counts`` are the category counts of these rows, where they are known already.
    """
    if counts is None:
        counts = materialize(category_counts(df, cols, label), "category-counts")
    groups = fold_rare(counts, how.min_count)
    frequent = counts.where(F.col("n") >= how.min_count)
    out = df.withColumn("_us", F.unix_micros(time_col))
    for c in cols:
        known = frequent.where(F.col("col") == c).select(F.col("category").alias("_cat"))
        sizes = groups.where(F.col("col") == c).select(F.col("category").alias("_cat"), F.col("n").alias("_n"))
        grouped = out.join(known, as_category(F.col(c)) == F.col("_cat"), "left").withColumn(
            "_cat", F.coalesce("_cat", F.lit(RARE))
        )
        totals = running_totals(
            grouped,
            ["_cat"],
            "_us",
            {"_seen": F.lit(1).cast("bigint"), "_pos": F.col(label).cast("bigint")},
            id_col,
            rows_per_task,
            sizes,
        )
        out = totals.withColumn(
            f"{c}{suffix}", how.encode(F.col("_pos"), F.col("_seen"), prior)
        ).drop("_cat", "_seen", "_pos")
    return out.drop("_us")


def oof_target_encode(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    time_col: str = "timestamp",
    id_col: str = "event_id",
    how: TargetStats = TargetStats(),
    suffix: str = "_enc",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Leak-safe training encoding: every fold sees only the folds before it.

    Counts are taken once per (category, fold); what a fold may use is a sum over earlier folds
    of that small table, rare categories decided per fold. The first block has nothing before it
    and is encoded row by row from strictly earlier rows. The prior is the mean over all rows.
    """
    total = df.agg(F.avg(F.col(label).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    prior = float(total["mean"] or 0.0)
    starts = fold_starts(df, time_col, id_col, how.n_splits, total["n"], rows_per_task)
    folded = df.withColumn("fold", fold_number(starts, time_col, id_col))
    if starts is None:
        return folded.withColumns({f"{c}{suffix}": how.default(prior) for c in cols})
    # The one pass over the rows; all that follows before the lookups reads this small table.
    counts = materialize(category_counts(folded, cols, label, ["fold"]), "category-counts")
    earlier = (
        counts.where(F.col("fold") < how.n_splits)
        .withColumn("fold", F.explode(F.sequence(F.col("fold") + 1, F.lit(how.n_splits))))
        .groupBy("col", "category", "fold")
        .agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    )
    state = fold_rare(earlier, how.min_count, ["fold"]).withColumn(
        "enc", how.encode(F.col("positives"), F.col("n"), prior)
    )
    rare = {
        (r["col"], r["fold"]): r["enc"]
        for r in state.where(F.col("category") == RARE).select("col", "fold", "enc").collect()
    }  # at most one line per column and fold
    later = folded.where(F.col("fold") > 0)
    for c in cols:
        lookup = state.where((F.col("col") == c) & (F.col("category") != RARE)).select(
            F.col("category").alias("_cat"), F.col("fold").alias("_fold"), F.col("enc").alias(f"{c}{suffix}")
        )
        fallback = how.default(prior)
        for f in range(1, how.n_splits + 1):
            if (c, f) in rare:
                fallback = F.when(F.col("fold") == f, F.lit(rare[c, f])).otherwise(fallback)
        on = (as_category(F.col(c)) == F.col("_cat")) & (F.col("fold") == F.col("_fold"))
        later = (
            later.join(lookup, on, "left")
            .drop("_cat", "_fold")
            .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), fallback))
        )
    first = causal_target_means(
        folded.where(F.col("fold") == 0), cols, label, prior, time_col, id_col, how, suffix, rows_per_task,
        counts.where(F.col("fold") == 0).drop("fold"),
    )
    return later.unionByName(first.select(*later.columns))


def sigmoid_state(
    df: DataFrame, cols: Sequence[str], label: str, smoothing: float = 20, min_samples: float = 50
) -> tuple[DataFrame, float]:
    """State of the sigmoid-smoothed encoder; null is no category here."""
    prior = label_mean(df, label)
    stacked = F.inline(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("category")) for c in cols])
    )
    counts = (
        df.select(F.col(label).cast("bigint").alias("_y"), stacked)
        .where(F.col("category").isNotNull())
        .groupBy("col", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))
    )
    weight = 1 / (1 + F.exp(-(F.col("n") - min_samples) / smoothing))
    return counts.withColumn(
        "enc", F.lit(prior) * (1 - weight) + F.col("positives") / F.col("n") * weight
    ), prior


def apply_sigmoid_state(
    df: DataFrame, state: DataFrame, cols: Sequence[str], prior: float, suffix: str = "_enc"
) -> DataFrame:
    out = df
    for c in cols:
        lookup = state.where(F.col("col") == c).select(
            F.col("category").alias("_cat"), F.col("enc").alias(f"{c}{suffix}")
        )
        out = (
            out.join(lookup, F.col(c).cast("string") == F.col("_cat"), "left")
            .drop("_cat")
            .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(prior)))
        )
    return out


def quantile_table(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Exact quantiles of several numeric columns, one line per column, in one pass."""
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
            )
        )
    )
    return exact_quantiles(long, ["column"], "value", probs, rows_per_task)


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return {r["column"]: r["median"] for r in quantile_table(df, cols, {"median": 0.5}).collect()}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(v)).otherwise(F.col(c))
            for c, v in values.items()
        }
    )


def impute_most_frequent(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.fillna(values) if values else df


def fit_robust_scale(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per column; a range of 0 scales by 1."""
    table = quantile_table(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()
    return {r["column"]: (r["median"], (r["q3"] - r["q1"]) or 1.0) for r in table}


def robust_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in fitted.items()})


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(col, value)``: the most frequent value of each column, the smallest on a tie."""
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    )
    counts = (
        df.select(pairs).where(F.col("value").isNotNull()).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("col").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def category_lists(df: DataFrame, cols: Sequence[str], limit: int = MAX_STATE_CATEGORIES) -> dict[str, list[tuple[str, int]]]:
    """Sorted ``(category, count)`` per column; refuses columns with more than ``limit`` values."""
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
    )
    counts = df.select(pairs).where(F.col("value").isNotNull()).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(limit * len(cols) + 1).collect()
    if len(rows) > limit * len(cols):
        raise ValueError("too many categories for an explicit list; use a target encoder")
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in cols}
    for r in rows:
        out[r["col"]].append((r["value"], r["n"]))
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, categories: dict[str, list[str]], prefix: str = "low_card__") -> DataFrame:
    """One 0/1 column per fitted category; unknown values are all zeros."""
    return df.withColumns(
        {
            f"{prefix}{c}_{v}": F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double")
            for c, values in categories.items()
            for v in values
        }
    )


def ordinal_codes(counts: list[tuple[str, int]], min_frequency: int = 50) -> dict[str, int]:
    """Frequent categories in sorted order get 0..k-1, all infrequent ones k."""
    frequent = [v for v, n in counts if n >= min_frequency]
    codes = {v: i for i, v in enumerate(frequent)}
    codes.update({v: len(frequent) for v, n in counts if n < min_frequency})
    return codes


def ordinal_state(df: DataFrame, cols: Sequence[str], min_frequency: int = 50) -> DataFrame:
    """State table ``(col, category, code)``, coded as :func:`ordinal_codes` does, for any number of values.

    Frequent values are range-partitioned and numbered within a partition; a partition starts after
    the values of those before it.
    """
    pairs = F.inline(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("category")) for c in cols])
    )
    counts = df.select(pairs).where(F.col("category").isNotNull()).groupBy("col", "category").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.repartitionByRange("col", F.col("n") < min_frequency, "category")
    counts = materialize(placed.withColumn("_part", F.spark_partition_id()), "category-counts")
    frequent, rare = counts.where(F.col("n") >= min_frequency), counts.where(F.col("n") < min_frequency)
    sizes = frequent.groupBy("col", "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("col").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("col", "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("col", "_part").orderBy("category"))
    own = frequent.withColumn("_nth", nth).join(starts, ["col", "_part"])
    own = own.select("col", "category", (F.col("_start") + F.col("_nth") - 1).alias("code"))
    last = sizes.groupBy("col").agg(F.sum("_size").alias("code"))
    shared = rare.join(last, "col", "left").select("col", "category", F.coalesce("code", F.lit(0)).alias("code"))
    return own.unionByName(shared)


def ordinal_encode(df: DataFrame, state: DataFrame, cols: Sequence[str], prefix: str = "orig__") -> DataFrame:
    """Codes by lookup in the state; unknown values -1. The size of the state decides how it is joined."""
    out = df
    for c in cols:
        lookup = state.where(F.col("col") == c).select(F.col("category").alias("_cat"), F.col("code").alias("_code"))
        out = out.join(lookup, F.col(c).cast("string") == F.col("_cat"), "left")
        out = out.withColumn(f"{prefix}{c}", F.coalesce("_code", F.lit(-1)).cast("double")).drop("_cat", "_code")
    return out


def count_classes(df: DataFrame, label: str) -> tuple[int, int]:
    """(negatives, positives); no positives is an error."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    if not row["pos"]:
        raise ValueError(f"{label} has no positives to weigh")
    return row["neg"], row["pos"]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Positive weight (negatives / positives) and balanced weights (n / 2 n_class), one row."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        F.try_divide(neg, pos).alias("scale_pos_weight"),
        F.try_divide(neg + pos, 2 * neg).alias("weight_negative"),
        F.try_divide(neg + pos, 2 * pos).alias("weight_positive"),
    )


def all_columns(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, by column name."""
    return reduce(DataFrame.unionByName, parts)
