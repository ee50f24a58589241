"""Binary classification metrics over ``(label, score)`` columns.

Curves need rows in score order. Equal scores are counted first; the table of distinct scores is
then accumulated in slices, so no task ever sees the whole ranking.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import ROWS_PER_TASK, running_totals


def score_curve(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Per distinct score: its counts, what lies above it, and the totals."""
    by = list(by)
    pos = F.col(label).cast("bigint")
    counted = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")
    )
    down = counted.withColumn("_desc", -F.col("threshold"))
    totals = {"pos_above": F.col("pos"), "neg_above": F.col("neg")}
    placed = running_totals(down, by, "_desc", totals, None, rows_per_task).drop("_desc")
    sums = counted.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if by:
        return placed.join(sums, by)
    return placed.crossJoin(F.broadcast(sums))  # one row


def _tp() -> Column:
    return F.col("pos_above") + F.col("pos")


def _fp() -> Column:
    return F.col("neg_above") + F.col("neg")


def pr_curve(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Precision and recall when everything at or above each distinct score is called positive."""
    return score_curve(df, label, score, by, rows_per_task).select(
        *by,
        "threshold",
        (_tp() / (_tp() + _fp())).alias("precision"),
        F.coalesce(F.try_divide(_tp(), F.col("all_pos")), F.lit(1.0)).alias("recall"),
    )


def rank_metrics(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Average precision (step-wise) and ROC-AUC (ties count half) from one curve."""
    curve = score_curve(df, label, score, by, rows_per_task)
    precision = _tp() / (_tp() + _fp())
    won = F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)
    return curve.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.max("all_pos")).alias("pr_auc"),
        F.try_divide(F.sum(won), F.max("all_pos") * F.max("all_neg")).alias("roc_auc"),
    )


def average_precision(df: DataFrame, label: str = "label", score: str = "score", **kw) -> DataFrame:
    return rank_metrics(df, label, score, **kw).drop("roc_auc")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", **kw) -> DataFrame:
    return rank_metrics(df, label, score, **kw).drop("pr_auc")


def confusion(df: DataFrame, label: str = "label", score: str = "score", threshold: float | Column = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion cells, precision, recall and F1 at a threshold; undefined ratios are 0."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    cells = df.groupBy(*by).agg(
        F.count_if(~y & ~hit).alias("tn"),
        F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"),
        F.count_if(y & hit).alias("tp"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns(
        {
            "precision": safe(tp, tp + fp),
            "recall": safe(tp, tp + fn),
            "f1": safe(2 * tp, 2 * tp + fp + fn),
        }
    )


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", threshold: float | Column = 0.5, by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """ROC-AUC, PR-AUC and F1."""
    ranks = rank_metrics(df, label, score, by, rows_per_task)
    cells = confusion(df, label, score, threshold, by).select(*by, "f1")
    return ranks.join(cells, list(by)) if by else ranks.crossJoin(F.broadcast(cells))


GRID_METRICS = ("f1", "precision", "recall")


def threshold_grid(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """F1, precision and recall at each of the 99 thresholds 0.01 .. 0.99, from one scan.

    A score is placed once in the grid; reverse running sums over 100 cells do the rest. A missing
    or NaN score is flagged at no threshold, but its label counts.
    """
    value = F.col(score).cast("double")
    value = F.when(value.isNull() | F.isnan(value), F.lit(-math.inf)).otherwise(value)
    step = (0.99 - 0.01) / 98
    grid = [0.01 + i * step for i in range(98)] + [0.99]
    placed = Bucketizer(
        splits=[-math.inf, *grid, math.inf], inputCol=score, outputCol="_cell"
    ).transform(df.select(label, value.alias(score)))
    pos = F.col(label).cast("bigint")
    seen = placed.groupBy(F.col("_cell").cast("int").alias("cell")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")
    )
    # Every cell once, also the empty ones; cell 0 lies below the grid.
    empty = df.sparkSession.range(0, 100, 1, 1).select(
        F.col("id").cast("int").alias("cell"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")
    )
    cells = seen.unionByName(empty).groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    one = Window.partitionBy(F.lit(0))
    down = one.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp, positives = F.sum("pos").over(down), F.sum("neg").over(down), F.sum("pos").over(one)
    table = cells.select("cell", tp.alias("tp"), fp.alias("fp"), positives.alias("positives")).where("cell > 0")
    return table.select(
        F.element_at(F.array(*[F.lit(g) for g in grid]), F.col("cell")).alias("threshold"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), F.lit(0.0)).alias("f1"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"),
        (F.col("tp") / F.greatest(F.col("positives"), F.lit(1))).alias("recall"),
    )


def best_thresholds(
    df: DataFrame, label: str = "label", score: str = "score", metrics: Sequence[str] = GRID_METRICS
) -> DataFrame:
    """Per metric the first grid threshold with the best value."""
    best = threshold_grid(df, label, score).agg(
        *[F.min(F.struct((-F.col(m)).alias("loss"), F.col("threshold"))).alias(m) for m in metrics]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"{m}.threshold").alias("threshold"), (-F.col(f"{m}.loss")).alias("value"))
            for m in metrics
        ]
    )
    return best.select(F.inline(rows))


def best_threshold(df: DataFrame, label: str = "label", score: str = "score", metric: str = "f1") -> DataFrame:
    """First grid threshold with the best value of one metric, one row."""
    return best_thresholds(df, label, score, [metric]).drop("metric")


def best_f1_threshold(df: DataFrame, label: str = "label", score: str = "score", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Score with the best F1 on the curve, the lowest on a tie; 0.5 without rows."""
    curve = pr_curve(df, label, score, (), rows_per_task)
    p, r = F.col("precision"), F.col("recall")
    f1 = curve.select("threshold", (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"))
    return f1.agg(
        F.coalesce(
            F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))), F.lit(0.5)
        ).alias("threshold"),
        F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1"),
    )


def threshold_at_fpr(df: DataFrame, label: str = "label", score: str = "score", max_fpr: float = 0.01, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Last corner of the ROC curve within the false-positive limit: its score and recall.

    Points inside a straight run of the curve are no corners: if the limit falls into a run of
    equal steps, the answer is the point where that run began. If not even the highest score is
    within the limit, the threshold is infinite and the recall 0.
    """
    curve = score_curve(df, label, score, (), rows_per_task).select(
        "threshold",
        F.struct("neg", "pos").alias("step"),
        (_fp() / F.col("all_neg")).alias("fpr"),
        (_tp() / F.col("all_pos")).alias("recall"),
    )
    beyond = curve.where(F.col("fpr") > max_fpr).agg(F.max_by("step", "threshold").alias("_run"))
    allowed = curve.where(F.col("fpr") <= max_fpr).crossJoin(F.broadcast(beyond))  # one row
    corner = F.col("_run").isNull() | (F.col("step") != F.col("_run"))
    point = F.struct("threshold", "recall")
    best = allowed.agg(
        F.min(F.when(corner, point)).alias("corner"), F.max(point).alias("start")
    ).select(F.coalesce("corner", "start").alias("p"))
    return best.select(
        F.coalesce("p.threshold", F.lit(math.inf)).alias("threshold"),
        F.coalesce("p.recall", F.lit(0.0)).alias("recall"),
    )


def minmax(df: DataFrame, score: str = "score", name: str = "scaled") -> DataFrame:
    """Scores stretched to [0, 1]; a constant score becomes 0."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    span = F.col("_hi") - F.col("_lo")
    scaled = (F.col(score) - F.col("_lo")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("_lo", "_hi")


def leaderboard(scored: DataFrame, label: str = "label", score: str = "score", model: str = "model", thresholds: dict[str, float] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Metrics per model from long ``(model, label, score)`` rows, best PR-AUC first."""
    cut = F.lit(0.5)
    for name, t in (thresholds or {}).items():
        cut = F.when(F.col(model) == name, F.lit(float(t))).otherwise(cut)
    out = binary_metrics(
        scored.withColumn("_cut", cut), label, score, F.col("_cut"), [model], rows_per_task
    )
    return out.select(model, "roc_auc", "pr_auc", F.col("f1").alias("f1_05")).orderBy(F.desc("pr_auc"), model)


def weighted_blend(df: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of score columns; the weights must add up to one."""
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("weights must add up to 1")
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * w
    return df.withColumn(name, total)


def blend_weights(coefficients: dict[str, float]) -> dict[str, float]:
    """Non-negative, normalised weights from the coefficients of a linear model."""
    kept = {k: max(float(v), 0.0) for k, v in coefficients.items()}
    total = sum(kept.values()) + 1e-12
    return {k: v / total for k, v in kept.items()}
