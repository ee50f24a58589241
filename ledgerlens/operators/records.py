"""Operational tables kept as append-only logs: latest row per key, alerts, audit, monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import json_payload
from ledgerlens.operators.ordered import ROWS_PER_TASK, running_totals
from ledgerlens.schema import ALERT_VERDICTS, POLICY_VERSION


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last written row of each key.

    An aggregate, not a window: versions of a key are reduced before the shuffle, so a key
    rewritten very often costs one row per task.
    """
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(newest).select(key, "_row.*").select(*df.columns)


def dedupe(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()


def raw_event_rows(events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    payload = list(columns or [c for c in events.columns])
    return events.select("event_id", "source", "ingested_at", json_payload(*payload).alias("payload_json"))


def snapshot_rows(df: DataFrame, features: Sequence[str], encoded: Sequence[str], created_at: Column) -> DataFrame:
    return df.select(
        "event_id",
        created_at.alias("created_at"),
        json_payload(*features).alias("feature_json"),
        json_payload(*encoded).alias("encoded_json"),
    )


def prediction_rows(outcomes: DataFrame, created_at: Column, latency_ms: Column) -> DataFrame:
    return outcomes.select(
        "event_id",
        created_at.alias("created_at"),
        "score",
        "verdict",
        "risk_band",
        "model_version",
        "policy_version",
        "threshold_review",
        "threshold_block",
        latency_ms.alias("processing_latency_ms"),
        F.to_json("reason_codes").alias("reason_codes_json"),
    )


def alert_id(event_id: Column, policy_version: Column | None = None) -> Column:
    """The same event under the same policy is the same alert, however often it is scored."""
    return F.sha2(F.concat_ws("|", event_id, policy_version if policy_version is not None else F.lit(POLICY_VERSION)), 256)


def alert_rows(predictions: DataFrame) -> DataFrame:
    """Open alerts of the predictions that need one."""
    return predictions.where(F.col("verdict").isin(*ALERT_VERDICTS)).select(
        alert_id(F.col("event_id"), F.col("policy_version")).alias("alert_id"),
        "event_id",
        "created_at",
        F.lit("OPEN").alias("status"),
        "verdict",
        "score",
        "reason_codes_json",
    )


def with_resolutions(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Alerts with their latest resolution; a later one replaces an earlier one."""
    last = latest_per_key(
        resolutions.select("alert_id", "analyst_id", "resolution", "analyst_comment", "resolved_at"),
        "alert_id",
        ["resolved_at", "analyst_id", "resolution"],
    ).withColumnRenamed("resolution", "analyst_resolution")
    joined = alerts.join(last, "alert_id", "left")
    return joined.withColumn(
        "status", F.when(F.col("resolved_at").isNotNull(), "RESOLVED").otherwise(F.col("status"))
    )


def unmatched_resolutions(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions of alerts that do not exist."""
    return resolutions.join(alerts.select("alert_id"), "alert_id", "left_anti")


def list_alerts(alerts: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest alerts first: a top-k, not a sort."""
    picked = alerts.where(F.col("status") == status) if status else alerts
    return picked.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def recent(df: DataFrame, time_col: str, tie: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(time_col), tie).limit(n)


def event_bundle(raw: DataFrame, predictions: DataFrame, features: DataFrame, alerts: DataFrame) -> DataFrame:
    """Everything known about each event; alerts newest first. A filter on the id pushes down.

    All inputs hold one row per event (see :func:`latest_per_key`) except the alerts: of those an
    event has one per policy version, and copies of an alert collapse before the shuffle.
    """
    per_event = alerts.groupBy("event_id").agg(
        F.sort_array(F.collect_set(F.struct("created_at", "alert_id", "status", "verdict", "score")), asc=False).alias("alerts")
    )
    pred = predictions.select(
        "event_id", F.struct(*[c for c in predictions.columns if c != "event_id"]).alias("prediction")
    )
    return (
        raw.select("event_id", F.col("payload_json").alias("raw_event"))
        .join(pred, "event_id", "full")
        .join(features.select("event_id", "feature_json", "encoded_json"), "event_id", "left")
        .join(per_event, "event_id", "left")
        .withColumn("alerts", F.coalesce("alerts", F.array().cast(per_event.schema["alerts"].dataType)))
    )


def exclusive_p95(df: DataFrame, value: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """95th percentile by the exclusive rule (position 19(N+1)/20), one row; 0 without rows.

    Near the ends it extrapolates: of [1, 2] it is 2.85.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    placed = running_totals(counted, [], "v", {"_lo": F.col("_c")}, None, rows_per_task)
    total = counted.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"))  # one row
    n = F.col("_n")
    j = F.greatest(F.least(F.floor(19 * (n + 1) / 20), n - 1), F.lit(1))
    delta = 19 * (n + 1) - 20 * j
    at = lambda i: (F.col("_lo") < i) & (i <= F.col("_lo") + F.col("_c"))
    low = F.when(at(j), F.col("v") * (20 - delta)).otherwise(0.0)
    high = F.when(at(j + 1), F.col("v") * delta).otherwise(0.0)
    part = F.when(n == 1, F.col("v") * 20).otherwise(low + high)
    return placed.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(part) / 20, F.lit(0.0)).alias("p95"))


def monitoring_summary(
    raw_events: DataFrame,
    predictions: DataFrame,
    alerts: DataFrame,
    dead_letters: DataFrame,
    since: Column | None = None,
    time_col: str = "created_at",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row of health figures. Without ``since`` all history counts."""
    if since is not None:
        predictions = predictions.where(F.col(time_col) >= since)
        alerts = alerts.where(F.col(time_col) >= since)
        dead_letters = dead_letters.where(F.col(time_col) >= since)
        raw_events = raw_events.where(F.col("ingested_at") >= since)
    by_verdict = predictions.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("s"),
        F.sum("processing_latency_ms").alias("l"),
    )
    totals = by_verdict.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("average_score"),
        F.coalesce(F.sum("l") / F.sum("n"), F.lit(0.0)).alias("average_latency_ms"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("verdict", "n")))).alias("verdict_counts"),
    )
    one_row = [
        raw_events.agg(F.count(F.lit(1)).alias("total_events")),
        alerts.agg(F.count_if(F.col("status") == "OPEN").alias("open_alerts")),
        dead_letters.agg(F.count(F.lit(1)).alias("dead_letter_events")),
        exclusive_p95(predictions, "processing_latency_ms", rows_per_task).withColumnRenamed("p95", "p95_latency_ms"),
    ]
    for part in one_row:
        totals = totals.crossJoin(F.broadcast(part))
    return totals.select(
        "total_events",
        "total_predictions",
        "open_alerts",
        "dead_letter_events",
        "average_score",
        "average_latency_ms",
        "p95_latency_ms",
        "verdict_counts",
    )


def runtime_counters(outcomes: DataFrame) -> DataFrame:
    """Requests, errors, mean latency in seconds and counts per verdict, one row.

    ``outcomes`` carries ``verdict`` (null for an error) and ``latency_ms``.
    """
    ok = F.col("verdict").isNotNull()
    per = outcomes.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("l"))
    return per.agg(
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("requests_total"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("errors_total"),
        F.coalesce(F.sum(F.when(ok, F.col("l"))) / F.sum(F.when(ok, F.col("n"))) / 1000, F.lit(0.0)).alias("latency_seconds_avg"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(ok, F.struct("verdict", "n"))))).alias("verdict_total"),
    )


def verdict_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def replay_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("verdict").isin(*ALERT_VERDICTS)).alias("alerts"),
    )


def alert_quality(resolved: DataFrame) -> DataFrame:
    """Detection and false-positive rate among resolved alerts, one row."""
    closed = resolved.where(F.col("status") == "RESOLVED")
    hit = F.count_if(F.col("analyst_resolution") == "TRUE_POSITIVE")
    miss = F.count_if(F.col("analyst_resolution") == "FALSE_POSITIVE")
    n = F.count(F.lit(1))
    return closed.agg(
        n.alias("resolved"),
        F.coalesce(F.try_divide(hit, n), F.lit(0.0)).alias("detection_rate"),
        F.coalesce(F.try_divide(miss, n), F.lit(0.0)).alias("false_positive_rate"),
    )


def feedback_labels(df: DataFrame, resolved: DataFrame, label: str) -> DataFrame:
    """Labels corrected by what analysts decided about the event's alerts."""
    verdicts = resolved.where(F.col("analyst_resolution").isin("TRUE_POSITIVE", "FALSE_POSITIVE"))
    last = verdicts.groupBy("event_id").agg(F.max_by("analyst_resolution", F.struct("resolved_at", "analyst_resolution")).alias("_said"))
    decided = F.when(F.col("_said") == "TRUE_POSITIVE", 1).when(F.col("_said") == "FALSE_POSITIVE", 0)
    return df.join(last, "event_id", "left").withColumn(label, F.coalesce(decided, F.col(label))).drop("_said")


def alert_budget(alerts: DataFrame, key: str, cap: int, time_col: str = "created_at") -> DataFrame:
    """At most ``cap`` alerts per key and day, highest scores first.

    The rank filter is applied before the shuffle too (each task forwards at most ``cap`` rows of
    a key and day), so a key with most of the alerts does not gather them in one task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key, F.to_date(time_col)).orderBy(F.desc("score"), "event_id")
    return alerts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")
