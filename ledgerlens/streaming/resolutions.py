"""Alerts and their resolutions as two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.records import latest_per_key

_RESOLUTION = ("analyst_id", "resolution", "analyst_comment", "resolved_at")


def resolve_stream(alerts: DataFrame, resolutions: DataFrame, within: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Alerts with their resolutions, as they come: one row per alert and resolution, or one without.

    A resolution belongs to an alert up to ``within`` after it was made; it may come before the alert's
    own row does. Both sides stay in the state until the watermark, ``late`` behind the slower stream,
    has passed that bound, and an alert without resolutions is sent out then, still open. Unknown
    alerts' resolutions are never joined. :func:`latest_resolutions` makes one row per alert of it.
    """
    a = alerts.withWatermark("created_at", late)
    r = resolutions.select(F.col("alert_id").alias("resolved_alert"), *_RESOLUTION).withWatermark("resolved_at", late)
    meets = F.col("alert_id") == F.col("resolved_alert")
    in_time = (F.col("resolved_at") >= F.col("created_at")) & (F.col("resolved_at") <= F.col("created_at") + F.expr(f"INTERVAL {within}"))
    joined = a.join(r, meets & in_time, "left_outer")
    return joined.drop("resolved_alert").withColumn(
        "status", F.when(F.col("resolved_at").isNotNull(), "RESOLVED").otherwise(F.col("status"))
    )


def latest_resolutions(sent: DataFrame) -> DataFrame:
    """One row per alert from what the stream has sent out: the latest resolution replaces earlier ones."""
    last = latest_per_key(sent, "alert_id", ["resolved_at", "analyst_id", "resolution"])
    return last.withColumnRenamed("resolution", "analyst_resolution")
