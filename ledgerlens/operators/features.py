"""Row-local features: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.scalars import (
    cyclic,
    finite_or,
    is_weekend,
    lenient_timestamp,
    ratio,
    unix_seconds,
    wall_clock,
)
from ledgerlens.operators.metadata import flatten_metadata, parse_metadata
from ledgerlens.schema import LEAKAGE_COLS, LEGACY_TARGET_COL, TARGET_COL

TIME_COL = "timestamp"
LOCAL_COL = "local_time"
_NUMERIC = (T.NumericType,)


def _calendar(df: DataFrame, time_col: str) -> Column:
    """Wall clock where the sender gave one, else the instant."""
    return F.col(LOCAL_COL) if LOCAL_COL in df.columns else F.col(time_col)


def time_columns(df: DataFrame, time_col: str = TIME_COL) -> DataFrame:
    """``hour`` and ``day_of_week`` (Monday = 0), only where the frame lacks them."""
    if time_col not in df.columns:
        return df
    at = _calendar(df, time_col)
    new = {"hour": F.hour(at), "day_of_week": F.weekday(at)}
    return df.withColumns({n: c for n, c in new.items() if n not in df.columns})


def time_features(df: DataFrame, time_col: str = TIME_COL) -> DataFrame:
    """Weekend flag and cyclic hour and weekday."""
    new: dict[str, Column] = {}
    if time_col in df.columns:
        new["is_weekend"] = is_weekend(_calendar(df, time_col)).cast("int")
    if "hour" in df.columns:
        new["hour_sin"], new["hour_cos"] = cyclic(F.col("hour"), 24)
    if "day_of_week" in df.columns:
        new["dow_sin"], new["dow_cos"] = cyclic(F.col("day_of_week"), 7)
    return df.withColumns(new) if new else df


def balance_features(df: DataFrame) -> DataFrame:
    """Balance change and amount as a share of the balance (0 where undefined)."""
    new: dict[str, Column] = {}
    if {"oldbalanceOrg", "newbalanceOrig"} <= set(df.columns):
        new["balance_delta"] = F.col("oldbalanceOrg").cast("double") - F.col(
            "newbalanceOrig"
        ).cast("double")
    if {"amount", "oldbalanceOrg"} <= set(df.columns):
        new["amt_to_balance"] = ratio(F.col("amount"), F.col("oldbalanceOrg"))
    return df.withColumns(new) if new else df


def risk_features(df: DataFrame) -> DataFrame:
    """Distance of the event's risk from the customer's, and of its amount from the average."""
    new: dict[str, Column] = {}
    if {"risk_risk_score", "risk_customer_risk_score"} <= set(df.columns):
        new["risk_score_gap"] = F.col("risk_risk_score") - F.col("risk_customer_risk_score")
    if "risk_amount_vs_average" in df.columns:
        new["amount_vs_avg_diff"] = F.col("risk_amount_vs_average") - 1.0
    return df.withColumns(new) if new else df


def risk_bucket(value: Column, median: Column | float | None = None) -> Column:
    """low (.., 0.3], medium (0.3, 0.6], high (0.6, ..); null takes the median's bucket."""
    x = value
    if median is not None:
        x = F.coalesce(value, median if isinstance(median, Column) else F.lit(float(median)))
    return F.when(x <= 0.3, "low").when(x <= 0.6, "medium").when(x.isNotNull(), "high")


def drop_columns(df: DataFrame, cols: Sequence[str] = LEAKAGE_COLS) -> DataFrame:
    """Drop leakage (or target) columns; absent ones are ignored."""
    return df.drop(*cols)


def drop_targets(df: DataFrame) -> DataFrame:
    return df.drop(TARGET_COL, LEGACY_TARGET_COL)


def finalize(df: DataFrame, time_col: str = TIME_COL) -> DataFrame:
    """Instant to unix seconds; missing or infinite numbers to 0; flags and text untouched."""
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name == LOCAL_COL or f.name == time_col:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite_or(c)
        elif isinstance(f.dataType, _NUMERIC):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    if time_col in df.columns:
        out.append(unix_seconds(F.col(time_col)).alias(f"{time_col}_ts"))
    return df.select(*out)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the fitted columns in fitted order: missing ones null, extra ones dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def require_rows(df: DataFrame) -> DataFrame:
    """Guard at the edge of a job: a frame without rows is an error."""
    if not isinstance(df, DataFrame):
        raise TypeError("input must be a DataFrame")
    if df.isEmpty():
        raise ValueError("input has no rows")
    return df


def event_defaults(df: DataFrame, iso_time: str = "event_time") -> DataFrame:
    """Calendar fields an event leaves out, read off the wall clock of its own time stamp.

    The event time falls back to ``ingested_at``; ids and labels do not belong to the features.
    """
    ingested = F.date_format(F.col("ingested_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    iso = F.coalesce(F.col(iso_time), ingested) if iso_time in df.columns else ingested
    df = df.withColumn("_iso", iso)
    at = wall_clock(F.col("_iso"))
    derived = {
        "hour": F.hour(at),
        "day_of_week": F.weekday(at),
        "day_of_month": F.dayofmonth(at),
        "month": F.month(at),
    }
    given = lambda n: F.col(n).cast("int") if n in df.columns else F.lit(None).cast("int")
    return df.withColumns(
        {
            **{n: F.coalesce(given(n), c) for n, c in derived.items()},
            TIME_COL: lenient_timestamp(F.col("_iso")),
            LOCAL_COL: at,
        }
    ).drop("_iso", "source", "ingested_at", iso_time, TARGET_COL, LEGACY_TARGET_COL)


def feature_frame(df: DataFrame, time_col: str = TIME_COL, keep_errors: bool = False) -> DataFrame:
    """The whole chain: drop leakage, flatten, calendar, balances, finish. One projection.

    With ``keep_errors``, ``metadata_error`` marks rows whose payload could not be read and whose columns
    are filled with defaults; :func:`unread_payloads` are the rows to look at.
    """
    out = drop_columns(df)
    if "metadata" in out.columns:
        out = flatten_metadata(out)
        out = out if keep_errors else out.drop("metadata_error")
    return (
        out.transform(time_columns, time_col)
        .transform(time_features, time_col)
        .transform(balance_features)
        .transform(finalize, time_col)
    )


def unread_payloads(df: DataFrame, col: str = "metadata") -> DataFrame:
    """Rows whose payload text cannot be read, as they came."""
    own = df.withColumn("_own", F.col(col))
    return parse_metadata(own, col).where(f"{col}_error").withColumn(col, F.col("_own")).select(*df.columns)
