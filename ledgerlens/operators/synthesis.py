"""Synthetic events: rows of a seed table drawn again and perturbed, repeatable by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import at_or_after, rows_at

SUSPICIOUS_RATIO = 0.2


def _uniform(salt: str, seed: int, low: float, high: float) -> Column:
    """Uniform number from the row's id and draw; the same on any partitioning."""
    h = F.pmod(F.xxhash64(F.col("seed_id"), F.col("draw"), F.lit(salt), F.lit(seed)), F.lit(1 << 30))
    return F.lit(low) + (high - low) * h / float(1 << 30)


def draw_rows(seed_df: DataFrame, id_col: str, count: int, seed: int = 42) -> DataFrame:
    """Exactly ``count`` rows: each one equally often, the rest of them picked by hash."""
    n = seed_df.count()
    if not n:
        raise ValueError("the seed table has no rows")
    times, rest = divmod(count, n)
    numbered = seed_df.withColumnRenamed(id_col, "seed_id")
    draws = F.lit(times)
    if rest:
        # One more draw for the first ``rest`` rows in hash order; the cut is a comparison.
        order = F.xxhash64("seed_id", F.lit(seed))
        slim = numbered.select(order.alias("_h"), "seed_id")
        (cut,) = rows_at(slim, "_h", "seed_id", [rest])
        draws = draws + (~at_or_after(cut, order, "seed_id")).cast("int")
    spread = numbered.withColumn("_draws", draws).where(F.col("_draws") > 0)
    return spread.select(
        *numbered.columns,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_draws").cast("bigint") - 1)).alias("draw"),
    )


def synthesize_events(
    seed_df: DataFrame,
    count: int,
    id_col: str = "event_id",
    suspicious_ratio: float = SUSPICIOUS_RATIO,
    seed: int = 42,
) -> DataFrame:
    """Perturbed events with a share of suspicious ones: inflated amounts, risk and merchant.

    ``seed_df`` has the flat columns of the feature operators.
    """
    rows = draw_rows(seed_df, id_col, count, seed)
    u = lambda salt, low, high: _uniform(salt, seed, low, high)
    rows = rows.withColumn("suspicious", u("kind", 0, 1) < suspicious_ratio)
    bad = F.col("suspicious")
    # The ranges of the perturbations.
    factor = u("amount", 0.75, 1.35) * F.when(bad, u("inflate", 6.0, 12.0)).otherwise(F.lit(1.0))
    rows = rows.withColumn("amount", F.greatest(F.lit(1.0), F.col("amount") * factor))
    rows = rows.withColumn(
        "oldbalanceOrg", F.greatest(F.col("amount") + 1, F.col("oldbalanceOrg") * u("balance", 0.7, 1.2))
    )
    risk = lambda c, default, lo_bad, hi_bad, lo, hi: F.coalesce(F.col(c), F.lit(default)) * F.when(
        bad, u(c + "+", lo_bad, hi_bad)
    ).otherwise(u(c, lo, hi))
    ref = lambda c, otherwise: F.when(bad, otherwise).otherwise(F.col(c))
    label = F.when(bad, 1).otherwise(F.col("isMoneyLaundering"))
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("seed_id"), F.col("draw"), F.lit(seed)), 256).alias("event_id"),
        F.lit("generator").alias("source"),
        "timestamp",
        "step",
        "type",
        ref("category", F.lit("Transfer")).alias("category"),
        "nameOrig",
        "nameDest",
        F.bround("amount", 2).alias("amount"),
        F.bround("oldbalanceOrg", 2).alias("oldbalanceOrg"),
        F.bround(F.greatest(F.lit(0.0), F.col("oldbalanceOrg") - F.col("amount")), 2).alias("newbalanceOrig"),
        F.least(F.lit(100.0), risk("risk_risk_score", 20.0, 2.5, 4.0, 0.8, 1.4)).alias("risk_risk_score"),
        F.least(F.lit(100.0), risk("risk_customer_risk_score", 20.0, 2.0, 3.5, 0.9, 1.3)).alias("risk_customer_risk_score"),
        risk("risk_amount_vs_average", 1.0, 5.0, 10.0, 0.8, 1.4).alias("risk_amount_vs_average"),
        (bad | (u("hour", 0, 1) < 0.1)).alias("risk_unusual_time"),
        (bad | (u("place", 0, 1) < 0.05)).alias("risk_unusual_location"),
        ref(
            "merch_merchant_id", F.concat(F.lit("HR-"), F.floor(u("merchant", 1000, 10000)).cast("string"))
        ).alias("merch_merchant_id"),
        F.when(bad, "HighRiskTransfer").alias("merch_category"),
        F.when(bad, "high").alias("merch_risk_level"),
        F.when(bad, F.bround(F.greatest(F.lit(10.0), F.col("amount") / u("average", 10.0, 20.0)), 2)).alias("merch_avg_transaction"),
        "suspicious",
        label.alias("isMoneyLaundering"),
        label.alias("isFraud"),
    )


def as_event_lines(df: DataFrame) -> DataFrame:
    """Contract-shaped records, ready for the JSON-lines writer."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    meta = F.struct(
        iso.alias("timestamp"),
        F.struct(
            F.col("merch_merchant_id").alias("merchant_id"),
            F.col("merch_category").alias("category"),
            F.col("merch_risk_level").alias("risk_level"),
            F.col("merch_avg_transaction").alias("avg_transaction"),
        ).alias("merchant_info"),
        F.struct(
            F.col("risk_amount_vs_average").alias("amount_vs_average"),
            F.col("risk_customer_risk_score").alias("customer_risk_score"),
            F.col("risk_risk_score").alias("risk_score"),
            F.col("risk_unusual_time").alias("unusual_time"),
            F.col("risk_unusual_location").alias("unusual_location"),
        ).alias("risk_indicators"),
    )
    return df.select(
        "event_id", "source", iso.alias("ingested_at"), "step", "type", "amount", "category", "nameOrig", "nameDest",
        "oldbalanceOrg", "newbalanceOrig", meta.alias("metadata"), "isMoneyLaundering", "isFraud",
    )
