"""Registry of queries and the transaction view they share.

The view reads ``events`` as the transaction stream and ``customer`` as the account side; risk
indicators, device and payment fields are derived from the event's own columns, so every query
grows with the tables. ``TX_SQL`` states the same view for the checking engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its counterpart (see :func:`with_tx`)."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction events joined to their account."""
    e = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    joined = e.join(c, F.col("user_id") == F.col("c_custkey")).withColumns(
        {
            "k": k,
            "timestamp": F.col("ts").cast("timestamp"),
            "amount": F.col("value") * 100,
            "balance": F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10,
        }
    )
    text = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    lift = F.when(F.col("k") % 10 == 0, 1.5).otherwise(0.0)
    return joined.select(
        F.col("event_id").cast("string").alias("event_id"),
        "timestamp",
        F.floor((F.unix_seconds("timestamp") - 1704067200) / 3600).cast("int").alias("step"),
        text("C", "user_id").alias("nameOrig"),
        text("M", "k").alias("nameDest"),
        F.col("event_type").alias("type"),
        F.col("c_mktsegment").alias("category"),
        text("N", "c_nationkey").alias("loc_country"),
        "amount",
        F.col("balance").alias("oldbalanceOrg"),
        F.greatest(F.col("balance") - F.col("amount"), F.lit(0.0)).alias("newbalanceOrig"),
        F.col("k").cast("double").alias("risk_risk_score"),
        ((F.col("user_id") * 7) % 101).cast("double").alias("risk_customer_risk_score"),
        (F.col("value") / 20).alias("risk_amount_vs_average"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("k") % 3 + 1).alias(
            "risk_category_risk"
        ),
        (F.hour("timestamp") < 6).alias("risk_unusual_time"),
        (F.col("k") % 17 == 0).alias("risk_unusual_location"),
        F.element_at(
            F.array(F.lit("Mobile"), F.lit("Desktop"), F.lit("Tablet"), F.lit("POS")), F.col("k") % 4 + 1
        ).alias("device_type"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")).alias("device_ip_address"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("PM"), (F.col("user_id") % 5).cast("string"))).alias(
            "payment_method"
        ),
        text("M", "k").alias("merch_merchant_id"),
        ((F.col("k") % 10 == 0) & (F.col("value") > 30)).cast("int").alias("isMoneyLaundering"),
        # Nine digits: the last bit of exp() differs between engines, and equal scores are ties.
        F.round(1 / (1 + F.exp(-((F.col("amount") - 9000) / 2500 + lift))), 9).alias("score"),
        (5 + F.col("k") / 10 + F.col("value") / 50).alias("latency_ms"),
    )


TX_SQL = """tx AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts,
         CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS step,
         'C' || user_id AS "nameOrig", 'M' || k AS "nameDest", event_type AS type,
         c_mktsegment AS category, 'N' || c_nationkey AS loc_country,
         value * 100 AS amount, bal AS "oldbalanceOrg",
         greatest(bal - value * 100, 0) AS "newbalanceOrig",
         CAST(k AS DOUBLE) AS risk_risk_score,
         CAST((user_id * 7) % 101 AS DOUBLE) AS risk_customer_risk_score,
         value / 20 AS risk_amount_vs_average,
         CASE k % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_category_risk,
         hour(ts) < 6 AS risk_unusual_time, k % 17 = 0 AS risk_unusual_location,
         CASE k % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Desktop' WHEN 2 THEN 'Tablet' ELSE 'POS' END
           AS device_type,
         '10.0.0.' || (user_id % 50) AS device_ip_address,
         CASE WHEN user_id % 5 <> 0 THEN 'PM' || (user_id % 5) END AS payment_method,
         'M' || k AS merch_merchant_id,
         CAST(k % 10 = 0 AND value > 30 AS INT) AS "isMoneyLaundering",
         round(1 / (1 + exp(-((value * 100 - 9000) / 2500 + CASE WHEN k % 10 = 0 THEN 1.5 ELSE 0 END))), 9) AS score,
         5 + k / 10 + value / 50 AS latency_ms
  FROM (SELECT e.*, c.*, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k,
               greatest(c.c_acctbal, 0) * 10 AS bal
        FROM events e JOIN customer c ON e.user_id = c.c_custkey))"""

VEL_SQL = """vel AS (
  SELECT *,
    row_number() OVER (PARTITION BY "nameOrig", cs ORDER BY ts, event_id) - 1 AS tx_count_24h,
    coalesce(sum(amount) OVER (PARTITION BY "nameOrig", cs ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS amount_sum_24h,
    row_number() OVER (PARTITION BY "nameDest", ms ORDER BY ts, event_id) - 1 AS merchant_tx_count_24h
  FROM (SELECT *, sum(cn) OVER (PARTITION BY "nameOrig" ORDER BY ts, event_id) AS cs,
                  sum(mn) OVER (PARTITION BY "nameDest" ORDER BY ts, event_id) AS ms
        FROM (SELECT *,
                CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY "nameOrig" ORDER BY ts, event_id)
                     > 86400000000, false) AS INT) AS cn,
                CAST(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY "nameDest" ORDER BY ts, event_id)
                     > 86400000000, false) AS INT) AS mn
              FROM tx)))"""

FEAT_SQL = """feat AS (
  SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week,
    CAST(isodow(ts) - 1 >= 5 AS INT) AS is_weekend,
    sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
    sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos,
    "oldbalanceOrg" - "newbalanceOrig" AS balance_delta,
    CASE WHEN "oldbalanceOrg" = 0 THEN 0 ELSE amount / "oldbalanceOrg" END AS amt_to_balance,
    CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS timestamp_ts
  FROM {src})"""

REASONS_SQL = """list_filter([
    CASE WHEN amount >= 5000 THEN 'large_amount' END,
    CASE WHEN amt_to_balance >= 0.3 THEN 'high_amount_vs_balance' END,
    CASE WHEN risk_risk_score >= 70 THEN 'high_risk_indicator' END,
    CASE WHEN risk_customer_risk_score >= 80 THEN 'high_customer_risk' END,
    CASE WHEN risk_unusual_time THEN 'unusual_time' END,
    CASE WHEN risk_unusual_location THEN 'unusual_location' END,
    CASE WHEN is_weekend = 1 AND amount >= 2000 THEN 'weekend_high_value' END,
    CASE WHEN tx_count_24h >= 10 THEN 'high_customer_velocity_24h' END,
    CASE WHEN amount_sum_24h >= 20000 THEN 'high_customer_volume_24h' END,
    CASE WHEN merchant_tx_count_24h >= 20 THEN 'high_merchant_velocity_24h' END,
    CASE WHEN score >= 0.9 THEN 'extreme_model_score' END], lambda x: x IS NOT NULL)"""

OUTCOME_SQL = (
    VEL_SQL
    + ", "
    + FEAT_SQL.format(src="vel")
    + """, decided AS (
  SELECT *, CASE WHEN score >= 0.9 THEN 'BLOCK' WHEN score >= 0.65 THEN 'REVIEW' ELSE 'CLEAR' END AS verdict,
         CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS risk_band,
         """
    + REASONS_SQL
    + """ AS hits FROM feat),
outcome AS (
  SELECT *, CASE WHEN len(hits) = 0 AND verdict <> 'CLEAR' THEN ['elevated_model_risk'] ELSE hits END
            AS reason_codes FROM decided)"""
)

ALERTS_SQL = (
    OUTCOME_SQL
    + """, alerts AS (
  SELECT sha256(event_id || '|' || 'policy_v1') AS alert_id, event_id, ts AS created_at, verdict, score,
         array_to_string(reason_codes, ',') AS reasons, 'OPEN' AS status
  FROM outcome WHERE verdict IN ('REVIEW', 'BLOCK'))"""
)


def with_tx(select: str, *ctes: str) -> str:
    """Oracle text: the transaction view, further views, then the select."""
    return "WITH " + ", ".join([TX_SQL, *ctes]) + "\n" + select


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )
