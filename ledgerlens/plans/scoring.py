"""Feature, state, policy and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import features as feat
from ledgerlens.operators import metadata as meta
from ledgerlens.operators import policy as pol
from ledgerlens.operators import validation as val
from ledgerlens.operators import velocity as vel
from ledgerlens.plans.base import (
    ALERTS_SQL,
    FEAT_SQL,
    OUTCOME_SQL,
    VEL_SQL,
    query,
    rounded,
    table,
    tx,
    with_tx,
)
from ledgerlens.session import spread


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Events with features and activity state, ready for the policy."""
    return (
        tx(spark, sf)
        .transform(vel.velocity_state)
        .transform(feat.time_columns)
        .transform(feat.time_features)
        .transform(feat.balance_features)
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).transform(pol.apply_policy).transform(pol.add_reasons)


@query(
    "scoring_outcome",
    with_tx(
        """SELECT event_id, round(score, 6) AS score, verdict, risk_band, 'stacked_v1' AS model_version,
           'policy_v1' AS policy_version, 0.65::DOUBLE AS threshold_review, 0.9::DOUBLE AS threshold_block,
           array_to_string(reason_codes, ',') AS reason_codes, round(amount, 6) AS feature_amount,
           round(amt_to_balance, 6) AS feature_amt_to_balance FROM outcome""",
        OUTCOME_SQL,
    ),
)
def scoring_outcome(spark, sf):
    """Flagship: features, state, verdict, reasons and the full outcome row per event."""
    out = pol.scoring_outcome(enriched(spark, sf), features=["amount", "amt_to_balance"])
    # The snapshot is read back: engines write numbers in different ways.
    kept = F.from_json("feature_json", "amount double, amt_to_balance double")
    out = out.withColumns({"reason_codes": F.array_join("reason_codes", ","), "_kept": kept})
    out = out.withColumns({"feature_amount": F.col("_kept.amount"), "feature_amt_to_balance": F.col("_kept.amt_to_balance")})
    return rounded(out.drop("feature_json", "_kept"))


@query(
    "velocity_state",
    with_tx(
        """SELECT event_id, tx_count_24h, round(amount_sum_24h, 4) AS amount_sum_24h,
           merchant_tx_count_24h FROM vel""",
        VEL_SQL,
    ),
)
def velocity_state(spark, sf):
    out = vel.velocity_state(tx(spark, sf).select("event_id", "timestamp", "nameOrig", "nameDest", "amount"))
    return rounded(out.select("event_id", "tx_count_24h", "amount_sum_24h", "merchant_tx_count_24h"), 4)


@query(
    "no_state_profile",
    with_tx(
        """SELECT event_id, CAST(0 AS BIGINT) AS tx_count_24h, 0::DOUBLE AS amount_sum_24h,
           CAST(0 AS BIGINT) AS merchant_tx_count_24h FROM tx"""
    ),
)
def no_state_profile(spark, sf):
    return vel.without_state(tx(spark, sf).select("event_id"))


@query(
    "customer_sessions",
    with_tx(
        """SELECT "nameOrig", CAST(cs + 1 AS BIGINT) AS session_no, count(*) AS tx_count,
           round(sum(amount), 4) AS amount_sum, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us
           FROM vel GROUP BY 1, 2""",
        VEL_SQL,
    ),
)
def customer_sessions(spark, sf):
    out = vel.customer_sessions(tx(spark, sf))
    return rounded(
        out.withColumns(
            {"start_us": F.unix_micros("session_start"), "end_us": F.unix_micros("session_end")}
        ).drop("session_start", "session_end"),
        4,
    )


@query(
    "rolling_24h",
    with_tx(
        """SELECT event_id, count(*) OVER w AS tx_count_rolling,
           round(coalesce(sum(amount) OVER w, 0), 4) AS amount_sum_rolling FROM tx
           WINDOW w AS (PARTITION BY "nameOrig" ORDER BY epoch_us(ts)
                        RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)"""
    ),
)
def rolling_24h(spark, sf):
    out = vel.rolling_window(tx(spark, sf).select("event_id", "timestamp", "nameOrig", "amount"))
    return rounded(out.select("event_id", "tx_count_rolling", "amount_sum_rolling"), 4)


@query(
    "time_features",
    with_tx(
        """SELECT event_id, CAST(hour AS INT) AS hour, CAST(day_of_week AS INT) AS day_of_week, is_weekend,
           round(hour_sin, 6) AS hour_sin, round(hour_cos, 6) AS hour_cos,
           round(dow_sin, 6) AS dow_sin, round(dow_cos, 6) AS dow_cos FROM feat""",
        FEAT_SQL.format(src="tx"),
    ),
)
def time_features(spark, sf):
    out = tx(spark, sf).select("event_id", "timestamp")
    return rounded(feat.time_features(feat.time_columns(out)).drop("timestamp"))


@query(
    "balance_features",
    with_tx(
        """SELECT event_id, round(balance_delta, 6) AS balance_delta, round(amt_to_balance, 6) AS amt_to_balance
           FROM feat""",
        FEAT_SQL.format(src="tx"),
    ),
)
def balance_features(spark, sf):
    out = tx(spark, sf).select("event_id", "amount", "oldbalanceOrg", "newbalanceOrig")
    return rounded(feat.balance_features(out).select("event_id", "balance_delta", "amt_to_balance"))


@query(
    "risk_features",
    with_tx(
        """SELECT event_id, risk_risk_score - risk_customer_risk_score AS risk_score_gap,
           round(risk_amount_vs_average - 1, 6) AS amount_vs_avg_diff FROM tx"""
    ),
)
def risk_features(spark, sf):
    out = feat.risk_features(tx(spark, sf))
    return rounded(out.select("event_id", "risk_score_gap", "amount_vs_avg_diff"))


@query(
    "risk_bucket",
    with_tx(
        """SELECT event_id, CASE WHEN x <= 0.3 THEN 'low' WHEN x <= 0.6 THEN 'medium' ELSE 'high' END AS bucket
           FROM (SELECT event_id, coalesce(v, median(v) OVER ()) AS x
                 FROM (SELECT event_id, CASE WHEN payment_method IS NOT NULL
                              THEN risk_customer_risk_score / 100 END AS v FROM tx))"""
    ),
)
def risk_bucket(spark, sf):
    """Share of the customer risk scale; missing for some customers, who take the median."""
    from ledgerlens.operators.ordered import exact_quantiles

    v = F.when(F.col("payment_method").isNotNull(), F.col("risk_customer_risk_score") / 100)
    df = tx(spark, sf).select("event_id", v.alias("v"))
    median = exact_quantiles(df, [], "v", {"median": 0.5})
    return df.crossJoin(F.broadcast(median)).select(
        "event_id", feat.risk_bucket(F.col("v"), F.col("median")).alias("bucket")
    )


@query(
    "feature_frame",
    with_tx(
        """SELECT event_id, step, "nameOrig", "nameDest", type, category, round(amount, 6) AS amount,
           round("oldbalanceOrg", 6) AS "oldbalanceOrg", round("newbalanceOrig", 6) AS "newbalanceOrig", CAST(hour AS INT) AS hour,
           CAST(day_of_week AS INT) AS day_of_week, is_weekend, round(hour_sin, 6) AS hour_sin,
           round(hour_cos, 6) AS hour_cos, round(dow_sin, 6) AS dow_sin, round(dow_cos, 6) AS dow_cos,
           round(balance_delta, 6) AS balance_delta, round(amt_to_balance, 6) AS amt_to_balance, timestamp_ts
           FROM feat""",
        FEAT_SQL.format(src="tx"),
    ),
)
def feature_frame(spark, sf):
    cols = ["event_id", "timestamp", "step", "nameOrig", "nameDest", "type", "category", "amount"]
    df = tx(spark, sf).select(*cols, "oldbalanceOrg", "newbalanceOrig", "isMoneyLaundering")
    return rounded(feat.feature_frame(df))


@query(
    "drop_leakage",
    with_tx('SELECT event_id, type, amount FROM tx'),
)
def drop_leakage(spark, sf):
    df = tx(spark, sf).select("event_id", "type", "amount", "isMoneyLaundering")
    return feat.drop_targets(feat.drop_columns(df.withColumn("fraud_probability", F.lit(0.5))))


@query(
    "finalize",
    with_tx(
        """SELECT event_id, CASE WHEN "oldbalanceOrg" = 0 THEN 0 ELSE round(amount / "oldbalanceOrg", 6) END AS raw_ratio,
           CASE WHEN payment_method IS NULL THEN 0 ELSE step END AS step,
           coalesce(payment_method, '') AS payment_method,
           CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS timestamp_ts FROM tx"""
    ),
)
def finalize(spark, sf):
    """Infinite ratios and missing steps become 0; text stays as it is."""
    ratio = F.when(F.col("oldbalanceOrg") == 0, F.lit(float("inf"))).otherwise(
        F.col("amount") / F.nullif("oldbalanceOrg", F.lit(0.0))
    )
    df = tx(spark, sf).select(
        "event_id",
        "timestamp",
        ratio.alias("raw_ratio"),
        F.when(F.col("payment_method").isNotNull(), F.col("step")).alias("step"),
        F.coalesce("payment_method", F.lit("")).alias("payment_method"),
    )
    return rounded(feat.finalize(df))


@query(
    "align_schema",
    with_tx("SELECT '' AS absent_text, amount, event_id, 0::DOUBLE AS absent_number FROM tx"),
)
def align_schema(spark, sf):
    from pyspark.sql import types as T

    fitted = T.StructType(
        [
            T.StructField("amount", T.DoubleType()),
            T.StructField("absent_number", T.DoubleType()),
            T.StructField("event_id", T.StringType()),
            T.StructField("absent_text", T.StringType()),
        ]
    )
    out = feat.align_schema(tx(spark, sf), fitted)
    return out.fillna(0.0, ["absent_number"]).fillna("", ["absent_text"])


def _payload(quote_key: str = "metadata"):
    """Python-literal payload text, as the raw table carries it, built from the event itself."""
    ts = F.col("timestamp")
    part = lambda f: F.date_format(ts, f).cast("int").cast("string")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000)).cast("string")
    made = F.concat(
        F.lit("datetime.datetime("),
        F.concat_ws(", ", part("yyyy"), part("M"), part("d"), part("H"), part("m"), part("s"), micros),
        F.lit(")"),
    )
    iso = F.concat(F.lit("'"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("'"))
    pybool = lambda c: F.when(F.col(c), F.lit("True")).otherwise(F.lit("False"))
    k = F.col("risk_risk_score").cast("int")
    method = F.when(F.col("payment_method").isNull(), F.lit("None")).otherwise(
        F.concat(F.lit("'"), F.col("payment_method"), F.lit("'"))
    )
    text = F.concat(
        F.lit("{'timestamp': "), F.when(k % 2 == 0, made).otherwise(iso),
        F.lit(", 'payment_method': "), method,
        F.lit(", 'location': {'city': \"O'Hare, True\", 'country': '"), F.col("loc_country"), F.lit("'}"),
        F.lit(", 'device_info': {'type': '"), F.col("device_type"),
        F.lit("', 'ip_address': '"), F.col("device_ip_address"), F.lit("', 'os': None}"),
        F.when(k % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit(", 'merchant_info': {'merchant_id': '"), F.col("nameDest"), F.lit("', 'avg_transaction': "),
                     F.when(k % 5 == 0, F.lit("'n/a'")).otherwise(k.cast("string")), F.lit("}"))
        ),
        F.lit(", 'risk_indicators': {'risk_score': "), k.cast("string"),
        F.lit(", 'customer_risk_score': "), F.col("risk_customer_risk_score").cast("string"),
        F.lit(", 'category_risk': '"), F.col("risk_category_risk"),
        F.lit("', 'unusual_time': "), pybool("risk_unusual_time"),
        F.lit(", 'unusual_location': "), pybool("risk_unusual_location"), F.lit("}}"),
    )
    return F.when(k % 29 == 3, F.lit("{'timestamp': garbage")).otherwise(text).alias(quote_key)


_K = "CAST(risk_risk_score AS INT)"


@query(
    "parse_metadata",
    with_tx(
        f"""SELECT event_id, {_K} % 29 = 3 AS metadata_error,
            CASE WHEN {_K} % 29 = 3 THEN '' WHEN epoch_us(ts) % 1000000 = 0 AND {_K} % 2 = 0
                 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_text,
            CASE WHEN {_K} % 29 = 3 THEN '' ELSE 'O''Hare, True' END AS city,
            CASE WHEN {_K} % 29 = 3 THEN '' ELSE coalesce(payment_method, '') END AS payment_method,
            CASE WHEN {_K} % 29 = 3 OR {_K} % 7 = 0 THEN '' ELSE "nameDest" END AS merchant_id
            FROM tx"""
    ),
)
def parse_metadata(spark, sf):
    df = meta.parse_metadata(tx(spark, sf).select("event_id", _payload()))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        "event_id",
        "metadata_error",
        text("metadata.timestamp").alias("ts_text"),
        text("metadata.location.city").alias("city"),
        text("metadata.payment_method").alias("payment_method"),
        text("metadata.merchant_info.merchant_id").alias("merchant_id"),
    )


@query(
    "flatten_metadata",
    with_tx(
        f"""SELECT event_id, epoch_us(ts) AS us, coalesce(payment_method, 'Unknown') AS payment_method,
            'O''Hare, True' AS loc_city, loc_country, 'Unknown' AS loc_state, device_type, 'Unknown' AS device_os,
            device_ip_address, CASE WHEN {_K} % 7 = 0 THEN 'Unknown' ELSE "nameDest" END AS merch_merchant_id,
            CASE WHEN {_K} % 7 = 0 OR {_K} % 5 = 0 THEN -1 ELSE risk_risk_score END AS merch_avg_transaction,
            risk_risk_score, risk_customer_risk_score, risk_category_risk, risk_unusual_time, risk_unusual_location
            FROM tx WHERE {_K} % 29 <> 3"""
    ),
)
def flatten_metadata(spark, sf):
    df = meta.parse_metadata(tx(spark, sf).select("event_id", _payload()))
    flat = meta.flatten_metadata(df.where(~F.col("metadata_error")).drop("metadata_error"))
    return flat.select(
        "event_id", F.unix_micros("timestamp").alias("us"), "payment_method", "loc_city", "loc_country",
        "loc_state", "device_type", "device_os", "device_ip_address", "merch_merchant_id",
        F.coalesce("merch_avg_transaction", F.lit(-1.0)).alias("merch_avg_transaction"),
        "risk_risk_score", "risk_customer_risk_score", "risk_category_risk", "risk_unusual_time",
        "risk_unusual_location",
    )


@query(
    "recover_literals",
    with_tx(
        f"""SELECT event_id, {_K} % 2 = 0 AS recovered FROM tx WHERE {_K} % 29 = 3"""
    ),
)
def recover_literals(spark, sf):
    """Rejected payloads: half of them use Python forms JSON lacks, half are garbage."""
    k = F.col("risk_risk_score").cast("int")
    odd = F.when(k % 2 == 0, F.lit("{'location': {'city': 'a' 'b'}, 'n': (1, 2)}")).otherwise(F.lit("{'a': garbage"))
    lines = tx(spark, sf).select("event_id", F.when(k % 29 == 3, odd).otherwise(_payload()).alias("raw"))
    bad = meta.parse_metadata(lines.withColumn("metadata", F.col("raw"))).where("metadata_error")
    out = meta.recover_literals(bad.select("event_id", F.col("raw").alias("metadata")))
    return out.select("event_id", F.col("metadata_json").isNotNull().alias("recovered"))


@query(
    "expand_struct",
    with_tx("""SELECT event_id, amount AS bal_amount, "oldbalanceOrg" AS "bal_oldbalanceOrg" FROM tx"""),
)
def expand_struct(spark, sf):
    df = tx(spark, sf).select("event_id", F.struct("amount", "oldbalanceOrg").alias("bal"))
    return meta.expand_struct(df, "bal", "bal")


@query(
    "fill_unknown",
    with_tx("SELECT event_id, coalesce(payment_method, 'Unknown') AS payment_method FROM tx"),
)
def fill_unknown(spark, sf):
    return meta.fill_unknown(tx(spark, sf).select("event_id", "payment_method"))


@query(
    "coerce_numeric",
    with_tx(
        """SELECT event_id, coalesce(TRY_CAST(CASE WHEN payment_method IS NULL THEN 'n/a'
           ELSE CAST(risk_risk_score AS VARCHAR) END AS DOUBLE), -1) AS v FROM tx"""
    ),
)
def coerce_numeric(spark, sf):
    raw = F.when(F.col("payment_method").isNull(), "n/a").otherwise(F.col("risk_risk_score").cast("string"))
    df = meta.coerce_numeric(tx(spark, sf).select("event_id", raw.alias("v")), ["v", "absent"])
    return df.fillna(-1.0, ["v"])


@query(
    "coerce_timestamp",
    with_tx(
        """SELECT event_id, CASE WHEN payment_method IS NULL THEN -1 ELSE epoch_us(date_trunc('second', ts)) END AS us
           FROM tx"""
    ),
)
def coerce_timestamp(spark, sf):
    raw = F.when(F.col("payment_method").isNull(), "yesterday").otherwise(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    df = meta.coerce_timestamp(tx(spark, sf).select("event_id", raw.alias("t")), ["t"])
    return df.select("event_id", F.coalesce(F.unix_micros("t"), F.lit(-1)).alias("us"))


@query(
    "event_defaults",
    with_tx(
        f"""SELECT event_id, CAST(CASE WHEN {_K} % 3 = 0 THEN 7 ELSE hour(l) END AS INT) AS hour,
            CAST(isodow(l) - 1 AS INT) AS day_of_week, CAST(day(l) AS INT) AS day_of_month,
            CAST(month(l) AS INT) AS month,
            epoch_us(date_trunc('second', ts)) AS us
            FROM (SELECT *, CASE WHEN {_K} % 4 = 0 THEN ts ELSE ts + INTERVAL 5 HOUR END AS l FROM tx)"""
    ),
)
def event_defaults(spark, sf):
    """Events with their own offset (+05:00); some lack a time stamp, some bring their hour."""
    k = F.col("risk_risk_score").cast("int")
    local = F.date_format(F.expr("timestamp + INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+05:00'")
    df = tx(spark, sf).select(
        "event_id",
        F.date_trunc("second", "timestamp").alias("ingested_at"),
        F.when(k % 4 != 0, local).alias("event_time"),
        F.when(k % 3 == 0, F.lit(7)).alias("hour"),
    )
    out = feat.event_defaults(df)
    return out.select(
        "event_id", "hour", "day_of_week", "day_of_month", "month", F.unix_micros("timestamp").alias("us")
    )


def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON event lines built from the transactions, some of them broken in known ways."""
    k = F.col("risk_risk_score").cast("int")
    meta_struct = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        "payment_method",
        F.struct(F.col("loc_country").alias("country")).alias("location"),
        F.struct(F.col("device_type").alias("type")).alias("device_info"),
        F.struct(
            F.col("risk_risk_score").alias("risk_score"),
            F.col("risk_customer_risk_score").alias("customer_risk_score"),
            F.col("risk_category_risk").alias("category_risk"),
            F.col("risk_unusual_time").alias("unusual_time"),
            F.col("risk_unusual_location").alias("unusual_location"),
        ).alias("risk_indicators"),
    )
    line = F.to_json(
        F.struct(
            "event_id", "step", "type", "category", "nameOrig", "nameDest",
            F.when(k % 13 != 0, F.when(k % 7 == 0, F.lit("12.5")).otherwise(F.col("amount").cast("string"))).alias("amount"),
            "oldbalanceOrg", "newbalanceOrig",
            F.when(k % 11 == 0, F.lit("x")).alias("surprise"),
            F.when(k % 17 == 1, F.lit("noon")).alias("hour"),
            meta_struct.alias("metadata"),
        )
    )
    broken = F.when(k % 19 == 5, F.concat(F.lit("{not json "), F.col("event_id"))).otherwise(line)
    rows = spread(tx(spark, sf), table(spark, sf, "events").count())
    return rows.select(broken.alias("payload"), F.col("event_id").alias("source_id"))


_ERR = f"""CASE WHEN {_K} % 19 = 5 THEN 'payload: not JSON' ELSE array_to_string(list_filter([
    CASE WHEN {_K} % 13 = 0 THEN 'amount: field required' END,
    CASE WHEN {_K} % 17 = 1 THEN 'hour: invalid int' END,
    CASE WHEN {_K} % 11 = 0 THEN 'surprise: extra field' END], lambda x: x IS NOT NULL), '; ') END"""


@query(
    "validate_events",
    with_tx(f"""SELECT event_id AS source_id, {_ERR} AS error_message FROM tx"""),
)
def validate_events(spark, sf):
    out = val.validate_events(raw_lines(spark, sf))
    return out.select("source_id", F.concat_ws("; ", "errors").alias("error_message"))


@query(
    "dead_letter",
    with_tx(
        f"""SELECT error_message, count(*) AS n FROM (SELECT {_ERR} AS error_message FROM tx)
            WHERE error_message <> '' GROUP BY 1"""
    ),
)
def dead_letter(spark, sf):
    _, dead = val.split_valid(raw_lines(spark, sf))
    return dead.groupBy("error_message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "typed_events",
    with_tx(
        f"""SELECT event_id, CASE WHEN {_K} % 7 = 0 THEN 12.5 ELSE round(amount, 6) END AS amount,
            'api' AS source, type, loc_country AS country, step FROM (SELECT *, {_ERR} AS err FROM tx) WHERE err = ''"""
    ),
)
def typed_events(spark, sf):
    good, _ = val.split_valid(raw_lines(spark, sf))
    out = val.typed_events(good)
    return rounded(
        out.select("event_id", "amount", "source", "type", F.col("metadata.location.country").alias("country"), "step")
    )


@query(
    "quality_rules",
    with_tx(
        f"""SELECT event_id, array_to_string(list_filter([
            CASE WHEN {_K} % 9 = 0 THEN 'missing_timestamp' END,
            CASE WHEN {_K} % 8 = 0 THEN 'invalid_amount' END], lambda x: x IS NOT NULL), ',') AS quality_errors FROM tx"""
    ),
)
def quality_rules(spark, sf):
    k = F.col("risk_risk_score").cast("int")
    df = tx(spark, sf).select(
        "event_id",
        F.when(k % 9 != 0, F.col("timestamp")).alias("timestamp"),
        F.when(k % 8 == 0, -1 - F.col("amount")).otherwise(F.col("amount")).alias("amount"),
    )
    out = val.quality_errors(df)
    return out.select("event_id", F.array_join("quality_errors", ",").alias("quality_errors"))


@query(
    "verdict_policy",
    with_tx("SELECT event_id, verdict, risk_band FROM decided", OUTCOME_SQL),
)
def verdict_policy(spark, sf):
    return pol.apply_policy(tx(spark, sf).select("event_id", "score")).drop("score")


@query(
    "reason_codes",
    with_tx("SELECT event_id, array_to_string(reason_codes, ',') AS reasons FROM outcome", OUTCOME_SQL),
)
def reason_codes(spark, sf):
    return outcomes(spark, sf).select("event_id", F.array_join("reason_codes", ",").alias("reasons"))


@query(
    "reason_counts",
    with_tx("SELECT reason, count(*) AS n FROM (SELECT unnest(reason_codes) AS reason FROM outcome) GROUP BY 1", OUTCOME_SQL),
)
def reason_counts(spark, sf):
    return pol.reason_counts(outcomes(spark, sf))


@query(
    "thresholds",
    with_tx(
        """SELECT event_id, round(review, 6) AS review,
           round(CASE WHEN block <= review THEN least(review + 0.05, 0.99) ELSE block END, 6) AS block,
           round(greatest(0.65, score), 6) AS training_review,
           round(least(greatest(greatest(0.65, score) + 0.15, 0.9), 0.99), 6) AS training_block
           FROM (SELECT *, least(greatest(0.9, round(review + 0.15, 4)), 0.99) AS block
                 FROM (SELECT *, least(greatest(0.65, score), 0.95) AS review FROM tx))"""
    ),
)
def thresholds(spark, sf):
    df = tx(spark, sf).select("event_id", "score")
    review, block = pol.derive_thresholds(F.col("score"))
    t_review, t_block = pol.derive_thresholds_training(F.col("score"))
    return rounded(
        df.select(
            "event_id", review.alias("review"), block.alias("block"),
            t_review.alias("training_review"), t_block.alias("training_block"),
        )
    )


@query(
    "hard_label",
    with_tx("SELECT event_id, CAST(score >= 0.5 AS INT) AS predicted FROM tx"),
)
def hard_label(spark, sf):
    return tx(spark, sf).select("event_id", pol.hard_label(F.col("score"), 0.5).alias("predicted"))


@query(
    "policy_by_region",
    with_tx(
        """SELECT event_id, review AS threshold_review, block AS threshold_block,
           CASE WHEN score >= block THEN 'BLOCK' WHEN score >= review THEN 'REVIEW' ELSE 'CLEAR' END AS verdict,
           CASE WHEN score >= block THEN 'high' WHEN score >= review THEN 'medium' ELSE 'low' END AS risk_band
           FROM (SELECT *, CASE WHEN n_regionkey = 1 THEN 0.5 ELSE 0.65 END::DOUBLE AS review,
                           CASE WHEN n_regionkey = 1 THEN 0.8 ELSE 0.9 END::DOUBLE AS block
                 FROM tx JOIN nation ON loc_country = 'N' || n_nationkey)"""
    ),
)
def policy_by_region(spark, sf):
    from ledgerlens.plans.base import table

    cuts = table(spark, sf, "nation").where("n_regionkey = 1").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("loc_country"),
        F.lit(0.5).alias("review"),
        F.lit(0.8).alias("block"),
    )
    out = pol.policy_by_region(tx(spark, sf).select("event_id", "loc_country", "score"), cuts)
    return out.select("event_id", "threshold_review", "threshold_block", "verdict", "risk_band")


@query(
    "top_contributors",
    with_tx(
        """SELECT event_id, array_to_string(list_transform(list_sort([
             {'s': -abs(amount / 10000), 'n': 'amount'}, {'s': -abs(risk_risk_score / 100), 'n': 'risk_risk_score'},
             {'s': -abs(risk_customer_risk_score / 120), 'n': 'risk_customer_risk_score'},
             {'s': -abs(risk_amount_vs_average / 3), 'n': 'risk_amount_vs_average'}])[1:2], lambda p: p.n), ',') AS top
           FROM tx"""
    ),
)
def top_contributors(spark, sf):
    parts = {
        "amount": F.col("amount") / 10000,
        "risk_risk_score": F.col("risk_risk_score") / 100,
        "risk_customer_risk_score": F.col("risk_customer_risk_score") / 120,
        "risk_amount_vs_average": F.col("risk_amount_vs_average") / 3,
    }
    return tx(spark, sf).select("event_id", F.array_join(pol.top_contributors(parts, 2), ",").alias("top"))
