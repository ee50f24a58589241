"""Exploratory, record-keeping and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import policy as pol
from ledgerlens.operators import profiling as prof
from ledgerlens.operators import records as rec
from ledgerlens.operators.validation import split_valid
from ledgerlens.plans.base import ALERTS_SQL, OUTCOME_SQL, query, rounded, tx, with_tx
from ledgerlens.plans.scoring import _ERR, outcomes, raw_lines
from ledgerlens.schema import MODEL_VERSION, POLICY_VERSION, Policy

LABEL = "isMoneyLaundering"
Y = '"isMoneyLaundering"'
VERDICT_SQL = """CASE WHEN score >= 0.9 THEN 'BLOCK' WHEN score >= 0.65 THEN 'REVIEW' ELSE 'CLEAR' END"""


@query(
    "narrow_types",
    with_tx(
        """SELECT * FROM (VALUES ('amount', 'float', false), ('event_id', 'string', false), ('hour', 'tinyint', false),
             ('nameDest', 'string', true), ('nameOrig', 'string', true), ('score', 'float', false),
             ('step', 'smallint', false), ('total', 'double', false), ('type', 'string', true))
             v(column_name, narrowest, dict_encode)"""
    ).replace("v(column_name,", 'v("column",'),
)
def narrow_types(spark, sf):
    df = tx(spark, sf).select(
        "event_id", "nameOrig", "nameDest", "type", "step", F.hour("timestamp").cast("bigint").alias("hour"),
        F.floor("amount").cast("double").alias("amount"), "score", (F.col("amount") * 1e9 + 0.1).alias("total"),
    )
    return prof.narrow_types(df)


@query(
    "profile_columns",
    with_tx(
        """SELECT "column", CASE WHEN n > 8 THEN 'high_card' WHEN "column" LIKE '%risk%' THEN 'ordinal' ELSE 'low_card' END AS role,
           CASE WHEN n > 8 THEN -1 ELSE n END AS distinct_values, n <= 8 AND "column" LIKE '%risk%' AS dual
           FROM (SELECT unnest(['type', 'category', 'nameOrig', 'nameDest', 'risk_category_risk', 'payment_method']) AS "column",
                        unnest([count(DISTINCT type), count(DISTINCT category), count(DISTINCT "nameOrig"),
                                count(DISTINCT "nameDest"), count(DISTINCT risk_category_risk), count(DISTINCT payment_method)]) AS n
                 FROM tx)"""
    ),
)
def profile_columns(spark, sf):
    cols = ["type", "category", "nameOrig", "nameDest", "risk_category_risk", "payment_method"]
    return prof.profile_columns(tx(spark, sf), cols).fillna(-1, ["distinct_values"])


@query(
    "missing_counts",
    with_tx(
        """SELECT 'payment_method' AS "column", count(*) AS missing FROM tx WHERE payment_method IS NULL
           UNION ALL SELECT 'ratio', count(*) FROM tx WHERE "oldbalanceOrg" = 0"""
    ),
)
def missing_counts(spark, sf):
    ratio = F.try_divide(F.col("amount"), F.col("oldbalanceOrg"))
    return prof.missing_counts(tx(spark, sf).withColumn("ratio", ratio))


@query(
    "describe_numeric",
    with_tx(
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
                round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS q50,
                round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM tx"""
            for c in ("amount", '"oldbalanceOrg"', "risk_risk_score")
        ).replace("'\"oldbalanceOrg\"'", "'oldbalanceOrg'")
    ),
)
def describe_numeric(spark, sf):
    return rounded(prof.describe_numeric(tx(spark, sf), ["amount", "oldbalanceOrg", "risk_risk_score"]), 6)


@query(
    "class_share",
    with_tx(f"SELECT {Y} AS class, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM tx), 6) AS share FROM tx GROUP BY 1"),
)
def class_share(spark, sf):
    return rounded(prof.class_share(tx(spark, sf), LABEL))


@query(
    "type_stats",
    with_tx(f"SELECT type, count(*) AS tx_count, round(avg({Y}), 6) AS laundering_rate FROM tx GROUP BY 1"),
)
def type_stats(spark, sf):
    return rounded(prof.type_stats(tx(spark, sf), LABEL))


@query(
    "hourly_profile",
    with_tx(f"SELECT CAST(hour(ts) AS INT) AS hour, round(avg({Y}), 6) AS laundering_rate, count(*) AS volume FROM tx GROUP BY 1"),
)
def hourly_profile(spark, sf):
    return rounded(prof.hourly_profile(tx(spark, sf).withColumn("hour", F.hour("timestamp")), LABEL))


@query(
    "user_view",
    with_tx(
        f"""SELECT "nameOrig", count(*) AS tx_count, CAST(sum({Y}) AS BIGINT) AS laundering_cases,
            round(avg({Y}), 6) AS laundering_rate, round(avg(amount), 4) AS avg_amount,
            count(DISTINCT "nameDest") AS unique_merchants, count(DISTINCT device_type) AS device_diversity
            FROM tx GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"""
    ),
)
def user_view(spark, sf):
    out = prof.user_view(tx(spark, sf), LABEL)
    return rounded(out.withColumn("avg_amount", F.round("avg_amount", 4)))


@query(
    "amount_histogram",
    with_tx(
        f"""SELECT class, bin, count(*) AS n, round(count(*) / (max(total) * max(width)), 6) AS density FROM (
              SELECT *, CAST(least(floor((x - lo) / width), 49) AS INT) AS bin, count(*) OVER (PARTITION BY class) AS total
              FROM (SELECT *, (max(x) OVER () - min(x) OVER ()) / 50 AS width, min(x) OVER () AS lo
                    FROM (SELECT {Y} AS class, log10(amount + 1) AS x FROM tx))) GROUP BY 1, 2"""
    ),
)
def amount_histogram(spark, sf):
    return rounded(prof.amount_histogram(tx(spark, sf), LABEL))


@query(
    "user_features",
    with_tx(
        """SELECT t.event_id, user_tx_count, round(m, 4) AS user_amount_median, round(s, 4) AS user_amount_std,
           round(amount / (m + 1e-3), 4) AS amt_to_user_median, user_unique_merchants, user_device_diversity
           FROM tx t JOIN (SELECT "nameOrig", count(*) AS user_tx_count, median(amount) AS m,
                coalesce(stddev_samp(amount), 0) AS s, count(DISTINCT "nameDest") AS user_unique_merchants,
                count(DISTINCT device_type) AS user_device_diversity FROM tx GROUP BY 1) u USING ("nameOrig")"""
    ),
)
def user_features(spark, sf):
    out = prof.user_features(tx(spark, sf))
    return rounded(
        out.select(
            "event_id", "user_tx_count", "user_amount_median", "user_amount_std", "amt_to_user_median",
            "user_unique_merchants", "user_device_diversity",
        ),
        4,
    )


@query(
    "merchant_features",
    with_tx(
        """SELECT event_id, count(*) OVER w AS merchant_tx_count, round(amount / (avg(amount) OVER w + 1e-3), 6) AS amt_to_merchant_avg
           FROM tx WINDOW w AS (PARTITION BY merch_merchant_id)"""
    ),
)
def merchant_features(spark, sf):
    out = prof.merchant_features(tx(spark, sf))
    return rounded(out.select("event_id", "merchant_tx_count", "amt_to_merchant_avg"))


@query(
    "ip_features",
    with_tx("SELECT event_id, count(*) OVER (PARTITION BY device_ip_address) AS ip_activity_rank FROM tx"),
)
def ip_features(spark, sf):
    return prof.ip_features(tx(spark, sf)).select("event_id", "ip_activity_rank")


_DRIFT_CELLS = """cells AS (
    SELECT CAST(greatest(least(floor((x - lo) / width), 9), 0) AS INT) AS bin,
           count(*) FILTER (period = 'base') AS b, count(*) FILTER (period = 'current') AS c
    FROM (SELECT *, min(CASE WHEN period = 'base' THEN x END) OVER () AS lo,
                 (max(CASE WHEN period = 'base' THEN x END) OVER () - min(CASE WHEN period = 'base' THEN x END) OVER ()) / 10 AS width
          FROM (SELECT score AS x, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'current' END AS period FROM tx))
    GROUP BY 1),
  sh AS (SELECT greatest(b / sum(b) OVER (), 1e-6) AS p, greatest(c / sum(c) OVER (), 1e-6) AS q FROM cells)"""


def _periods(spark, sf) -> DataFrame:
    cut = F.lit("2024-01-16").cast("timestamp")
    return tx(spark, sf).withColumn("period", F.when(F.col("timestamp") < cut, "base").otherwise("current"))


@query(
    "psi_drift",
    with_tx(
        """SELECT round(sum((q - p) * ln(q / p)), 6) AS psi,
           round(sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 6) AS js FROM sh""",
        _DRIFT_CELLS,
    ),
)
def psi_drift(spark, sf):
    return rounded(prof.drift(_periods(spark, sf), "score", "period"))


@query(
    "rare_share_drift",
    with_tx(
        """SELECT round(sum(CASE WHEN b < 50 THEN c ELSE 0 END) / sum(c), 6) AS rare_share,
           round(sum(CASE WHEN b = 0 THEN c ELSE 0 END) / sum(c), 6) AS unseen_share
           FROM (SELECT "nameDest", count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS b,
                        count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS c FROM tx GROUP BY 1)"""
    ),
)
def rare_share_drift(spark, sf):
    return rounded(prof.category_drift(_periods(spark, sf), "nameDest", "period", 50))


def _parts() -> dict:
    return {
        "amount": F.col("amount") / 10000,
        "risk_risk_score": (F.col("risk_risk_score") - 50) / 100,
        "customer_label_rate": F.col("risk_customer_risk_score") / 120,
    }


@query(
    "global_importance",
    with_tx(
        """SELECT feature, round(importance, 6) AS importance, round(importance / max(importance) OVER (), 6) AS imp_norm
           FROM (SELECT unnest(['amount', 'risk_risk_score', 'customer_label_rate']) AS feature,
                        unnest([avg(abs(amount / 10000)), avg(abs((risk_risk_score - 50) / 100)),
                                avg(abs(risk_customer_risk_score / 120))]) AS importance FROM tx)"""
    ),
)
def global_importance(spark, sf):
    return rounded(prof.global_importance(tx(spark, sf), _parts()))


@query(
    "flag_suspicious",
    with_tx(
        """SELECT feature, round(importance / sum(importance) OVER (), 6) AS imp_norm, feature = 'customer_label_rate' AS suspicious
           FROM (SELECT unnest(['amount', 'risk_risk_score', 'customer_label_rate']) AS feature,
                        unnest([avg(abs(amount / 10000)), avg(abs((risk_risk_score - 50) / 100)),
                                avg(abs(risk_customer_risk_score / 120))]) AS importance FROM tx)"""
    ),
)
def flag_suspicious(spark, sf):
    out = prof.global_importance(tx(spark, sf), _parts(), normalize="sum")
    return rounded(prof.flag_suspicious(out).drop("importance"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction rows as the scorer writes them, at event time."""
    pol_ = Policy()
    out = outcomes(spark, sf).withColumns(
        {
            "model_version": F.lit(MODEL_VERSION),
            "policy_version": F.lit(POLICY_VERSION),
            "threshold_review": F.lit(pol_.review),
            "threshold_block": F.lit(pol_.block),
        }
    )
    # prediction_rows keeps a fixed layout; time and latency ride along as columns.
    return rec.prediction_rows(out, F.col("timestamp"), F.col("latency_ms"))


def quick_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions without reasons: what the counting queries need."""
    df = pol.apply_policy(tx(spark, sf))
    return df.select(
        "event_id", F.col("timestamp").alias("created_at"), "score", "verdict", "risk_band",
        F.lit(POLICY_VERSION).alias("policy_version"), F.col("latency_ms").alias("processing_latency_ms"),
        F.lit("[]").alias("reason_codes_json"),
    )


@query(
    "alerts",
    with_tx(
        """SELECT alert_id, event_id, epoch_us(created_at) AS created_us, status, verdict, round(score, 6) AS score, reasons FROM alerts""",
        ALERTS_SQL,
    ),
)
def alerts(spark, sf):
    out = rec.alert_rows(predictions(spark, sf))
    codes = F.from_json("reason_codes_json", "array<string>")
    return rounded(
        out.select(
            "alert_id", "event_id", F.unix_micros("created_at").alias("created_us"), "status", "verdict", "score",
            F.array_join(codes, ",").alias("reasons"),
        )
    )


@query(
    "upsert_latest",
    with_tx(
        """SELECT "nameOrig", event_id, round(amount, 6) AS amount, epoch_us(ts) AS us FROM (
             SELECT *, row_number() OVER (PARTITION BY "nameOrig" ORDER BY ts DESC, event_id DESC) AS rn FROM tx) WHERE rn = 1"""
    ),
)
def upsert_latest(spark, sf):
    df = tx(spark, sf).select("nameOrig", "event_id", "amount", "timestamp")
    out = rec.latest_per_key(df, "nameOrig", ["timestamp", "event_id"])
    return rounded(out.withColumn("us", F.unix_micros("timestamp")).drop("timestamp"))


@query("dedupe", with_tx("""SELECT DISTINCT "nameOrig", type FROM tx"""))
def dedupe(spark, sf):
    return rec.dedupe(tx(spark, sf).select("nameOrig", "type"))


SIMPLE_ALERTS_SQL = f"""al AS (
  SELECT sha256(event_id || '|policy_v1') AS alert_id, event_id, ts AS created_at, {VERDICT_SQL} AS verdict, score,
         CAST(risk_risk_score AS INT) AS k FROM tx WHERE score >= 0.65),
  rs AS (SELECT alert_id, 'TRUE_POSITIVE' AS resolution, created_at + INTERVAL 1 HOUR AS done FROM al WHERE k % 3 = 0
         UNION ALL SELECT alert_id, 'FALSE_POSITIVE', created_at + INTERVAL 2 HOUR FROM al WHERE k % 6 = 0),
  ra AS (SELECT al.*, l.resolution, l.done, CASE WHEN l.done IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS status
         FROM al LEFT JOIN (SELECT alert_id, max_by(resolution, done) AS resolution, max(done) AS done FROM rs GROUP BY 1) l USING (alert_id))"""


def resolution_log(alerts_df: DataFrame) -> DataFrame:
    """Analyst decisions: a third of the alerts resolved, a sixth a second time; some ids unknown."""
    k = F.col("k")
    decision = lambda res, hours, test: F.when(
        test,
        F.struct(
            F.lit(res).alias("resolution"),
            F.expr(f"created_at + INTERVAL {hours} HOURS").alias("resolved_at"),
        ),
    )
    both = F.array_compact(
        F.array(decision("TRUE_POSITIVE", 1, k % 3 == 0), decision("FALSE_POSITIVE", 2, k % 6 == 0))
    )
    known = alerts_df.select("alert_id", F.inline(both))
    unknown = alerts_df.where(k % 5 == 0).select(
        F.concat(F.lit("no-"), "alert_id").alias("alert_id"),
        F.lit("ESCALATED").alias("resolution"),
        F.col("created_at").alias("resolved_at"),
    )
    return known.unionByName(unknown).withColumns(
        {"analyst_id": F.lit("analyst-1"), "analyst_comment": F.lit(None).cast("string")}
    )


def _alerts_with_k(spark, sf) -> DataFrame:
    rows = rec.alert_rows(quick_predictions(spark, sf))
    k = tx(spark, sf).select("event_id", F.col("risk_risk_score").cast("int").alias("k"))
    return rows.join(k, "event_id")


def resolved_alerts(spark, sf) -> DataFrame:
    al = _alerts_with_k(spark, sf)
    return rec.with_resolutions(al, resolution_log(al))


@query(
    "resolve_alerts",
    with_tx("SELECT alert_id, status, coalesce(resolution, '') AS analyst_resolution, coalesce(epoch_us(done), -1) AS resolved_us FROM ra", SIMPLE_ALERTS_SQL),
)
def resolve_alerts(spark, sf):
    return resolved_alerts(spark, sf).select(
        "alert_id", "status", F.coalesce("analyst_resolution", F.lit("")).alias("analyst_resolution"),
        F.coalesce(F.unix_micros("resolved_at"), F.lit(-1)).alias("resolved_us"),
    )


@query(
    "unmatched_resolutions",
    with_tx("SELECT 'no-' || alert_id AS alert_id FROM al WHERE k % 5 = 0", SIMPLE_ALERTS_SQL),
)
def unmatched_resolutions(spark, sf):
    al = _alerts_with_k(spark, sf)
    return rec.unmatched_resolutions(al, resolution_log(al)).select("alert_id")


@query(
    "list_alerts",
    with_tx(
        "SELECT alert_id, event_id, epoch_us(created_at) AS created_us, verdict, status FROM ra WHERE status = 'OPEN' ORDER BY created_at DESC, alert_id LIMIT 50",
        SIMPLE_ALERTS_SQL,
    ),
)
def list_alerts(spark, sf):
    return rec.list_alerts(resolved_alerts(spark, sf), "OPEN", 50).select(
        "alert_id", "event_id", F.unix_micros("created_at").alias("created_us"), "verdict", "status"
    )


@query(
    "recent_predictions",
    with_tx(f"SELECT event_id, round(score, 6) AS score, {VERDICT_SQL} AS verdict, epoch_us(ts) AS created_us FROM tx ORDER BY ts DESC, event_id LIMIT 10"),
)
def recent_predictions(spark, sf):
    out = rec.recent(quick_predictions(spark, sf), "created_at", "event_id", 10)
    return rounded(out.select("event_id", "score", "verdict", F.unix_micros("created_at").alias("created_us")))


@query(
    "alert_quality",
    with_tx(
        """SELECT count(*) AS resolved, round(count(*) FILTER (resolution = 'TRUE_POSITIVE') / count(*), 6) AS detection_rate,
           round(count(*) FILTER (resolution = 'FALSE_POSITIVE') / count(*), 6) AS false_positive_rate
           FROM ra WHERE status = 'RESOLVED'""",
        SIMPLE_ALERTS_SQL,
    ),
)
def alert_quality(spark, sf):
    return rounded(rec.alert_quality(resolved_alerts(spark, sf)))


@query(
    "feedback_labels",
    with_tx(
        f"""SELECT t.event_id, CASE resolution WHEN 'TRUE_POSITIVE' THEN 1 WHEN 'FALSE_POSITIVE' THEN 0 ELSE {Y} END AS {Y}
            FROM tx t LEFT JOIN ra USING (event_id)""",
        SIMPLE_ALERTS_SQL,
    ),
)
def feedback_labels(spark, sf):
    df = tx(spark, sf).select("event_id", LABEL)
    return rec.feedback_labels(df, resolved_alerts(spark, sf), LABEL)


@query(
    "alert_budget",
    with_tx(
        """SELECT alert_id, "nameDest" FROM (SELECT *, row_number() OVER (PARTITION BY "nameDest", CAST(created_at AS DATE)
             ORDER BY score DESC, event_id) AS rn FROM al JOIN (SELECT event_id, "nameDest" FROM tx) USING (event_id)) WHERE rn <= 2""",
        SIMPLE_ALERTS_SQL,
    ),
)
def alert_budget(spark, sf):
    rows = rec.alert_rows(quick_predictions(spark, sf)).join(tx(spark, sf).select("event_id", "nameDest"), "event_id")
    return rec.alert_budget(rows, "nameDest", 2).select("alert_id", "nameDest")


@query(
    "event_bundle",
    with_tx(
        f"""SELECT event_id, k % 4 <> 1 AS has_raw, CASE WHEN k % 3 <> 1 THEN {VERDICT_SQL} ELSE '' END AS verdict,
            k % 2 = 0 AS has_features, CAST(CASE WHEN score >= 0.65 THEN 1 ELSE 0 END AS INT) AS n_alerts,
            CASE WHEN score >= 0.65 THEN sha256(event_id || '|policy_v1') ELSE '' END AS newest_alert
            FROM (SELECT *, CAST(risk_risk_score AS INT) AS k FROM tx) WHERE k % 4 <> 1 OR k % 3 <> 1"""
    ),
)
def event_bundle(spark, sf):
    """Events whose raw row, prediction or snapshot is missing in known places."""
    base = tx(spark, sf).withColumns({"k": F.col("risk_risk_score").cast("int"), "source": F.lit("api"), "ingested_at": F.col("timestamp")})
    raw = rec.raw_event_rows(base.where("k % 4 <> 1"), ["event_id", "amount"])
    feats = rec.snapshot_rows(base.where("k % 2 = 0"), ["amount"], ["score"], F.col("timestamp"))
    preds = quick_predictions(spark, sf)
    kept = preds.join(base.where("k % 3 <> 1").select("event_id"), "event_id", "left_semi")
    out = rec.event_bundle(raw, kept, feats, rec.alert_rows(preds))
    return out.select(
        "event_id",
        F.col("raw_event").isNotNull().alias("has_raw"),
        F.coalesce("prediction.verdict", F.lit("")).alias("verdict"),
        F.col("feature_json").isNotNull().alias("has_features"),
        F.size("alerts").alias("n_alerts"),
        F.coalesce(F.try_element_at(F.col("alerts.alert_id"), F.lit(1)), F.lit("")).alias("newest_alert"),
    )


P95_SQL = """lat AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) AS i, count(*) OVER () AS n FROM tx),
  pq AS (SELECT *, greatest(least(19 * (n + 1) // 20, n - 1), 1) AS j FROM lat),
  p95 AS (SELECT (max(CASE WHEN i = j THEN v END) * (20 - (19 * (max(n) + 1) - 20 * max(j)))
                  + max(CASE WHEN i = j + 1 THEN v END) * (19 * (max(n) + 1) - 20 * max(j))) / 20 AS p95 FROM pq)"""


@query("p95_exclusive", with_tx("SELECT round(p95, 6) AS p95 FROM p95", P95_SQL))
def p95_exclusive(spark, sf):
    return rounded(rec.exclusive_p95(tx(spark, sf), "latency_ms"))


@query(
    "monitoring_summary",
    with_tx(
        f"""SELECT (SELECT count(*) FROM tx) AS total_events, (SELECT count(*) FROM tx) AS total_predictions,
            (SELECT count(*) FROM ra WHERE status = 'OPEN') AS open_alerts,
            (SELECT count(*) FROM tx WHERE {_ERR} <> '') AS dead_letter_events,
            (SELECT round(avg(score), 6) FROM tx) AS average_score, (SELECT round(avg(latency_ms), 6) FROM tx) AS average_latency_ms,
            (SELECT round(p95, 6) FROM p95) AS p95_latency_ms,
            (SELECT string_agg(verdict || '=' || n, ',' ORDER BY verdict) FROM (SELECT {VERDICT_SQL} AS verdict, count(*) AS n FROM tx GROUP BY 1)) AS verdict_counts""",
        SIMPLE_ALERTS_SQL,
        P95_SQL,
    ),
)
def monitoring_summary(spark, sf):
    base = tx(spark, sf)
    _, dead = split_valid(raw_lines(spark, sf))
    out = rec.monitoring_summary(base, quick_predictions(spark, sf), resolved_alerts(spark, sf), dead)
    shown = F.array_join(
        F.transform(F.map_entries("verdict_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return rounded(out.withColumn("verdict_counts", shown))


@query(
    "runtime_counters",
    with_tx(
        f"""SELECT count(v) AS requests_total, count(*) - count(v) AS errors_total,
            round(avg(CASE WHEN v IS NOT NULL THEN latency_ms END) / 1000, 6) AS latency_seconds_avg,
            count(*) FILTER (v = 'BLOCK') AS block_total
            FROM (SELECT *, CASE WHEN CAST(risk_risk_score AS INT) % 19 <> 5 THEN {VERDICT_SQL} END AS v FROM tx)"""
    ),
)
def runtime_counters(spark, sf):
    df = pol.apply_policy(tx(spark, sf))
    seen = df.withColumn("verdict", F.when(F.col("risk_risk_score").cast("int") % 19 != 5, F.col("verdict")))
    out = rec.runtime_counters(seen)
    return rounded(out.withColumn("block_total", F.col("verdict_total")["BLOCK"]).drop("verdict_total"))


@query("verdict_counts", with_tx(f"SELECT {VERDICT_SQL} AS verdict, count(*) AS n FROM tx GROUP BY 1"))
def verdict_counts(spark, sf):
    return rec.verdict_counts(quick_predictions(spark, sf))


@query(
    "replay_summary",
    with_tx("SELECT count(*) AS processed, count(*) FILTER (verdict <> 'CLEAR') AS alerts FROM outcome", OUTCOME_SQL),
)
def replay_summary(spark, sf):
    return rec.replay_summary(outcomes(spark, sf))
