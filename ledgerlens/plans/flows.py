"""Source, sink, streaming and synthesis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import policy as pol
from ledgerlens.operators import synthesis as syn
from ledgerlens.operators import validation as val
from ledgerlens.plans.base import (
    FEAT_SQL,
    OUTCOME_SQL,
    REASONS_SQL,
    VEL_SQL,
    query,
    rounded,
    tx,
    with_tx,
)
from ledgerlens.plans.scoring import _ERR, _K, _payload, outcomes, raw_lines
from ledgerlens.session import scratch_path
from ledgerlens.sources import sinks
from ledgerlens.sources import tables as src
from ledgerlens.streaming.scoring import linear_scorer, run_stream, score_lines

LABEL = "isMoneyLaundering"
RAW = ["step", "type", "amount", "category", "nameOrig", "nameDest", "oldbalanceOrg", "newbalanceOrig"]


def _csv(spark: SparkSession, sf: str, *drop: str) -> str:
    path = scratch_path(spark, "csv")
    rows = tx(spark, sf).select(*RAW, LABEL, _payload(), "event_id").drop(*drop)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "scan_csv",
    with_tx(
        f"""SELECT event_id, step, type, round(amount, 6) AS amount, "nameOrig", "isMoneyLaundering" AS label,
            {_K} % 29 <> 3 AND {_K} % 7 <> 0 AS has_merchant FROM tx"""
    ),
)
def scan_csv(spark, sf):
    """Transactions written as CSV (payload text with commas and quotes) and read back."""
    df = src.read_transactions_csv(spark, _csv(spark, sf))
    return rounded(
        df.select(
            "event_id", "step", "type", "amount", "nameOrig", F.col(LABEL).alias("label"),
            F.col("metadata").contains("merchant_info").alias("has_merchant"),
        )
    )


@query(
    "training_frame",
    with_tx(
        """SELECT 'isMoneyLaundering' AS target, count(*) AS n, CAST(sum("isMoneyLaundering") AS BIGINT) AS positives FROM tx"""
    ),
)
def training_frame(spark, sf):
    """The Parquet file exists but lacks the label, so the CSV is used."""
    unlabelled = scratch_path(spark, "processed")
    tx(spark, sf).select(*RAW).write.parquet(unlabelled)
    df, target = src.training_frame(spark, unlabelled, _csv(spark, sf))
    return df.agg(
        F.lit(target).alias("target"), F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("positives")
    )


def _lines_dir(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "lines")
    sinks.write_lines(raw_lines(spark, sf), path)
    return path


@query(
    "scan_jsonl",
    with_tx(f"SELECT {_K} % 19 = 5 AS broken, count(*) AS n FROM tx GROUP BY 1"),
)
def scan_jsonl(spark, sf):
    lines = src.read_event_lines(spark, _lines_dir(spark, sf))
    return lines.groupBy(F.col("payload").startswith("{not").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_source",
    with_tx(f"SELECT error_message, count(*) AS n FROM (SELECT {_ERR} AS error_message FROM tx) GROUP BY 1"),
)
def stream_source(spark, sf):
    """Lines read as a stream, checked, and appended to a table."""
    out = scratch_path(spark, "checked")
    lines = src.stream_event_lines(spark, _lines_dir(spark, sf))
    checked = val.validate_events(lines).select(F.concat_ws("; ", "errors").alias("error_message"))
    stream = (
        checked.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start(out)
    )
    stream.awaitTermination()
    return spark.read.schema(checked.schema).parquet(out).groupBy("error_message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "topic_payloads",
    with_tx(
        """SELECT event_id AS key, event_id, round(score, 6) AS score, verdict,
           array_to_string(reason_codes, ',') AS reason_codes FROM outcome""",
        OUTCOME_SQL,
    ),
)
def topic_payloads(spark, sf):
    """Messages as published, decoded again."""
    df = outcomes(spark, sf).select("event_id", "score", "verdict", "reason_codes")
    messages = sinks.topic_payloads(df)
    body = F.from_json("value", df.schema)
    decoded = messages.select("key", body.alias("v")).select("key", "v.*")
    return rounded(decoded.withColumn("reason_codes", F.array_join("reason_codes", ",")))


OK_SQL = f"""ok AS (SELECT * REPLACE (CASE WHEN {_K} % 7 = 0 THEN 12.5 ELSE amount END AS amount,
    round(1 / (1 + exp(-(CASE WHEN {_K} % 7 = 0 THEN 12.5 ELSE amount END / 2500 + risk_risk_score / 100 - 4))), 9) AS score)
  FROM tx WHERE {_ERR} = '')"""
SCORED_SQL = ", ".join(
    [
        OK_SQL,
        VEL_SQL.replace("FROM tx", "FROM ok"),
        FEAT_SQL.format(src="vel"),
        f"""sd AS (SELECT *, CASE WHEN score >= 0.9 THEN 'BLOCK' WHEN score >= 0.65 THEN 'REVIEW' ELSE 'CLEAR' END AS verdict,
              {REASONS_SQL} AS hits FROM feat)""",
        """so AS (SELECT *, array_to_string(CASE WHEN len(hits) = 0 AND verdict <> 'CLEAR' THEN ['elevated_model_risk']
              ELSE hits END, ',') AS reasons FROM sd)""",
    ]
)
SCORED_OUT = "SELECT event_id, round(score, 6) AS score, verdict, reasons FROM so"


def _scorer():
    base = linear_scorer({"amount": 1 / 2500, "risk_risk_score": 1 / 100}, -4.0)
    return lambda df: base(df).withColumn("score", F.round("score", 9))


@query("score_lines", with_tx(SCORED_OUT, SCORED_SQL))
def score_lines_batch(spark, sf):
    """Replay of raw lines in batch: contract, features, state, score, reasons."""
    out = score_lines(raw_lines(spark, sf).select("payload"), _scorer())
    good = out.where(F.size("errors") == 0)
    return rounded(good.select("event_id", "score", "verdict", F.array_join("reason_codes", ",").alias("reasons")))


@query("stream_score", with_tx(SCORED_OUT, SCORED_SQL))
def stream_score(spark, sf):
    """The same lines through the streaming query; its prediction table must equal the batch."""
    root = scratch_path(spark, "tables")
    lines = src.stream_event_lines(spark, _lines_dir(spark, sf), 10_000)
    stream = run_stream(
        lines, _scorer(), root, name="stream_score", available_now=True, checkpoint=scratch_path(spark, "progress")
    )
    stream.awaitTermination()
    codes = F.from_json("reason_codes_json", "array<string>")
    done = sinks.read_table(spark, f"{root}/predictions")
    return rounded(done.select("event_id", "score", "verdict", F.array_join(codes, ",").alias("reasons")))


@query(
    "fanout",
    with_tx(
        f"""SELECT 'raw_events' AS name, count(*) AS n FROM so UNION ALL SELECT 'feature_snapshots', count(*) FROM so
            UNION ALL SELECT 'predictions', count(*) FROM so
            UNION ALL SELECT 'alerts', count(*) FROM so WHERE verdict <> 'CLEAR'
            UNION ALL SELECT 'dead_letter_events', count(*) FROM tx WHERE {_ERR} <> ''""",
        SCORED_SQL,
    ),
)
def fanout(spark, sf):
    """One batch written to all tables, twice under the same number: no row is doubled."""
    root = scratch_path(spark, "tables")
    batch = score_lines(raw_lines(spark, sf).select("payload"), _scorer())
    write = sinks.fan_out(root)
    write(batch, 7)
    write(batch, 7)
    names = ("raw_events", "feature_snapshots", "predictions", "alerts", "dead_letter_events")
    parts = [
        sinks.read_table(spark, f"{root}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "append_log",
    with_tx(
        """SELECT strftime(ts, '%Y-%m-%d') AS log_date, event_id, round(score, 6) AS score,
           CASE WHEN score >= 0.9 THEN 'BLOCK' WHEN score >= 0.65 THEN 'REVIEW' ELSE 'CLEAR' END AS verdict FROM tx"""
    ),
)
def append_log(spark, sf):
    """Daily prediction log, read back whole."""
    path = scratch_path(spark, "prediction-log")
    df = pol.apply_policy(tx(spark, sf)).select(F.col("timestamp").alias("logged_at"), "event_id", "score", "verdict")
    sinks.append_log(df, path, order="event_id")
    log = sinks.read_table(spark, path)
    return rounded(log.select(F.col("log_date").cast("string").alias("log_date"), "event_id", "score", "verdict"))


@query(
    "monitoring_json",
    with_tx(
        """SELECT count(*) AS processed, count(*) FILTER (score >= 0.65) AS alerts FROM tx"""
    ),
)
def monitoring_json(spark, sf):
    """A one-row report written as JSON and read back."""
    from ledgerlens.operators.records import replay_summary

    path = scratch_path(spark, "report")
    report = replay_summary(pol.apply_policy(tx(spark, sf)))
    sinks.write_event_lines(report, path)
    return spark.read.schema(report.schema).json(path)


@query("synthesize_events")
def synthesize_events(spark, sf):
    """Twice as many events as the seed table, a fifth of them suspicious."""
    base = tx(spark, sf)
    return syn.synthesize_events(base, 2 * base.count())


@query(
    "synthetic_lines",
    with_tx("SELECT CAST(count(*) + count(*) // 2 AS BIGINT) AS n, CAST(count(*) + count(*) // 2 AS BIGINT) AS valid, true AS bounds_hold FROM tx"),
)
def synthetic_lines(spark, sf):
    """Synthetic events written as JSON lines: every line meets the contract and the bounds."""
    base = tx(spark, sf)
    n = base.count()
    path = scratch_path(spark, "synthetic")
    sinks.write_event_lines(syn.as_event_lines(syn.synthesize_events(base, n + n // 2)), path)
    checked = val.validate_events(src.read_event_lines(spark, path))
    events = val.typed_events(checked)
    holds = (
        (F.col("amount") >= 1)
        & (F.col("oldbalanceOrg") >= F.col("amount"))
        & (F.col("newbalanceOrig") >= 0)
        & (F.col("metadata.risk_indicators.risk_score").try_cast("double") <= 100)
    )
    return events.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("errors") == 0).alias("valid"),
        F.bool_and(holds).alias("bounds_hold"),
    )
