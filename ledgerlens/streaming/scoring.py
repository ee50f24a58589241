"""One streaming query: lines, contract, features, activity state, score, policy, all sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerlens.functions.scalars import json_payload, lenient_timestamp, wall_clock
from ledgerlens.operators import features as feat
from ledgerlens.operators import policy as pol
from ledgerlens.operators.metadata import flatten_metadata
from ledgerlens.operators.validation import typed_events, validate_events
from ledgerlens.operators.velocity import velocity_state
from ledgerlens.schema import MODEL_VERSION, VERDICTS, Policy
from ledgerlens.session import materialize
from ledgerlens.sources.sinks import fan_out
from ledgerlens.streaming.state import velocity_stream

Scorer = Callable[[DataFrame], DataFrame]
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}
_SNAPSHOT = (
    "type", "category", "amount", "oldbalanceOrg", "newbalanceOrig", "hour", "day_of_week",
    "is_weekend", "balance_delta", "amt_to_balance", "tx_count_24h", "amount_sum_24h",
    "merchant_tx_count_24h", "risk_risk_score", "risk_customer_risk_score",
)


def prepare_events(lines: DataFrame) -> DataFrame:
    """Raw lines to flat, typed events; rejected lines stay in, with their ``errors``."""
    typed = typed_events(validate_events(lines))
    flat = flatten_metadata(typed)
    # The event time falls back to the arrival time; calendar fields follow the sender's clock.
    at = F.coalesce("timestamp", "ingested_at")
    local = F.coalesce("local_time", F.col("ingested_at").cast("timestamp_ntz"))
    flat = flat.withColumns({"timestamp": at, "local_time": local})
    calendar = {
        "hour": F.hour("local_time"),
        "day_of_week": F.weekday("local_time"),
        "day_of_month": F.dayofmonth("local_time"),
        "month": F.month("local_time"),
    }
    flat = flat.withColumns({n: F.coalesce(F.col(n), c) for n, c in calendar.items()})
    out = flat.transform(feat.time_features).transform(feat.balance_features)
    bad = F.size("errors") > 0
    return out.withColumn("timestamp", F.when(~bad, F.col("timestamp"))).drop("local_time")


def decide(df: DataFrame, scorer: Scorer, policy: Policy, model_version: str = MODEL_VERSION) -> DataFrame:
    """Score, verdict, reasons and snapshot of prepared events with their activity."""
    scored = scorer(df)
    decided = pol.add_reasons(pol.apply_policy(scored, policy))
    encoded = [c for c in scored.columns if "__" in c] or ["score"]
    return decided.withColumns(
        {
            "model_version": F.lit(model_version),
            "policy_version": F.lit(policy.version),
            "threshold_review": F.lit(policy.review),
            "threshold_block": F.lit(policy.block),
            "feature_json": json_payload(*[c for c in _SNAPSHOT if c in scored.columns]),
            "encoded_json": json_payload(*encoded),
            "scored_at": F.col("timestamp"),
            "processing_latency_ms": F.greatest(
                (F.unix_micros(F.current_timestamp()) - F.unix_micros("ingested_at")) / 1000.0, F.lit(0.0)
            ),
        }
    )


def score_lines(lines: DataFrame, scorer: Scorer, policy: Policy = Policy(), rows_per_task: int | None = None) -> DataFrame:
    """Batch form, for replays of any size: valid events with their outcome, rejects with errors.

    Lines are parsed once and written in columns: the state needs several passes (group sizes,
    two keys, rejects), and each of them then reads only its columns.
    """
    prepared = materialize(prepare_events(lines), "events")
    good = prepared.where(F.size("errors") == 0)
    bad = prepared.where(F.size("errors") > 0)
    extra = {"rows_per_task": rows_per_task} if rows_per_task else {}
    active = velocity_state(good, **extra).withColumn("is_late", F.lit(False))
    idle = bad.withColumns(
        {
            "tx_count_24h": F.lit(0).cast("bigint"),
            "amount_sum_24h": F.lit(0.0),
            "merchant_tx_count_24h": F.lit(0).cast("bigint"),
            "is_late": F.lit(False),
        }
    )
    return decide(active.unionByName(idle), scorer, policy)


_DERIVED = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "balance_delta", "amt_to_balance")
# How long a delivered event is remembered: the counters' lifetime and the lateness that is expected.
ONCE = "25 hours"


def score_stream(lines: DataFrame, scorer: Scorer, policy: Policy = Policy(), once: str | None = ONCE) -> DataFrame:
    """Streaming form of :func:`score_lines`; a valid event that is delivered again within ``once`` is scored once."""
    valid = F.when(F.size("errors") == 0, F.col("event_id"))
    # What other columns give is left out of the state's shuffles and derived again behind them.
    events = prepare_events(lines).drop(*_DERIVED)
    active = velocity_stream(events, once=once, once_key=valid)
    return decide(feat.balance_features(feat.time_features(active, time_col="")), scorer, policy)


# Metrics of every batch of the running query, under this name.
COUNTERS = "outcomes"


def counted(scored: DataFrame) -> DataFrame:
    """The same rows, observed: each batch reports successes, errors, late events and verdicts."""
    good = F.size("errors") == 0
    verdicts = [F.count_if(good & (F.col("verdict") == v)).alias(f"verdict_{v}") for v in VERDICTS]
    return scored.observe(
        COUNTERS, F.count_if(good).alias("success"), F.count_if(~good).alias("error"), F.count_if(F.col("is_late")).alias("late"), *verdicts
    )


def reported(progresses) -> dict[str, int]:
    """Sums over batches of what they observed; of a batch that was reported more than once, the last."""
    batches = {}
    for p in progresses:
        row = (p.observedMetrics or {}).get(COUNTERS)
        if row is not None:
            batches[p.batchId] = row.asDict()
    out: dict[str, int] = {}
    for batch in batches.values():
        for key, value in batch.items():
            out[key] = out.get(key, 0) + value
    return out


class CounterListener(StreamingQueryListener):
    """Adds up what the batches of running queries report, by query name; a batch counts once."""

    def __init__(self) -> None:
        self.batches: dict[str, dict[int, dict[str, int]]] = {}

    def totals(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for batch in self.batches.get(name, {}).values():
            for key, value in batch.items():
                out[key] = out.get(key, 0) + value
        return out

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(event.name or str(event.id), {})

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = (progress.observedMetrics or {}).get(COUNTERS)
        if row is not None:
            self.batches.setdefault(progress.name or str(progress.id), {})[progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def live_profiles(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(key, n, amount, last_at): the counters in the state store of a stream, as of its last batch.

    ``operator`` counts the stream's stateful operators; see :func:`profile_operators`.
    """
    stored = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "activity").load(checkpoint)
    return stored.select(
        F.col("key").getField("state_key").alias("key"),
        F.col("value.n").alias("n"),
        (F.col("value.micros") / 1_000_000).alias("amount"),
        F.timestamp_micros("value.last_us").alias("last_at"),
    )


def profile_operators(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the stateful operators that hold counters: the customers' first, then the merchants'."""
    found = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName").distinct()
    # Operators are numbered from the sink on.
    return sorted((r["operatorId"] for r in found.collect() if "transformWithState" in r["operatorName"]), reverse=True)


def run_stream(
    lines: DataFrame,
    scorer: Scorer,
    root: str,
    checkpoint: str,
    policy: Policy = Policy(),
    name: str = "scoring",
    available_now: bool = False,
    publishers: dict | None = None,
    once: str | None = ONCE,
) -> StreamingQuery:
    """Start the query; its progress is kept below ``checkpoint``, a shared folder, and its sinks can be replayed."""
    spark = lines.sparkSession
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    writer = (
        counted(score_stream(lines, scorer, policy, once))
        .writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(fan_out(root, publishers))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def linear_scorer(weights: dict[str, float], intercept: float) -> Scorer:
    """Logistic score over feature columns, as a column expression."""

    def score(df: DataFrame) -> DataFrame:
        z: Column = F.lit(float(intercept))
        for c, w in weights.items():
            z = z + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
        return df.withColumn("score", 1 / (1 + F.exp(-z)))

    return score
