"""Hand-made edge rows."""

import json
import math
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import encoding as enc
from ledgerlens.operators import features as feat
from ledgerlens.operators import metadata as meta
from ledgerlens.operators import metrics as met
from ledgerlens.operators import policy as pol
from ledgerlens.operators import records as rec
from ledgerlens.operators import split as spl
from ledgerlens.operators import validation as val
from ledgerlens.operators import velocity as vel
from ledgerlens.schema import Policy


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_metadata_parse(spark):
    data = [
        (1, "{'timestamp': datetime.datetime(2025, 8, 1)}"),
        (2, "{'timestamp': datetime.datetime(2025, 8, 1, 9, 5)}"),
        (3, "{'timestamp': datetime.datetime(2025, 8, 1, 9, 5, 7)}"),
        (4, "{'timestamp': datetime.datetime(2025, 8, 1, 9, 5, 7, 42)}"),
        (5, "{'location': {'city': \"O'Hare True\"}, 'risk_indicators': {'unusual_time': True, 'unusual_location': False}, 'payment_method': None}"),
        (6, "garbage{"),
        (7, None),
        (8, "{'payment_method': 'a, None} b', 'merchant_info': {'avg_transaction': 12}}"),
    ]
    out = meta.parse_metadata(spark.createDataFrame(data, "id int, metadata string"))
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["metadata"]["timestamp"] for i in (1, 2, 3, 4)] == [
        "2025-08-01T00:00:00", "2025-08-01T09:05:00", "2025-08-01T09:05:07", "2025-08-01T09:05:07.000042",
    ]
    assert got[5]["metadata"]["location"]["city"] == "O'Hare True"
    assert got[5]["metadata"]["risk_indicators"]["unusual_time"] is True
    assert got[5]["metadata"]["payment_method"] is None
    assert got[6]["metadata_error"] and not got[7]["metadata_error"] and not got[5]["metadata_error"]
    assert got[8]["metadata"]["payment_method"] == "a, None} b"
    flat = meta.flatten_metadata(out.where("id in (5, 7, 8)").drop("metadata_error"))
    by_id = {r["id"]: r for r in flat.collect()}
    assert by_id[7]["loc_city"] == "Unknown" and by_id[7]["payment_method"] == "Unknown"
    assert by_id[7]["risk_risk_score"] is None and by_id[7]["risk_unusual_time"] is False
    assert by_id[8]["merch_avg_transaction"] == 12.0


def test_recover_literals(spark):
    df = spark.createDataFrame([("{'a': (1, 2)}",), ("__import__('os')",), ("nonsense",)], "metadata string")
    assert [r[0] for r in rows(meta.recover_literals(df), "metadata_json")] == ['{"a": [1, 2]}', None, None]


def test_event_validation(spark):
    ok = '"type":"T","category":"c","nameOrig":"C1","nameDest":"M1","oldbalanceOrg":1,"newbalanceOrig":0'
    lines = [
        ('{%s,"amount":5}' % ok, ""),
        ('{%s,"amount":"12.5"}' % ok, ""),
        ('{%s}' % ok, "amount: field required"),
        ('{%s,"amount":null}' % ok, "amount: invalid double"),
        ('{%s,"amount":5,"x":1}' % ok, "x: extra field"),
        ('{%s,"amount":5,"metadata":"text"}' % ok, "metadata: invalid object"),
        ('{%s,"amount":5,"hour":null}' % ok, ""),
        ('{%s,"amount":5,"step":1.5}' % ok, "step: invalid int"),
        ('{%s,"amount":5,"event_id":7}' % ok, "event_id: invalid string"),
        ('{%s,"amount":5,"ingested_at":"soon"}' % ok, "ingested_at: invalid timestamp"),
        ("not json", "payload: not JSON"),
        ("[1, 2]", "payload: not an object"),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(lines)], "i int, payload string")
    out = val.validate_events(df).select("i", F.concat_ws("; ", "errors").alias("e"))
    got = {r["i"]: r["e"] for r in out.collect()}
    assert got == {i: e for i, (_, e) in enumerate(lines)}
    good, dead = val.split_valid(df)
    assert good.count() == 3 and dead.count() == len(lines) - 3
    typed = val.typed_events(good).orderBy("i").collect()
    assert [r["amount"] for r in typed] == [5.0, 12.5, 5.0]
    assert all(r["event_id"] and r["source"] == "api" and r["step"] == 0 for r in typed)


def test_time_features(spark):
    data = [("2024-01-05 10:00:00",), ("2024-01-06 00:00:00",), ("2024-01-07 23:59:59",), ("2024-01-08 06:00:00",), (None,), ("1969-12-31 23:59:59.5",)]
    df = spark.createDataFrame(data, "t string").select(F.col("t").cast("timestamp").alias("timestamp"))
    out = feat.time_features(feat.time_columns(df))
    assert [r[0] for r in rows(out, "is_weekend")] == [0, 1, 1, 0, 0, 0]
    assert [r[0] for r in rows(out, "day_of_week")] == [4, 5, 6, 0, None, 2]
    last = out.orderBy("timestamp").collect()[0]
    assert last["hour_sin"] == 0.0 and last["dow_cos"] == 1.0  # no time counts as hour 0, Monday
    done = feat.finalize(df)
    assert rows(done, "timestamp_ts")[-1] == (-1,)


def test_event_defaults_follow_the_senders_clock(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01T01:00:00+05:00", None), (2, "2024-01-01T01:00:00Z", 9), (3, None, None)],
        "i int, event_time string, hour int",
    ).withColumn("ingested_at", F.lit("2024-03-02 04:05:06").cast("timestamp"))
    out = feat.event_defaults(df).orderBy("i")
    assert rows(out, "hour", "day_of_week", "day_of_month", "month") == [(1, 0, 1, 1), (9, 0, 1, 1), (4, 5, 2, 3)]
    assert [str(r[0]) for r in rows(out, "timestamp")][0].endswith("20:00:00")


def test_balances(spark):
    df = spark.createDataFrame(
        [(10.0, 0.0, 0.0), (10.0, None, 1.0), (10.0, -5.0, 0.0), (0.0, 4.0, 1.0)],
        "amount double, oldbalanceOrg double, newbalanceOrig double",
    )
    out = feat.balance_features(df)
    assert [r[0] for r in rows(out, "amt_to_balance")] == [0.0, 0.0, -2.0, 0.0]
    assert [r[0] for r in rows(out, "balance_delta")] == [0.0, None, -5.0, 3.0]


def events(spark, data):
    df = spark.createDataFrame(data, "event_id string, us long, nameOrig string, nameDest string, amount double")
    return df.withColumn("timestamp", F.timestamp_micros("us")).drop("us")


@pytest.mark.parametrize("per_task", [1, 2, 1000])
def test_velocity_gaps(spark, per_task):
    s = 1_000_000
    data = [("a", 0, "C", "", 1.0), ("b", 86_399 * s, "C", "M", 2.0), ("c", (86_399 + 86_400) * s, "C", "M", 4.0),
            ("d", (86_399 + 86_400 + 86_401) * s, "C", "M", 8.0)]
    out = vel.velocity_state(events(spark, data), rows_per_task=per_task).orderBy("event_id")
    assert rows(out, "tx_count_24h", "amount_sum_24h", "merchant_tx_count_24h") == [
        (0, 0.0, 0), (1, 1.0, 0), (2, 3.0, 1), (0, 0.0, 0),
    ]


def test_velocity_same_instant_counts_once_each(spark):
    data = [("a", 5, "C", "M", 1.0), ("b", 5, "C", "M", 1.0), ("c", 5, "C", "M", 1.0)]
    assert sorted(rows(vel.velocity_state(events(spark, data)), "tx_count_24h")) == [(0,), (1,), (2,)]


def test_encoder_edges(spark):
    data = [(f"e{i:03}", i, c, y) for i, (c, y) in enumerate(
        [("A", 1)] * 20 + [("B", 0)] * 19 + [(None, 1)] * 20 + [("RARE", 0)] * 20)]
    df = spark.createDataFrame(data, "event_id string, us long, c string, y int").withColumn("timestamp", F.timestamp_micros("us"))
    prior = enc.label_mean(df, "y")
    state = enc.fit_target_state(df, ["c"], "y", prior)
    assert {r["category"]: r["n"] for r in state.collect()} == {"A": 20, "nan": 20, "RARE": 39}
    new = spark.createDataFrame([("A",), ("B",), ("new",), ("RARE",), (None,)], "c string")
    got = [round(r[0], 9) for r in rows(enc.apply_target_state(new, state, ["c"], prior), "c_enc")]
    own, rare = (20 + 50 * prior) / 70, (0 + 50 * prior) / 89
    assert got == [round(own, 9), round(rare, 9), round(rare, 9), round(rare, 9), round(own, 9)]
    few = df.limit(5)
    assert {round(r[0], 9) for r in rows(enc.oof_target_encode(few, ["c"], "y"), "c_enc")} == {round(enc.label_mean(few, "y"), 9)}
    negatives = df.withColumn("y", F.lit(0))
    how = enc.TargetStats(use_logit=True)
    low = enc.fit_target_state(negatives, ["c"], "y", 0.0, how).first()["enc"]
    assert low == pytest.approx(math.log(1e-6 / (1 - 1e-6)))


def test_later_labels_do_not_reach_back(spark, tx):
    df = tx.select("event_id", "timestamp", "nameDest", F.col("isMoneyLaundering").alias("y"))
    folded = spl.time_folds(df).select("event_id", "fold").cache()
    last = folded.where("fold = 5").select("event_id")
    # Swapping labels inside the last fold keeps the overall mean.
    y = {r["event_id"]: r["y"] for r in df.join(last, "event_id").collect()}
    swapped = spark.createDataFrame(list(zip(sorted(y), [y[k] for k in sorted(y, reverse=True)])), "event_id string, z int")
    changed = df.join(swapped, "event_id", "left").withColumn("y", F.coalesce("z", "y")).drop("z")
    how = enc.TargetStats(alpha=20, min_count=3)
    a = enc.oof_target_encode(df, ["nameDest"], "y", how=how).select("event_id", F.col("nameDest_enc").alias("a"))
    b = enc.oof_target_encode(changed, ["nameDest"], "y", how=how).select("event_id", F.col("nameDest_enc").alias("b"))
    assert a.join(b, "event_id").where("abs(a - b) > 1e-12").count() == 0


def test_ordinal_and_one_hot(spark):
    codes = enc.ordinal_codes([("a", 50), ("b", 49), ("c", 60), ("d", 1)])
    assert codes == {"a": 0, "c": 1, "b": 2, "d": 2}
    seen = spark.createDataFrame([("a",)] * 50 + [("b",)] * 49 + [("c",)] * 60 + [("d",), (None,)], "v string")
    state = enc.ordinal_state(seen, ["v"])
    assert {r["category"]: r["code"] for r in state.collect()} == codes
    df = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "v string")
    got = {r["v"]: r["orig__v"] for r in enc.ordinal_encode(df, state, ["v"]).collect()}
    assert got == {"a": 0.0, "b": 2.0, "zz": -1.0, None: -1.0}
    hot = enc.one_hot(df, {"v": ["a", "b"]})
    assert rows(hot, "low_card__v_a", "low_card__v_b") == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
    tie = spark.createDataFrame([("x",), ("w",), ("x",), ("w",), ("y",)], "v string")
    assert enc.most_frequent(tie, ["v"]).first()["value"] == "w"
    with pytest.raises(ValueError):
        enc.category_lists(tie, ["v"], limit=2)


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 200])
def test_p95(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    want = statistics.quantiles(values, n=20)[-1] if n >= 2 else (values[0] if n else 0.0)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert rec.exclusive_p95(df, "v").first()["p95"] == pytest.approx(want)
    assert rec.exclusive_p95(df, "v", 7).first()["p95"] == pytest.approx(want)


def test_p95_extrapolates(spark):
    assert rec.exclusive_p95(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v").first()["p95"] == pytest.approx(2.85)


def test_verdict_bounds_and_policy(spark):
    df = spark.createDataFrame([(0.64999,), (0.65,), (0.89999,), (0.9,)], "score double")
    assert [r[0] for r in rows(pol.apply_policy(df), "verdict")] == ["CLEAR", "REVIEW", "REVIEW", "BLOCK"]
    with pytest.raises(ValueError):
        Policy(0.9, 0.9)
    assert pol.learned_policy(spark, None) == Policy(0.65, 0.9)
    assert pol.learned_policy(spark, 0.99) == Policy(0.95, 0.99)
    assert pol.learned_policy(spark, 0.8).block == 0.95


def test_reasons(spark):
    cols = "amount double, amt_to_balance double, risk_risk_score double, risk_customer_risk_score double, risk_unusual_time boolean, is_weekend int, tx_count_24h int, amount_sum_24h double, merchant_tx_count_24h int, score double"
    data = [
        (5000.0, 0.3, 70.0, 80.0, True, 1, 10, 20000.0, 20, 0.9),
        (4999.99, 0.29, 69.9, 79.9, False, 0, 9, 19999.0, 19, 0.7),
        (None, None, None, None, None, None, None, None, None, 0.1),
        (2000.0, 0.0, 0.0, 0.0, False, 1, 0, 0.0, 0, 0.1),
    ]
    out = pol.add_reasons(pol.apply_policy(spark.createDataFrame(data, cols)))
    got = [r[0] for r in rows(out, "reason_codes")]
    assert got[0] == [
        "large_amount", "high_amount_vs_balance", "high_risk_indicator", "high_customer_risk", "unusual_time",
        "weekend_high_value", "high_customer_velocity_24h", "high_customer_volume_24h", "high_merchant_velocity_24h",
        "extreme_model_score",
    ]
    assert got[1:] == [["elevated_model_risk"], [], ["weekend_high_value"]]


def test_risk_bucket(spark):
    df = spark.createDataFrame([(0.3,), (0.30001,), (0.6,), (0.61,), (None,)], "v double")
    out = df.select(feat.risk_bucket(F.col("v"), 0.5).alias("b"))
    assert [r[0] for r in out.collect()] == ["low", "medium", "medium", "high", "medium"]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (0, 0.5)], "label int, score double")
    got = met.rank_metrics(df).first()
    assert got["pr_auc"] == pytest.approx(0.8333333) and got["roc_auc"] == pytest.approx(0.8333333)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert met.rank_metrics(ties).first()["roc_auc"] == 0.5
    assert met.threshold_at_fpr(spark.createDataFrame([(0, 0.9), (1, 0.1)], "label int, score double"), max_fpr=0.5).first()["threshold"] == math.inf
    none = spark.createDataFrame([], "label int, score double")
    assert met.best_f1_threshold(none).first()["threshold"] == 0.5
    one = spark.createDataFrame([(1, 0.4)], "label int, score double")
    assert met.rank_metrics(one).first()["roc_auc"] is None
    assert met.minmax(one).first()["scaled"] == 0.0


def roc_points(data):
    """Corners of the ROC curve, by definition, from the highest score down."""
    scores = sorted({s for _, s in data}, reverse=True)
    neg = sum(1 - y for y, _ in data)
    pos = sum(y for y, _ in data)
    pts = [(t, sum(1 - y for y, s in data if s >= t), sum(y for y, s in data if s >= t)) for t in scores]
    keep = []
    for i, p in enumerate(pts):
        inner = 0 < i < len(pts) - 1
        if inner and all(pts[i + 1][k] - p[k] == p[k] - pts[i - 1][k] for k in (1, 2)):
            continue
        keep.append((p[0], p[1] / neg, p[2] / pos))
    return keep


@pytest.mark.parametrize("limit", [0.0, 0.01, 0.2, 0.5, 1.0])
def test_threshold_at_fpr_takes_corners(spark, limit):
    data = [((i * 7919) % 5 == 0, round(((i * 104729) % 997) / 997, 2)) for i in range(120)]
    data = [(int(y), s) for y, s in data]
    allowed = [p for p in roc_points(data) if p[1] <= limit]
    want = (allowed[-1][0], allowed[-1][2]) if allowed else (math.inf, 0.0)
    got = met.threshold_at_fpr(spark.createDataFrame(data, "label int, score double"), max_fpr=limit).first()
    assert (got["threshold"], got["recall"]) == pytest.approx(want)


def test_upsert_and_resolve(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "event_id string, created_at int, v string")
    assert sorted(rows(rec.latest_per_key(df, "event_id", ["created_at"]), "event_id", "v")) == [("a", "y"), ("b", "z")]
    alerts = spark.createDataFrame([("1", "OPEN"), ("2", "OPEN")], "alert_id string, status string")
    log = spark.createDataFrame(
        [("1", "n", "DISMISSED", None, 1), ("1", "n", "TRUE_POSITIVE", "sure", 2), ("9", "n", "ESCALATED", None, 1)],
        "alert_id string, analyst_id string, resolution string, analyst_comment string, resolved_at int",
    )
    out = rec.with_resolutions(alerts, log)
    assert sorted(rows(out, "alert_id", "status", "analyst_resolution")) == [("1", "RESOLVED", "TRUE_POSITIVE"), ("2", "OPEN", None)]
    assert rows(rec.unmatched_resolutions(alerts, log), "alert_id") == [("9",)]


def test_split_bounds(spark):
    day = 86_400
    data = [(10 * day,), (8 * day,), (8 * day - 1,), (7 * day,), (7 * day - 1,), (6 * day,), (5 * day,), (5 * day - 1,)]
    df = spark.createDataFrame(data, "timestamp_ts long").withColumn("y", (F.col("timestamp_ts") % 2).cast("int"))
    out = spl.chronological_split(df, days=spl.SplitDays(2, 2, 1))
    got = {r["timestamp_ts"]: r["split"] for r in out.collect()}
    assert got == {10 * day: "test", 8 * day: "test", 8 * day - 1: None, 7 * day: None, 7 * day - 1: "val",
                   6 * day: "val", 5 * day: None, 5 * day - 1: "train"}
    with pytest.raises(ValueError, match="no rows fall into train"):
        spl.check_split(spl.chronological_split(df, days=spl.SplitDays(2, 8, 1)), "y")
    with pytest.raises(ValueError, match="single value"):
        spl.check_split(out, "y")


def test_group_split_is_disjoint(tx):
    out = spl.group_split(tx)
    both = out.groupBy("nameOrig").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert both.count() == 0


def test_align_and_guard(spark):
    df = spark.createDataFrame([(1, "x")], "b int, extra string")
    out = feat.align_schema(df, T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())]))
    assert out.columns == ["a", "b"] and rows(out, "a", "b") == [(None, 1.0)]
    with pytest.raises(ValueError):
        feat.require_rows(df.where("b > 1"))


def test_sample_with_replacement(tx):
    a = spl.sample_with_replacement(tx.select("event_id"), "event_id", 3_000)
    assert a.select("draw").distinct().count() == a.count() == 3_000
    assert 900 < a.select("event_id").distinct().count() < 1_000  # about 1 - exp(-3) of 1,000
    assert spl.sample_with_replacement(tx.where("false").select("event_id"), "event_id", 5).count() == 0


def test_ordinal_of_many_categories(spark):
    df = spark.range(30_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("v"))
    codes = sorted(r["code"] for r in enc.ordinal_state(df, ["v"], 1).collect())
    assert codes == list(range(30_000))
    first = enc.ordinal_state(df, ["v"], 1).orderBy("category").limit(3).collect()
    assert [r["code"] for r in first] == [0, 1, 2]


def test_missing_file_is_reported(spark):
    from ledgerlens.sources.tables import read_transactions_csv

    with pytest.raises(FileNotFoundError):
        read_transactions_csv(spark, "/tmp/none-such.csv")


def test_extreme_numbers_become_dead_letters(spark):
    """Nothing that passes the contract may fail a later cast."""
    fine = {"type": "T", "category": "c", "nameOrig": "a", "nameDest": "b", "amount": 1, "oldbalanceOrg": 1, "newbalanceOrig": 1}
    changes = [
        {"step": 3_000_000_000},
        {"amount": 1e30},
        {"amount": "nan"},
        {"amount": "Infinity"},
        {"ingested_at": 1e300},
        {"ingested_at": 1_700_000_000},
        {"ingested_at": 1_700_000_000_000},
        {"amount": "12.5", "step": 7.0},
    ]
    lines = [(i, json.dumps({**fine, **c})) for i, c in enumerate(changes)]
    good, dead = val.split_valid(spark.createDataFrame(lines, "i int, payload string"))
    assert dead.count() == 5
    typed = {r["i"]: r for r in val.typed_events(good).collect()}
    assert sorted(typed) == [5, 6, 7]
    assert typed[5]["ingested_at"] == typed[6]["ingested_at"] and typed[5]["ingested_at"].year == 2023
    assert typed[7]["amount"] == 12.5 and typed[7]["step"] == 7


def test_nan_score_is_clear(spark):
    df = spark.createDataFrame([(float("nan"),)], "score double")
    assert rows(pol.apply_policy(df), "verdict", "risk_band") == [("CLEAR", "low")]


def test_grid_counts_unscored_positives(spark):
    from ledgerlens.operators import metrics as met

    df = spark.createDataFrame([(1, float("nan")), (1, 0.9), (0, None), (0, 0.1)], "label int, score double")
    first = met.threshold_grid(df).orderBy("threshold").first()
    assert first["recall"] == 0.5


def test_users_and_columns_without_values_stay(spark):
    from ledgerlens.operators import profiling as pro

    schema = "nameOrig string, step int, amount double, nameDest string, device_type string"
    df = spark.createDataFrame([("a", 1, None, "x", "d"), ("b", 1, 2.0, "x", "d")], schema)
    got = {r["nameOrig"]: r["user_tx_count"] for r in pro.user_features(df).collect()}
    assert got == {"a": 1, "b": 1}
    table = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "p double, q double")
    got = {r["column"]: r["count"] for r in pro.describe_numeric(table, ["p", "q"]).collect()}
    assert got == {"p": 0, "q": 1}


def test_dead_letters_of_a_replay_share_a_folder(spark, tmp_path):
    from ledgerlens.sources import sinks

    for day in ("2024-01-01", "2024-01-02"):
        df = spark.createDataFrame([("x", day)], "payload_json string, created_at string")
        sinks.write_batch(df, str(tmp_path / "dead"), 3, None)
    assert sinks.read_table(spark, str(tmp_path / "dead")).count() == 1
