"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as feat
from ledgerlens.operators import profiling as prof
from ledgerlens.operators import records as rec
from ledgerlens.operators import split as spl
from ledgerlens.operators import velocity as vel
from ledgerlens.plans.base import tx as view


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> list[str]:
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", text)


@pytest.fixture
def events(spark, tmp_path):
    path = str(tmp_path / "tx")
    view(spark, "/root/testdata/sf0.001").write.parquet(path)
    return spark.read.parquet(path)


def test_features_are_one_projection(events):
    text = plan(feat.feature_frame(events))
    assert not exchanges(text) and "Python" not in text


def test_columns_and_filters_reach_the_scan(events):
    text = plan(events.where("amount > 5000").select("event_id", "amount"))
    assert "GreaterThan(amount,5000.0)" in text and "struct<event_id:string,amount:double>" in text


def test_one_shuffle_and_one_sort_per_state_key(events):
    text = plan(vel.velocity_state(events))
    assert exchanges(text) == ["hashpartitioning", "hashpartitioning"]
    assert len(re.findall(r"\bSort \[", text)) == 2


def test_no_window_over_all_rows_in_one_task(events):
    assert "SinglePartition" not in plan(vel.velocity_state(events))
    assert "SinglePartition" not in plan(vel.rolling_window(events))


def test_folds_do_not_shuffle_the_table(events):
    assert not exchanges(plan(spl.time_folds(events)))


def test_group_split_does_not_shuffle(events):
    assert not exchanges(plan(spl.group_split(events)))


def test_alert_budget_limits_before_the_shuffle(events):
    alerts = events.withColumn("created_at", F.col("timestamp"))
    text = plan(rec.alert_budget(alerts, "nameDest", 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_k_is_no_sort(events):
    alerts = events.select(F.col("event_id").alias("alert_id"), F.col("timestamp").alias("created_at"))
    assert "TakeOrderedAndProject" in plan(rec.list_alerts(alerts))


def test_latest_per_key_combines_before_the_shuffle(events):
    text = plan(rec.latest_per_key(events.select("nameOrig", "event_id", "timestamp"), "nameOrig", ["timestamp"]))
    assert "partial_max_by" in text and "Window" not in text


def test_narrow_types_is_one_pass(events):
    text = plan(prof.narrow_types(events.select("amount", "step", "type")))
    assert text.count("FileScan") == 1
