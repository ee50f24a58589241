"""The streaming query against the batch form."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans.base import tx as view
from ledgerlens.plans.flows import _scorer
from ledgerlens.plans.scoring import raw_lines
from ledgerlens.session import scratch_path
from ledgerlens.sources import sinks, tables
from ledgerlens.streaming.scoring import STATE_CONF, run_stream, score_lines
from ledgerlens.streaming.state import velocity_stream


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """Event lines in four files, in time order."""
    lines = raw_lines(spark, sf).join(
        view(spark, sf).select(F.col("event_id").alias("source_id"), "timestamp"), "source_id"
    )
    rows = [r["payload"] for r in lines.orderBy("timestamp", F.xxhash64("source_id")).collect()]
    folder = tmp_path_factory.mktemp("files")
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        (folder / f"{i}.txt").write_text("\n".join(part) + "\n")
    return folder


def land(files, inbox, *numbers):
    for i in numbers:
        target = inbox / f"{i}.txt"
        shutil.copy(files / f"{i}.txt", target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))


def test_stream_equals_batch_across_batches_and_restart(spark, files, tmp_path):
    inbox, root, progress = tmp_path / "inbox", str(tmp_path / "tables"), str(tmp_path / "progress")
    inbox.mkdir()
    for numbers in ((0, 1), (2, 3)):  # the second round continues from the checkpoint
        land(files, inbox, *numbers)
        stream = tables.stream_event_lines(spark, str(inbox), 1)
        run_stream(stream, _scorer(), root, available_now=True, checkpoint=progress).awaitTermination()
    batch = score_lines(tables.read_event_lines(spark, str(inbox)), _scorer())
    want = sinks.scored_tables(batch)
    for name, cols in {
        "predictions": ["event_id", "score", "verdict", "reason_codes_json"],
        "feature_snapshots": ["event_id", "feature_json"],
        "alerts": ["alert_id", "event_id", "verdict"],
        "dead_letter_events": ["payload_json", "error_message"],
    }.items():
        a, b = sinks.read_table(spark, f"{root}/{name}").select(cols), want[name].select(cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
        assert a.count() > 0


def test_late_events_are_marked_and_kept(spark, tmp_path):
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    inbox = tmp_path / "in"
    schema = "event_id string, us long, nameOrig string, nameDest string, amount double, payload string"
    hour = 3_600 * 1_000_000
    batches = [
        [("a", 10 * hour, "C", "M", 1.0, "a"), ("x", 1, None, None, 1.0, "x")],
        [("b", 7 * hour, "C", "M", 2.0, "b"), ("c", 11 * hour, "C", "", 4.0, "c")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    got = []
    stream = (
        velocity_stream(df.withColumn("timestamp", F.timestamp_micros("us")))
        .writeStream.option("checkpointLocation", scratch_path(spark, "late"))
        .foreachBatch(lambda d, i: got.extend(d.collect()))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    seen = {r["event_id"]: (r["tx_count_24h"], r["amount_sum_24h"], r["merchant_tx_count_24h"], r["is_late"]) for r in got}
    assert seen == {"a": (0, 0.0, 0, False), "x": (0, 0.0, 0, False), "b": (1, 1.0, 1, True), "c": (2, 3.0, 0, False)}


def test_a_batch_written_twice_counts_once(spark, sf, tmp_path):
    root = str(tmp_path)
    batch = score_lines(raw_lines(spark, sf).select("payload"), _scorer())
    write = sinks.fan_out(root)
    write(batch, 3)
    first = sinks.read_table(spark, f"{root}/predictions").count()
    write(batch, 3)
    assert sinks.read_table(spark, f"{root}/predictions").count() == first


def _events(spark, folder, batches, schema="event_id string, us long, nameOrig string, nameDest string, amount double, payload string"):
    for i, rows in enumerate(batches):
        target = os.path.join(folder, f"{i}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(target + ".d")
        part = next(f for f in os.listdir(target + ".d") if f.endswith(".parquet"))
        shutil.copy(os.path.join(target + ".d", part), target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)


def _run(df, checkpoint):
    got = []
    stream = (
        df.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda d, i: got.extend(d.collect()))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return got


def test_state_leaves_after_the_lifetime_in_event_time(spark, tmp_path):
    """25 hours of silence: counters start anew, as in the batch form, and idle keys leave the store."""
    from ledgerlens.streaming.scoring import live_profiles, profile_operators

    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    hour, folder, progress = 3_600 * 1_000_000, str(tmp_path / "in"), str(tmp_path / "progress")
    os.makedirs(folder)
    batches = [
        [("a", 1 * hour, "C", "M", 1.0, "a"), ("b", 2 * hour, "D", "M", 1.0, "b")],
        [("c", 27 * hour, "C", "N", 2.0, "c")],
        [("d", 60 * hour, "E", "N", 4.0, "d"), ("e", 61 * hour, "E", "N", 4.0, "e")],
    ]
    df = _events(spark, folder, batches).withColumn("timestamp", F.timestamp_micros("us"))
    got = _run(velocity_stream(df), progress)
    assert {r["event_id"]: (r["tx_count_24h"], r["merchant_tx_count_24h"]) for r in got} == {
        "a": (0, 0), "b": (0, 1), "c": (0, 0), "d": (0, 0), "e": (1, 1),
    }
    customers, merchants = profile_operators(spark, progress)
    assert {r["key"]: (r["n"], r["amount"]) for r in live_profiles(spark, progress, customers).collect()} == {"E": (2, 8.0)}
    assert {r["key"]: r["n"] for r in live_profiles(spark, progress, merchants).collect()} == {"N": 2}


def test_vectorised_counters_equal_a_loop():
    import random

    import numpy as np

    from ledgerlens.streaming.state import apply_events

    draw = random.Random(5)
    for _ in range(300):
        us = np.array(sorted(draw.randint(0, 60) for _ in range(draw.randint(1, 8))))
        micros = np.array([draw.randint(-3, 9) for _ in us])
        state = draw.choice([(0, 0, None), (3, 7, draw.randint(0, 70))])
        n, total, last = state
        want = []
        for t, m in zip(us.tolist(), micros.tolist(), strict=True):
            if last is not None and t - last > 10:
                n = total = 0
            want.append((n, total, t if last is None else last))
            n, total, last = n + 1, total + m, t if last is None else max(last, t)
        counts, sums, before, end = apply_events(us, micros, *state, 10)
        assert list(zip(counts.tolist(), sums.tolist(), before.tolist(), strict=True)) == want and end == (n, total, last)


def test_the_same_file_twice_counts_once(spark, files, tmp_path):
    once, twice = tmp_path / "once", tmp_path / "twice"
    for folder in (once, twice):
        folder.mkdir()
    land(files, once, 0, 1)
    land(files, twice, 0, 1)
    for i in (0, 1):
        shutil.copy(files / f"{i}.txt", twice / f"again{i}.txt")
        os.utime(twice / f"again{i}.txt", (1_700_000_100 + i, 1_700_000_100 + i))
    tables_of = {}
    for folder in (once, twice):
        root = str(tmp_path / f"{folder.name}-tables")
        stream = tables.stream_event_lines(spark, str(folder), 1)
        run_stream(stream, _scorer(), root, str(tmp_path / f"{folder.name}-progress"), available_now=True).awaitTermination()
        tables_of[folder.name] = sinks.read_table(spark, f"{root}/feature_snapshots").select("event_id", "feature_json")
    a, b = tables_of["once"], tables_of["twice"]
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_counters_of_a_running_query(spark, files, tmp_path):
    from ledgerlens.streaming.scoring import CounterListener

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    land(files, inbox, 0, 1, 2, 3)
    listener = CounterListener()
    spark.streams.addListener(listener)
    try:
        root = str(tmp_path / "tables")
        stream = tables.stream_event_lines(spark, str(inbox), 1)
        run_stream(stream, _scorer(), root, str(tmp_path / "progress"), name="counted", available_now=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        totals = listener.totals("counted")
    finally:
        spark.streams.removeListener(listener)
    done = sinks.read_table(spark, f"{root}/predictions").groupBy("verdict").count().collect()
    assert {k.removeprefix("verdict_"): v for k, v in totals.items() if k.startswith("verdict_") and v} == {r["verdict"]: r["count"] for r in done}
    assert totals["success"] == sum(r["count"] for r in done)
    assert totals["error"] == sinks.read_table(spark, f"{root}/dead_letter_events").count() > 0
