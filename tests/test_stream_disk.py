"""What a stream keeps on disk: compressed lines, a batch without columns no table has, no derived columns in its state's shuffles."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.validation import validate_events
from ledgerlens.plans.flows import _scorer
from ledgerlens.plans.scoring import raw_lines
from ledgerlens.session import shared_dir
from ledgerlens.sources import sinks, tables
from ledgerlens.streaming import scoring as live


@pytest.fixture(scope="module")
def lines(spark, sf):
    return raw_lines(spark, sf).select("payload").limit(300).cache()


def test_lines_are_compressed_and_read_back(spark, lines, tmp_path):
    sinks.write_lines(lines, str(tmp_path / "lines"))
    lines.write.text(str(tmp_path / "plain"))
    size = lambda name: sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / name / "part-*")))
    assert size("lines") < size("plain") / 2
    back = tables.read_event_lines(spark, str(tmp_path / "lines"))
    assert back.count() == 300 and back.exceptAll(lines).count() == 0


def test_a_batch_is_kept_narrow_and_removed(spark, lines, tmp_path):
    batch = live.score_lines(lines, _scorer()).withColumn("wide", F.repeat(F.lit("x"), 1000))
    own = f"{shared_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"
    held, before = [], spark.sparkContext._jsc.getPersistentRDDs().size()

    def note(_):
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
        held.extend(spark.read.parquet(folder).columns for folder in glob.glob(f"{own}/batch-*"))

    sinks.fan_out(str(tmp_path / "tables"), {"predictions": note})(batch, 1)
    assert len(held) == 1 and {"payload", "feature_json"} <= set(held[0]) and not {"wide", "hour_sin", "nameOrig"} & set(held[0])
    assert not glob.glob(f"{own}/batch-*")
    for name, rows in sinks.scored_tables(batch).items():
        if name == "late_events":
            continue
        found = sinks.read_table(spark, str(tmp_path / "tables" / name))
        same = [c for c in rows.columns if c not in ("created_at", "processing_latency_ms", "ingested_at")]
        assert found.count() == rows.count() > 0, name
        assert found.select(same).exceptAll(rows.select(same)).count() == 0, name


def test_derived_columns_stay_out_of_the_state(lines, monkeypatch):
    seen = []

    def velocity(events, once, once_key):
        seen.extend(events.columns)
        return events.withColumns(
            {"tx_count_24h": F.lit(0), "amount_sum_24h": F.lit(0.0), "merchant_tx_count_24h": F.lit(0), "is_late": F.lit(False)}
        )

    monkeypatch.setattr(live, "velocity_stream", velocity)
    out = live.score_stream(lines, _scorer())
    derived = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "balance_delta", "amt_to_balance", "is_weekend"]
    assert not set(derived[:-1]) & set(seen) and set(derived) <= set(out.columns)
    want = live.prepare_events(lines).select("payload", *derived)
    assert out.select("payload", *derived).exceptAll(want).count() == 0
    assert validate_events(lines).where(F.size("errors") > 0).count() > 0
