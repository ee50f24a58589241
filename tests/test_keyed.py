"""Keyed tables: one row per key over batches, days and compactions; open payload keys; resolutions."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metadata as meta
from ledgerlens.session import discard, materialize, scratch_path
from ledgerlens.sources.keyed import KeyedTable

ROWS = "id string, at timestamp, v int"


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _table(spark, tmp_path, buckets=8):
    return KeyedTable(str(tmp_path / "t"), "id", ("at",), spark.createDataFrame([], ROWS).schema, buckets)


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, day string, v int").select("id", F.col("day").cast("timestamp").alias("at"), "v")


def _read(table, spark):
    return {r["id"]: r["v"] for r in table.read(spark).collect()}


def test_an_event_delivered_again_is_one_row(spark, tmp_path):
    table = _table(spark, tmp_path)
    assert _read(table, spark) == {} and table.compact(spark) == []
    table.upsert(_rows(spark, ("a", "2024-01-01", 1), ("b", "2024-01-01", 1), ("b", "2024-01-02", 2)), 1)
    assert _read(table, spark) == {"a": 1, "b": 2}
    table.upsert(_rows(spark, ("a", "2023-12-31", 9), ("c", "2024-01-05", 3)), 2)  # another batch, an earlier day
    assert _read(table, spark) == {"a": 9, "b": 2, "c": 3}
    before = table.compact(spark)
    assert before and _read(table, spark) == {"a": 9, "b": 2, "c": 3}
    table.upsert(_rows(spark, ("a", "2024-01-01", 4)), 3)
    table.upsert(_rows(spark, ("a", "2024-01-01", 5)), 3)  # the batch is run again
    assert _read(table, spark) == {"a": 5, "b": 2, "c": 3}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = _table(spark, tmp_path)
    table.upsert(_rows(spark, *[(f"k{i}", "2024-01-01", i) for i in range(100)]), 1)
    assert table.compact(spark) == list(range(8))
    first = _files(tmp_path / "t" / "base")
    table.upsert(_rows(spark, ("k7", "2024-01-02", 700)), 2)
    touched = table.compact(spark)
    assert len(touched) == 1
    table.vacuum(spark)
    last = _files(tmp_path / "t" / "base")
    kept = {f for f in first if f"/bucket={touched[0]}/" not in f}
    assert kept == {f for f in last if "/base/1/" in f} and all(first[f] == last[f] for f in kept)
    assert {f for f in last if "/base/2/" in f} and not _files(tmp_path / "t" / "delta")
    assert _read(table, spark) == {f"k{i}": i for i in range(100)} | {"k7": 700}


def test_a_compaction_that_fails_changes_nothing(spark, tmp_path):
    table = _table(spark, tmp_path)
    table.upsert(_rows(spark, ("a", "2024-01-01", 1)), 1)
    table.compact(spark)
    table.upsert(_rows(spark, ("a", "2024-01-02", 2)), 2)
    # Base files of the next version without a manifest, as a broken compaction leaves them.
    _rows(spark, ("a", "2024-01-02", 99)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "t" / "base" / "2"))
    assert _read(table, spark) == {"a": 2}
    table.compact(spark)
    assert _read(table, spark) == {"a": 2}


def test_null_keys_and_columns(spark, tmp_path):
    table = _table(spark, tmp_path)
    table.upsert(_rows(spark, (None, None, None), (None, "2024-01-01", 5), ("a", None, None)), 1)
    table.compact(spark)
    assert _read(table, spark) == {None: 5, "a": None}


def test_open_keys_become_columns(spark):
    rows = [
        (1, "{'payment_method': 'x', 'location': {'zone': 3}, 'campaign': {'code': None, 'deep': {'a': True}}, 'id': 9}"),
        (2, None),
        (3, "{bad"),
        (4, "{'location': {'postcode': '12', 'we ird\"k': 1}, 'tags': [1, 2], 'mixed': 1, 'when': datetime.datetime(2024, 1, 2)}"),
        (5, "{'mixed': 'a', 'campaign': {'deep': {'a': False}}}"),
    ]
    out = meta.flatten_open(spark.createDataFrame(rows, "id int, metadata string"))
    got = {r["id"]: r for r in out.collect()}
    assert [i for i, r in got.items() if r["metadata_error"]] == [3]
    assert (got[1]["loc_zone"], got[1]["metadata_id"], got[1]["campaign_deep.a"], got[5]["campaign_deep.a"]) == (3, 9, True, False)
    assert (got[4]["loc_postcode"], got[4]['loc_we ird"k'], got[4]["tags"], got[4]["when"]) == (12.0, 1, "[1,2]", "2024-01-02T00:00:00")
    assert (got[4]["mixed"], got[5]["mixed"], got[2]["mixed"], got[1]["campaign_code"]) == ("1", "a", "Unknown", "Unknown")
    assert meta.flatten_open(spark.createDataFrame([], "id int, metadata string")).columns == ["id", "metadata_error"]
    with pytest.raises(ValueError):
        meta.flatten_open(spark.createDataFrame(rows, "id int, metadata string"), most=3)


def test_resolutions_as_a_stream(spark, tmp_path):
    """Before the alert, late, twice, unknown, beyond the bound; alerts without one are sent when it has passed."""
    from ledgerlens.streaming.resolutions import latest_resolutions, resolve_stream

    alert = "alert_id string, event_id string, created_at timestamp, status string"
    answer = "alert_id string, analyst_id string, resolution string, analyst_comment string, resolved_at timestamp"
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    batches = [
        ([("a", day(1)), ("b", day(1)), ("c", day(1))], [("a", "DISMISSED", day(2)), ("no", "ESCALATED", day(2))]),
        ([("d", day(3))], [("a", "TRUE_POSITIVE", day(4)), ("b", "FALSE_POSITIVE", day(3)), ("c", "ESCALATED", day(20))]),
        ([("end", day(28))], [("none", "DISMISSED", day(28))]),
    ]
    got = []
    for i, (alerts, answers) in enumerate(batches):
        a = spark.createDataFrame([(x, x, t, "OPEN") for x, t in alerts], "alert_id string, event_id string, t string, status string")
        a.select("alert_id", "event_id", F.col("t").cast("timestamp").alias("created_at"), "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        r = spark.createDataFrame([(x, "n", v, None, t) for x, v, t in answers], "alert_id string, analyst_id string, resolution string, analyst_comment string, t string")
        r.select("alert_id", "analyst_id", "resolution", "analyst_comment", F.col("t").cast("timestamp").alias("resolved_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for s, n in ((alert, "a"), (answer, "r"))]
        joined = resolve_stream(*streams, within="10 days")
        run = joined.writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
        run.foreachBatch(lambda d, _: got.extend(map(tuple, d.collect()))).start().awaitTermination()
    last = latest_resolutions(spark.createDataFrame(got, joined.schema))
    assert {r["alert_id"]: (r["status"], r["analyst_resolution"]) for r in last.collect()} == {
        "a": ("RESOLVED", "TRUE_POSITIVE"), "b": ("RESOLVED", "FALSE_POSITIVE"), "c": ("OPEN", None), "d": ("OPEN", None),
    }
    assert sum(g[0] == "a" for g in got) == 2


def test_discarded_stages_are_gone(spark):
    stage = materialize(spark.range(5), "stage")
    folder = stage.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    other = scratch_path(spark, "other")
    spark.range(2).write.parquet(other)
    assert os.path.exists(folder) and os.path.exists(other)
    discard(spark, stage, other)
    discard(spark, other, "/nowhere/else")
    assert not os.path.exists(folder) and not os.path.exists(other)


def test_cells_of_the_wrong_type_are_reported(spark, tmp_path):
    from ledgerlens.sources import tables

    path = tmp_path / "t.csv"
    path.write_text('step,amount,isMoneyLaundering,metadata,other\n3.0,12.5,True,"{\'a\': \'x,""y""\'}",z\n4,oops,false,,\nx,7,1,m,\n,,2.5,,\n')
    df = tables.read_transactions_csv(spark, str(path), errors=True)
    assert [tuple(r)[:3] for r in df.collect()] == [(3, 12.5, 1), (4, None, 0), (None, 7.0, 1), (None, None, None)]
    assert [r["cell_errors"] for r in df.collect()] == [[], ["amount"], ["step"], ["isMoneyLaundering"]]
    assert {(r["column"], r["n"]) for r in tables.bad_cells(df).collect()} == {("amount", 1), ("step", 1), ("isMoneyLaundering", 1)}
    assert df.first()["metadata"] == "{'a': 'x,\"y\"'}" and "cell_errors" not in tables.read_transactions_csv(spark, str(path)).columns


def test_unread_payloads_are_rejects(spark):
    from ledgerlens.operators.features import unread_payloads

    rows = [(1, "{'location': {'city': 'a'}}"), (2, "{broken"), (3, None)]
    out = unread_payloads(spark.createDataFrame(rows, "id int, metadata string")).collect()
    assert [tuple(r) for r in out] == [(2, "{broken")]
