"""Tables of one row group are dealt to many tasks; passes over the rows do not move them needlessly."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.models import staged
from ledgerlens.models import stacking as stk
from ledgerlens.operators import ordered
from ledgerlens.plans import learning
from ledgerlens.plans.scoring import raw_lines
from ledgerlens.session import spread


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """80,000 events, each table one file of one row group."""
    root = str(tmp_path_factory.mktemp("one-file"))
    i = F.col("id")
    events = spark.range(0, 80_000, 1, 1).select(
        i.alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), i)).cast("timestamp_ntz").alias("ts"),
        (i % 50).alias("user_id"),
        F.element_at(F.array(F.lit("view"), F.lit("click")), (i % 2 + 1).cast("int")).alias("event_type"),
        (i % 90).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), (i % 100).cast("string"), F.lit("}")).alias("props"),
    )
    customers = spark.range(0, 50, 1, 1).select(
        i.alias("c_custkey"), F.lit("c").alias("c_name"), (i % 5).cast("int").alias("c_nationkey"),
        (i * 10).cast("double").alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    )
    events.write.parquet(f"{root}/events.parquet")
    customers.write.parquet(f"{root}/customer.parquet")
    return root


def test_rows_are_dealt_evenly_and_kept(spark):
    df = spark.range(0, 100_000, 1, 1)
    sizes = [r["n"] for r in spread(df, 100_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sizes == [25_000] * 4
    assert spread(df, 1_000).rdd.getNumPartitions() == 1
    assert spread(df, 100_000_000)._jdf.queryExecution().logical().toString().startswith("Repartition 200")


def test_lines_of_one_row_group_are_many_tasks(spark, one_file):
    lines = raw_lines(spark, one_file)
    parts = lines.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(parts) == 3 and sum(r["n"] for r in parts) == 80_000
    assert lines.select("source_id").distinct().count() == 80_000


def test_learning_rows_are_written_once_in_even_files(spark, one_file):
    df = learning.frame(spark, one_file)
    assert len([f for f in df.inputFiles() if "/transactions-" in f]) == 3 and df.count() == 80_000


@pytest.mark.parametrize("curve, runs", [([0.5] * 100, [10, 100]), ([1.0] * 100, [10])])
def test_boosting_runs_at_most_twice(monkeypatch, curve, runs):
    made = []
    monkeypatch.setattr(staged, "staged_pr_auc", lambda model, val: curve[: made[-1]])
    monkeypatch.setattr(staged, "first_rounds", lambda model, rounds: rounds)
    assert staged.boost(made.append, 100, None) == (1, curve[: runs[-1]])
    assert made == runs


def test_staged_scores_do_not_shuffle_the_rows(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(400).select(
        (F.col("id") % 3 == 0).cast("double").alias("label"), array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features")
    )
    model = stk.fit_learner("gbt", {"maxIter": 3, "maxDepth": 2}, rows)
    long, _ = staged.staged_scores(model, rows)
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(_row", plan)
    assert long.count() == 1_200


def test_sizes_of_large_groups_are_written_before_they_are_joined(spark, monkeypatch):
    seen = []
    brackets = ordered._brackets
    monkeypatch.setattr(ordered, "_brackets", lambda p, sizes, *a: seen.append(sizes.inputFiles()) or brackets(p, sizes, *a))
    df = spark.range(1_001).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r["k"]: r["m"] for r in ordered.exact_quantiles(df, ["k"], "v", {"m": 0.5}, bracket_rows=100).collect()}
    assert got == {0: 500.0, 1: 500.0} and seen[0]
