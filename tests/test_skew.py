"""Groups too large for a task give the same results as small ones, at any slice size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import encoding as enc
from ledgerlens.operators import metrics as met
from ledgerlens.operators import records as rec
from ledgerlens.operators import split as spl
from ledgerlens.operators import velocity as vel
from ledgerlens.operators.ordered import exact_quantiles, row_rank, running_totals, slice_groups

LABEL = "isMoneyLaundering"


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def hot(tx):
    """A third of all events by one customer, a third at one merchant, a tenth at one instant."""
    n = F.col("event_id").cast("int")
    return (
        tx.withColumn("nameOrig", F.when(n % 3 == 0, "C-hot").otherwise(F.col("nameOrig")))
        .withColumn("nameDest", F.when(n % 3 == 1, "M-hot").otherwise(F.col("nameDest")))
        .withColumn("timestamp", F.when(n % 10 == 0, F.lit("2024-01-10").cast("timestamp")).otherwise(F.col("timestamp")))
        .select("event_id", "timestamp", "nameOrig", "nameDest", "amount", "score", LABEL)
        .cache()
    )


@pytest.mark.parametrize("ttl", [600, 3_600, 86_400])
@pytest.mark.parametrize("rows", [7, 60])
def test_velocity(hot, ttl, rows):
    same(vel.velocity_state(hot, ttl_seconds=ttl), vel.velocity_state(hot, ttl_seconds=ttl, rows_per_task=rows))


def naive_velocity(rows, ttl):
    state, out = {}, {}
    for r in rows:
        n, total, last = state.get(r["nameOrig"], (0, 0.0, None))
        if last is not None and r["us"] - last > ttl * 1_000_000:
            n, total = 0, 0.0
        out[r["event_id"]] = (n, round(total, 4))
        state[r["nameOrig"]] = (n + 1, total + r["amount"], r["us"])
    return out


def test_velocity_equals_simulation(hot):
    rows = hot.withColumns({"us": F.unix_micros("timestamp"), "h": F.xxhash64("event_id")}).orderBy("us", "h").collect()
    got = {
        r["event_id"]: (r["tx_count_24h"], round(r["amount_sum_24h"], 4))
        for r in vel.velocity_state(hot, rows_per_task=25).collect()
    }
    assert got == naive_velocity(rows, 86_400)


def test_sessions(hot):
    a = vel.customer_sessions(hot, ttl_seconds=7_200)
    same(a, vel.customer_sessions(hot, ttl_seconds=7_200, rows_per_task=20))
    assert a.agg(F.sum("tx_count")).first()[0] == hot.count()


@pytest.mark.parametrize("seconds", [60, 86_400])
def test_rolling(hot, seconds):
    same(vel.rolling_window(hot, seconds=seconds), vel.rolling_window(hot, seconds=seconds, rows_per_task=20))


def test_hot_group_is_spread(hot):
    sliced = slice_groups(hot.withColumn("us", F.unix_micros("timestamp")), ["nameOrig"], "us", "event_id", 50)
    assert sliced.any_hot
    worst = sliced.df.groupBy("nameOrig", "_slice").count().agg(F.max("count")).first()[0]
    assert worst <= 100  # also the instant shared by a tenth of all rows is cut


def test_more_than_a_thousand_large_groups(spark):
    df = spark.range(1_050 * 14).select(F.col("id").alias("event_id"), (F.col("id") % 1_050).alias("k"), F.col("id").alias("us"))
    sliced = slice_groups(df, ["k"], "us", "event_id", 12)
    sizes = sliced.df.groupBy("k", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] < 24 and sizes.where("_slice = 0").count() == 0
    got = running_totals(df, ["k"], "us", {"n": F.lit(1).cast("bigint")}, "event_id", 12)
    assert got.where(F.col("n") != F.floor(F.col("event_id") / 1_050)).count() == 0


def test_running_totals_one_group(hot):
    df = hot.withColumn("us", F.unix_micros("timestamp"))
    one = {"n": F.lit(1).cast("bigint")}
    w = Window.orderBy("us", F.xxhash64("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("n", F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)))
    same(running_totals(df, [], "us", one, "event_id", 30), want)


def test_rank_is_a_permutation(hot):
    ranks = row_rank(hot, "amount", "event_id", rows_per_task=40).agg(
        F.min("rank"), F.max("rank"), F.countDistinct("rank")
    ).first()
    assert tuple(ranks) == (0, 999, 1000)


def test_quantiles(hot):
    probs = {"a": 0.05, "m": 0.5, "z": 0.95}
    small = exact_quantiles(hot, ["nameOrig"], "amount", probs, 20)
    want = hot.groupBy("nameOrig").agg(*[F.percentile("amount", p).alias(n) for n, p in probs.items()])
    digits = lambda d: d.select("nameOrig", *[F.round(n, 6).alias(n) for n in probs])
    same(digits(small), digits(want))


def test_folds_and_encoders(hot):
    df = hot.withColumn("nk", F.col("nameOrig"))
    same(spl.time_folds(df), spl.time_folds(df, rows_per_task=30))
    how = enc.TargetStats(alpha=20, min_count=8)
    a = enc.oof_target_encode(df, ["nk", "nameDest"], LABEL, how=how)
    b = enc.oof_target_encode(df, ["nk", "nameDest"], LABEL, how=how, rows_per_task=10)
    same(a, b)


def test_metrics(hot):
    df = hot.withColumnRenamed(LABEL, "label")
    digits = lambda d: d.select(*[F.round(c, 9).alias(c) for c in d.columns])
    same(digits(met.rank_metrics(df)), digits(met.rank_metrics(df, rows_per_task=25)))
    same(met.pr_curve(df), met.pr_curve(df, rows_per_task=25))
    same(met.best_f1_threshold(df), met.best_f1_threshold(df, rows_per_task=25))
    same(met.threshold_at_fpr(df), met.threshold_at_fpr(df, rows_per_task=25))
    assert rec.exclusive_p95(df, "amount", 25).first() == rec.exclusive_p95(df, "amount").first()


def test_result_does_not_depend_on_partitions(hot):
    a = vel.velocity_state(hot.repartition(13), rows_per_task=40)
    same(vel.velocity_state(hot.coalesce(1)), a)


def test_quantiles_by_selection(spark, monkeypatch):
    """Bracketed groups, groups whose bracket misses, small groups, ties, nulls: all as by plain counting."""
    import numpy as np
    from pyspark.sql import functions as F

    from ledgerlens.operators import ordered

    draw = np.random.default_rng(4)
    rows = [("even", float(x)) for x in draw.random(3000)] + [("tied", float(x)) for x in draw.integers(0, 4, 2500)]
    rows += [("few", 1.0), ("few", 4.0), (None, 2.0), ("few", None), ("even", float("nan")), ("far", float("inf")), ("far", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q1": 0.25, "median": 0.5, "q99": 0.99, "least": 0.0, "most": 1.0}
    want = {r["g"]: tuple(r)[1:] for r in ordered.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert want["even"] == pytest.approx(tuple(np.quantile([v for g, v in rows if g == "even" and v == v], list(probs.values()))))
    all_rows = df.where("g <> 'far'")
    whole = tuple(ordered.exact_quantiles(all_rows, [], "v", probs).first())
    for slack in (0.05, 3e-4, 0.0):  # the last ones miss by a place in groups this small
        monkeypatch.setattr(ordered, "_SLACK", slack)
        got = {r["g"]: tuple(r)[1:] for r in ordered.exact_quantiles(df, ["g"], "v", probs, bracket_rows=1000).collect()}
        assert got.keys() == want.keys()
        for g, v in want.items():
            assert got[g] == pytest.approx(v, abs=1e-12, nan_ok=True), (g, slack)
        one = ordered.exact_quantiles(all_rows, [], "v", probs, bracket_rows=1000).collect()
        assert len(one) == 1 and tuple(one[0]) == pytest.approx(whole, abs=1e-12)
    plan = ordered._selected_quantiles
    calls = []
    monkeypatch.setattr(ordered, "_SLACK", 0.05)
    monkeypatch.setattr(ordered, "_selected_quantiles", lambda p, sure, *a: calls.append({r["g"] for r in sure.collect()}) or plan(p, sure, *a))
    ordered.exact_quantiles(df, ["g"], "v", probs, bracket_rows=1000).collect()
    assert calls == [{"even", "tied"}]
    assert ordered.exact_quantiles(df.where(F.lit(False)), ["g"], "v", probs, bracket_rows=1000).collect() == []
