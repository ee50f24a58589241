"""Activity state per customer and merchant: inactivity counters, sessions, rolling windows.

The counters run until the key has been silent for longer than the lifetime: every event renews
it. A profile is read before the event itself is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import money
from ledgerlens.operators.ordered import (
    ROWS_PER_TASK,
    SLICE,
    carry,
    find_hot_groups,
    running_totals,
    same_keys,
    slice_groups,
)
from ledgerlens.schema import STATE_TTL_SECONDS

MICROS = 1_000_000


def activity_before(
    df: DataFrame,
    key: str,
    time_col: str = "timestamp",
    id_col: str = "event_id",
    amount_col: str = "amount",
    count_name: str = "tx_count_24h",
    sum_name: str | None = "amount_sum_24h",
    ttl_seconds: int = STATE_TTL_SECONDS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Count (and sum) of the key's earlier events since its last silence longer than the TTL.

    One shuffle on the key. A key too large for one task is cut into time slices, and each slice
    starts from the counters the slices before it leave behind.
    """
    ttl = ttl_seconds * MICROS
    timed = df.withColumns(
        {
            "_us": F.unix_micros(time_col),
            "_amt": F.coalesce(money(F.col(amount_col)), money(F.lit(0))),
        }
    )
    sliced = slice_groups(timed, [key], "_us", id_col, rows_per_task)
    w = sliced.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.df.withColumns(
        {
            "_silent": F.col("_us") - F.lag("_us").over(w) > ttl,
            "_no": F.row_number().over(w).cast("bigint"),
            "_all": F.sum("_amt").over(so_far),
        }
    )
    # Position and total at the latest restart; null in the stretch a slice begins with.
    rows = rows.withColumn(
        "_from",
        F.last(
            F.when(F.col("_silent"), F.struct("_no", (F.col("_all") - F.col("_amt")).alias("_all"))),
            ignorenulls=True,
        ).over(so_far),
    )
    count = F.col("_no") - F.coalesce("_from._no", F.lit(1))
    total = F.col("_all") - F.col("_amt") - F.coalesce("_from._all", F.lit(0))
    scanned = rows
    if sliced.any_hot:
        left_over = _state_left_by_slices(rows.where(F.col(SLICE) > 0), key, ttl)
        scanned = carry(sliced, left_over, rows)
        opening = F.col("_from").isNull()
        count += F.when(opening, F.coalesce("_in_cnt", F.lit(0))).otherwise(F.lit(0))
        total += F.when(opening, F.coalesce("_in_sum", F.lit(0))).otherwise(F.lit(0))
    known = F.coalesce(F.col(key), F.lit("")) != ""
    out = {count_name: F.when(known, count).otherwise(F.lit(0)).cast("bigint")}
    if sum_name:
        out[sum_name] = F.when(known, total).otherwise(F.lit(0)).cast("double")
    return scanned.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def _state_left_by_slices(rows: DataFrame, key: str, ttl: int) -> DataFrame:
    """Counters each slice inherits: what has run up, without a long silence, before it."""
    cells = rows.groupBy(key, SLICE).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_amt").alias("t"),
        F.max("_from").alias("latest"),
        F.min("_us").alias("lo"),
        F.max("_us").alias("hi"),
    )
    # A slice with a restart inside passes on what came after it; one without passes on all it
    # holds and what it inherited itself.
    along = Window.partitionBy(key).orderBy(SLICE)
    fresh = F.coalesce(F.col("lo") - F.lag("hi").over(along) > ttl, F.lit(True))
    cells = cells.select(
        key,
        SLICE,
        fresh.alias("fresh"),
        (fresh | F.col("latest").isNotNull()).cast("int").alias("restart"),
        (F.col("n") - F.coalesce(F.col("latest._no") - 1, F.lit(0))).alias("c"),
        (F.col("t") - F.coalesce("latest._all", F.lit(0))).alias("s"),
    )
    cells = cells.withColumn(
        "stretch", F.sum("restart").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    up_to = (
        Window.partitionBy(key, "stretch")
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cells = cells.withColumns({"tail_c": F.sum("c").over(up_to), "tail_s": F.sum("s").over(up_to)})
    return cells.select(
        key,
        SLICE,
        F.when(F.col("fresh"), F.lit(0)).otherwise(F.lag("tail_c").over(along)).alias("_in_cnt"),
        F.when(F.col("fresh"), F.lit(0)).otherwise(F.lag("tail_s").over(along)).alias("_in_sum"),
    )


def velocity_state(
    df: DataFrame,
    customer: str = "nameOrig",
    merchant: str = "nameDest",
    time_col: str = "timestamp",
    id_col: str = "event_id",
    amount_col: str = "amount",
    ttl_seconds: int = STATE_TTL_SECONDS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Profiles the scorer sees: customer count and amount, merchant count."""
    by_customer = activity_before(
        df, customer, time_col, id_col, amount_col, "tx_count_24h", "amount_sum_24h",
        ttl_seconds, rows_per_task,
    )
    return activity_before(
        by_customer, merchant, time_col, id_col, amount_col, "merchant_tx_count_24h", None,
        ttl_seconds, rows_per_task,
    )


def without_state(df: DataFrame) -> DataFrame:
    """Profiles when no state is kept: all zero."""
    return df.withColumns(
        {
            "tx_count_24h": F.lit(0).cast("bigint"),
            "amount_sum_24h": F.lit(0.0),
            "merchant_tx_count_24h": F.lit(0).cast("bigint"),
        }
    )


def customer_sessions(
    df: DataFrame,
    key: str = "nameOrig",
    time_col: str = "timestamp",
    id_col: str = "event_id",
    amount_col: str = "amount",
    ttl_seconds: int = STATE_TTL_SECONDS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Closed activity sessions: events, amount, start, end.

    A session starts where the counter reads 0; sessions are then numbered by running totals, so
    a key with many events is still spread over slices.
    """
    seen = activity_before(
        df.select(key, time_col, id_col, amount_col), key, time_col, id_col, amount_col,
        "_seen", None, ttl_seconds, rows_per_task,
    ).withColumn("_us", F.unix_micros(time_col))
    begins = (F.col("_seen") == 0).cast("bigint")
    numbered = running_totals(seen, [key], "_us", {"_before": begins}, id_col, rows_per_task)
    return (
        numbered.withColumn("session_no", F.col("_before") + (F.col("_seen") == 0).cast("bigint"))
        .groupBy(key, "session_no")
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            F.sum(money(F.col(amount_col))).cast("double").alias("amount_sum"),
            F.min(time_col).alias("session_start"),
            F.max(time_col).alias("session_end"),
        )
    )


def rolling_window(
    df: DataFrame,
    key: str = "nameOrig",
    time_col: str = "timestamp",
    id_col: str = "event_id",
    amount_col: str = "amount",
    seconds: int = STATE_TTL_SECONDS,
    count_name: str = "tx_count_rolling",
    sum_name: str = "amount_sum_rolling",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Count and amount of the key's events in ``[t - seconds, t)``.

    Ordinary keys take one range window. For a key too large for a task, rows enter at their time
    and leave ``seconds`` later: the window is a difference of running totals, which are cut into
    slices. Amounts are decimals, so both ways give the same numbers.
    """
    span = seconds * MICROS
    timed = df.withColumns(
        {
            "_us": F.unix_micros(time_col),
            "_amt": F.coalesce(money(F.col(amount_col)), money(F.lit(0))),
        }
    )
    hot = find_hot_groups(df, [key], rows_per_task)
    if hot is None:
        return _rolling_by_range(timed, key, span, count_name, sum_name, df.columns)
    hot_keys = hot.keys.alias("b")
    ordinary = timed.alias("a").join(hot_keys, same_keys([key]), "left_anti")
    large = timed.alias("a").join(hot_keys, same_keys([key]), "left_semi")
    # Even order values look, odd ones change the totals: a look at t sees what entered before t
    # and what leaves at t or later. Only the look carries the row.
    row = F.struct(*[F.col(c) for c in df.columns])
    step = lambda at, n, amt, payload: F.struct(
        at.alias("_at"), F.lit(n).cast("bigint").alias("_n"), money(amt).alias("_a"), payload.alias("_row")
    )
    nothing = F.when(F.lit(False), row)
    steps = large.select(
        key,
        id_col,
        F.inline(
            F.array(
                step(2 * F.col("_us"), 0, F.lit(0), row),
                step(2 * F.col("_us") + 1, 1, F.col("_amt"), nothing),
                step(2 * (F.col("_us") + span) + 1, -1, -F.col("_amt"), nothing),
            )
        ),
    )
    changes = {count_name: F.col("_n"), sum_name: F.col("_a")}
    totals = running_totals(steps, [key], "_at", changes, id_col, rows_per_task)
    looks = totals.where(F.col("_row").isNotNull()).select(
        "_row.*", count_name, F.col(sum_name).cast("double").alias(sum_name)
    )
    plain = _rolling_by_range(ordinary, key, span, count_name, sum_name, df.columns)
    return plain.unionByName(looks)


def _rolling_by_range(timed, key, span, count_name, sum_name, columns) -> DataFrame:
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-span, -1)
    return timed.select(
        *columns,
        F.count(F.lit(1)).over(w).alias(count_name),
        F.coalesce(F.sum("_amt").over(w), F.lit(0)).cast("double").alias(sum_name),
    )
