"""Column profiles and exploratory aggregates; each is one pass unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ordered import ROWS_PER_TASK, exact_quantiles, same_keys

# Widest range per integer type, tolerance for single precision.
INT_TYPES = (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31))
FLOAT_TOLERANCE = 5e-4
DICTIONARY_SHARE = 0.5
LOW_CARD_MAX = 8


def narrow_types(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Report ``(column, narrowest, dict_encode)``: the smallest type that holds each column.

    One aggregation over all columns; distinct shares come from a mergeable sketch.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    kinds: dict[str, str] = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            kinds[f.name] = "int"
            aggs += [F.min(c).cast("bigint").alias(f"lo_{f.name}"), F.max(c).cast("bigint").alias(f"hi_{f.name}")]
        elif isinstance(f.dataType, T.FractionalType):
            kinds[f.name] = "float"
            x = c.cast("double")
            aggs.append(F.max(F.abs(x - x.cast("float").cast("double"))).alias(f"err_{f.name}"))
        elif isinstance(f.dataType, T.StringType):
            kinds[f.name] = "text"
            aggs.append(F.approx_count_distinct(c, rsd).alias(f"d_{f.name}"))
        else:
            kinds[f.name] = f.dataType.simpleString()
    rows = []
    for name, kind in kinds.items():
        shrink, encode = F.lit(kind), F.lit(False)
        if kind == "int":
            shrink = F.lit("bigint")
            for t, bound in reversed(INT_TYPES):
                fits = (F.col(f"lo_{name}") >= -bound) & (F.col(f"hi_{name}") < bound)
                shrink = F.when(fits, F.lit(t)).otherwise(shrink)
        elif kind == "float":
            shrink = F.when(F.col(f"err_{name}") <= FLOAT_TOLERANCE, "float").otherwise("double")
        elif kind == "text":
            shrink = F.lit("string")
            encode = F.col(f"d_{name}") / F.col("_n") < DICTIONARY_SHARE
        rows.append(F.struct(F.lit(name).alias("column"), shrink.alias("narrowest"), encode.alias("dict_encode")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def cast_narrow(df: DataFrame, report: DataFrame) -> DataFrame:
    """Apply the integer part of the report (one line per column)."""
    small = {r["column"]: r["narrowest"] for r in report.collect()}
    ints = {t for t, _ in INT_TYPES}
    return df.withColumns({c: F.col(c).cast(t) for c, t in small.items() if t in ints})


def profile_columns(df: DataFrame, cols: Sequence[str], low_max: int = LOW_CARD_MAX) -> DataFrame:
    """``(column, role, dual)``: low_card, ordinal (low, 'risk' in the name) or high_card.

    A sketch sorts out the clearly high columns; only the rest are counted exactly, with sets
    that are small by then. Ordinal columns are target-encoded as well (``dual``).
    """
    sketch = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first()
    near = [c for c in cols if sketch[c] <= 4 * low_max]
    exact = {}
    if near:
        row = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in near]).first()
        exact = {c: row[c] for c in near}
    rows = []
    for c in cols:
        low = exact.get(c, low_max + 1) <= low_max
        role = ("ordinal" if "risk" in c else "low_card") if low else "high_card"
        rows.append((c, role, exact.get(c) if low else None, role == "ordinal"))
    return df.sparkSession.createDataFrame(rows, "column string, role string, distinct_values int, dual boolean")


def missing_counts(df: DataFrame, top: int = 15) -> DataFrame:
    """Columns with missing values, most first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns]))
    return counts.select(pairs).where("missing > 0").orderBy(F.desc("missing"), "column").limit(top)


def describe_numeric(df: DataFrame, cols: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one line per column."""
    from ledgerlens.operators.encoding import quantile_table

    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    df = df.select(*[number(c).alias(c) for c in cols])  # NaN is a missing value
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])))
    plain = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = quantile_table(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, rows_per_task)
    return plain.join(quartiles, "column", "left")


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Share of each class in percent."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") * 100 / F.col("total")).alias("share"))


def type_stats(df: DataFrame, label: str, key: str = "type") -> DataFrame:
    """Volume and label rate per type, highest rate first."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("tx_count"), F.avg(label).alias("laundering_rate"))
        .orderBy(F.desc("laundering_rate"), key)
    )


def hourly_profile(df: DataFrame, label: str, hour: str = "hour") -> DataFrame:
    return df.groupBy(hour).agg(F.avg(label).alias("laundering_rate"), F.count(F.lit(1)).alias("volume"))


def user_view(df: DataFrame, label: str, key: str = "nameOrig", top: int = 10) -> DataFrame:
    """Customers with the most cases.

    Distinct counts are taken over (key, value) pairs first, so a busy customer is spread out.
    """
    counts = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.sum(label).cast("bigint").alias("laundering_cases"),
        F.avg(label).alias("laundering_rate"),
        F.avg("amount").alias("avg_amount"),
        F.countDistinct("nameDest").alias("unique_merchants"),
        F.countDistinct("device_type").alias("device_diversity"),
    )
    return counts.orderBy(F.desc("laundering_cases"), key).limit(top)


def amount_histogram(df: DataFrame, label: str, amount: str = "amount", bins: int = 50) -> DataFrame:
    """Density of log10(amount + 1) per class over common bins, each class summing to one."""
    x = F.log10(F.col(amount) + 1)
    logs = df.select(F.col(label).alias("class"), x.alias("x"))
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    spread = logs.crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    cells = spread.groupBy("class", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("width"))
    totals = cells.groupBy("class").agg(F.sum("n").alias("total"))
    return cells.join(F.broadcast(totals), "class").select(
        "class", "bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density")
    )


def _attach(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Group figures back on the rows; rows without a key get none."""
    return df.alias("a").join(stats.where(F.col(key).isNotNull()).alias("b"), same_keys([key]), "left").select(
        "a.*", *[F.col(f"b.{c}") for c in stats.columns if c != key]
    )


def user_features(df: DataFrame, key: str = "nameOrig", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Customer count, median, deviation, distinct partners and devices, amount over median.

    Aggregated per customer and joined back: group figures do not need a window. The median is
    exact and counted by value, so a customer with most of the rows is not gathered anywhere.
    """
    stats = df.groupBy(key).agg(
        F.count("step").alias("user_tx_count"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("user_amount_std"),
        F.countDistinct("nameDest").alias("user_unique_merchants"),
        F.countDistinct("device_type").alias("user_device_diversity"),
    )
    median = exact_quantiles(df, [key], "amount", {"user_amount_median": 0.5}, rows_per_task)
    out = _attach(df, stats.join(median, key, "left"), key)
    return out.withColumn("amt_to_user_median", F.col("amount") / (F.col("user_amount_median") + 1e-3))


def merchant_features(df: DataFrame, key: str = "merch_merchant_id") -> DataFrame:
    """Merchant count and amount over the merchant's mean."""
    stats = df.groupBy(key).agg(F.count("amount").alias("merchant_tx_count"), F.avg("amount").alias("_mean"))
    out = _attach(df, stats, key)
    return out.withColumn("amt_to_merchant_avg", F.col("amount") / (F.col("_mean") + 1e-3)).drop("_mean")


def ip_features(df: DataFrame, key: str = "device_ip_address") -> DataFrame:
    """Events per network address."""
    return _attach(df, df.groupBy(key).agg(F.count("step").alias("ip_activity_rank")), key)


def drift(
    df: DataFrame,
    column: str,
    period: str,
    bins: int = 10,
    eps: float = 1e-6,
) -> DataFrame:
    """Population stability index and Jensen-Shannon divergence of a number between two periods.

    ``period`` holds 'base' and 'current'. Bins are equal widths over the base range; one count
    per (period, bin) is all that is shuffled.
    """
    ends = df.where(F.col(period) == "base").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor((F.col(column) - F.col("lo")) / width)
    place = F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")
    cells = (
        df.crossJoin(F.broadcast(ends))
        .groupBy(place.alias("bin"))
        .agg(F.count_if(F.col(period) == "base").alias("b"), F.count_if(F.col(period) == "current").alias("c"))
    )
    total = cells.agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    share = cells.crossJoin(F.broadcast(total)).select(
        F.greatest(F.col("b") / F.col("nb"), F.lit(eps)).alias("p"),
        F.greatest(F.col("c") / F.col("nc"), F.lit(eps)).alias("q"),
    )
    m = (F.col("p") + F.col("q")) / 2
    return share.agg(
        F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"),
        F.sum((F.col("p") * F.ln(F.col("p") / m) + F.col("q") * F.ln(F.col("q") / m)) / 2).alias("js"),
    )


def category_drift(df: DataFrame, column: str, period: str, min_count: int = 20) -> DataFrame:
    """Share of current events whose category was rare or unseen in the base period, one row."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("category")).agg(
        F.count_if(F.col(period) == "base").alias("b"), F.count_if(F.col(period) == "current").alias("c")
    )
    return counts.agg(
        (F.sum(F.when(F.col("b") < min_count, F.col("c")).otherwise(0)) / F.sum("c")).alias("rare_share"),
        (F.sum(F.when(F.col("b") == 0, F.col("c")).otherwise(0)) / F.sum("c")).alias("unseen_share"),
    )


def flag_suspicious(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Mark feature names that hint at label leakage."""
    # The tokens that make a feature name suspicious.
    tokens = (
        "target", "label", "fraud", "is_fraud", "isfraud", "_te", "rate", "leak", "future", "post_", "after_",
    )
    return df.withColumn("suspicious", F.lower(F.col(feature)).rlike("|".join(tokens)))


def global_importance(df: DataFrame, contributions: dict[str, Column], top: int = 20, normalize: str | None = "max") -> DataFrame:
    """Mean absolute contribution per feature, largest first, scaled to the largest or the sum."""
    means = df.agg(*[F.avg(F.abs(c)).alias(n) for n, c in contributions.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in contributions])
    ranked = means.select(F.inline(pairs)).orderBy(F.desc("importance"), "feature").limit(top)
    if normalize is None:
        return ranked.withColumn("imp_norm", F.col("importance"))
    fold = F.max if normalize == "max" else F.sum
    scale = ranked.agg(fold("importance").alias("_scale"))
    base = F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(F.lit(1.0))
    return (
        ranked.crossJoin(F.broadcast(scale))
        .withColumn("imp_norm", F.col("importance") / base)
        .drop("_scale")
        .orderBy(F.desc("importance"), "feature")
    )
