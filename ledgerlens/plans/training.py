"""Encoder, split and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import encoding as enc
from ledgerlens.operators import metrics as met
from ledgerlens.operators import split as spl
from ledgerlens.plans.base import query, rounded, tx, with_tx
from ledgerlens.session import materialize

LABEL = "isMoneyLaundering"
Y = '"isMoneyLaundering"'
DAYS = spl.SplitDays(test=5, val=5, gap=1)
TRAINING = enc.TargetStats(alpha=20, use_logit=True)
NK = "\"nameOrig\" || '|' || type"


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a fine-grained category, so that rare categories occur at any size."""
    return tx(spark, sf).select(
        "event_id",
        "timestamp",
        F.concat_ws("|", "nameOrig", "type").alias("nk"),
        "nameDest",
        "type",
        "risk_category_risk",
        "payment_method",
        LABEL,
    )


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp_ts", F.unix_seconds("timestamp"))


SPLIT_SQL = f"""sp AS (
  SELECT *, {Y} AS y, CASE WHEN s >= m - 432000 THEN 'test'
     WHEN s >= m - 864000 AND s < m - 432000 - 86400 THEN 'val'
     WHEN s < m - 864000 - 86400 THEN 'train' END AS split
  FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s,
               max(CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT)) OVER () AS m FROM tx))"""

FOLD_SQL = f"""fo AS (
  SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE 1 + (pos - (n - 5 * (n // 6))) // (n // 6) END AS fold
  FROM (SELECT *, {NK} AS nk, {Y} AS y, avg({Y}) OVER () AS mu,
               row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM tx))"""


@query("chrono_split", with_tx("SELECT event_id, coalesce(split, 'gap') AS split FROM sp", SPLIT_SQL))
def chrono_split(spark, sf):
    out = spl.chronological_split(_seconds(tx(spark, sf).select("event_id", "timestamp")), days=DAYS)
    return out.select("event_id", F.coalesce("split", F.lit("gap")).alias("split"))


@query(
    "describe_split",
    with_tx(
        """SELECT split, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS positive_rate
           FROM sp WHERE split IS NOT NULL GROUP BY 1""",
        SPLIT_SQL,
    ),
)
def describe_split(spark, sf):
    out = spl.chronological_split(_seconds(tx(spark, sf)), days=DAYS)
    return rounded(spl.describe_split(out, LABEL))


@query("trainval_union", with_tx("SELECT event_id FROM sp WHERE split IN ('train', 'val')", SPLIT_SQL))
def trainval_union(spark, sf):
    return spl.train_and_val(spl.chronological_split(_seconds(tx(spark, sf)), days=DAYS)).select("event_id")


@query("time_folds", with_tx("SELECT event_id, CAST(fold AS INT) AS fold FROM fo", FOLD_SQL))
def time_folds(spark, sf):
    return spl.time_folds(tx(spark, sf).select("event_id", "timestamp")).select("event_id", "fold")


def _hash_sql(seed: int, value: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {value}), 1, 15) AS BIGINT)"


@query(
    "group_split",
    with_tx(
        f"""SELECT CASE WHEN {_hash_sql(42, '"nameOrig"')} % 100 < 20 THEN 'test' ELSE 'train' END AS split,
            count(DISTINCT "nameOrig") AS groups, count(*) AS n, round(avg({Y}), 6) AS positive_rate FROM tx GROUP BY 1"""
    ),
)
def group_split(spark, sf):
    out = spl.group_split(tx(spark, sf))
    return rounded(spl.group_split_report(out, "nameOrig", LABEL))


@query(
    "hashed_sample",
    with_tx(f"SELECT event_id, risk_risk_score, {Y} FROM tx ORDER BY {_hash_sql(42, 'event_id')}, event_id LIMIT 5000"),
)
def hashed_sample(spark, sf):
    return spl.hashed_sample(tx(spark, sf).select("event_id", "risk_risk_score", LABEL), "event_id", 5000)


@query(
    "sample_with_replacement",
    with_tx(
        """SELECT event_id, draw FROM draws JOIN placed USING (pos)""",
        f"""placed AS (SELECT event_id, row_number() OVER (ORDER BY {_hash_sql(42, 'event_id')}) - 1 AS pos FROM tx)""",
        f"""draws AS (SELECT draw, {_hash_sql(43, 'draw')} % n AS pos
            FROM (SELECT n, unnest(range(2 * n)) AS draw FROM (SELECT count(*) AS n FROM tx)))""",
    ),
)
def sample_with_replacement(spark, sf):
    """Twice as many draws as there are events."""
    events = tx(spark, sf).select("event_id")
    return spl.sample_with_replacement(events, "event_id", 2 * events.count())


def _state_sql(alpha: int = 50, logit: bool = False) -> str:
    value = f"(s + {alpha} * mu) / (n + {alpha})"
    if logit:
        value = f"ln({value} / (1 - {value}))"
    return f"""cc AS (
      SELECT col, category, count(*) AS n, sum(y) AS s FROM (
        SELECT 'nk' AS col, {NK} AS category, {Y} AS y FROM tx
        UNION ALL SELECT 'payment_method', coalesce(payment_method, 'nan'), {Y} FROM tx) GROUP BY 1, 2),
    st AS (SELECT col, category, n, s, {value} AS enc FROM (
        SELECT col, CASE WHEN n < 20 THEN 'RARE' ELSE category END AS category, sum(n) AS n, sum(s) AS s,
               (SELECT avg({Y}) FROM tx) AS mu FROM cc GROUP BY 1, 2))"""


@query(
    "target_encode_fit",
    with_tx(
        """SELECT col, category, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS positives, round(enc, 6) AS enc FROM st""",
        _state_sql(),
    ),
)
def target_encode_fit(spark, sf):
    df = coded(spark, sf)
    return rounded(enc.fit_target_state(df, ["nk", "payment_method"], LABEL, enc.label_mean(df, LABEL)))


@query(
    "rare_categories",
    with_tx("SELECT col, category, n FROM cc WHERE n < 20", _state_sql()),
)
def rare_categories(spark, sf):
    return enc.rare_categories(coded(spark, sf), ["nk", "payment_method"], LABEL)


@query(
    "target_encode",
    with_tx(
        f"""SELECT t.event_id, round(coalesce(a.enc, ar.enc, ln(mu / (1 - mu))), 6) AS nk_enc,
            round(coalesce(b.enc, br.enc, ln(mu / (1 - mu))), 6) AS payment_method_enc
            FROM (SELECT *, {NK} AS nk, coalesce(payment_method, 'nan') AS pm, avg({Y}) OVER () AS mu FROM tx) t
            LEFT JOIN st a ON a.col = 'nk' AND a.category = t.nk
            LEFT JOIN st ar ON ar.col = 'nk' AND ar.category = 'RARE'
            LEFT JOIN st b ON b.col = 'payment_method' AND b.category = t.pm
            LEFT JOIN st br ON br.col = 'payment_method' AND br.category = 'RARE'""",
        _state_sql(20, True),
    ),
)
def target_encode(spark, sf):
    df = coded(spark, sf)
    cols, prior = ["nk", "payment_method"], enc.label_mean(df, LABEL)
    state = materialize(enc.fit_target_state(df, cols, LABEL, prior, TRAINING), "target-state")
    out = enc.apply_target_state(df, state, cols, prior, TRAINING)
    return rounded(out.select("event_id", "nk_enc", "payment_method_enc"))


def _causal_sql(col: str, src: str, alpha: int) -> str:
    return f"""(SELECT event_id, (coalesce(sum(y) OVER w, 0) + {alpha} * mu) / (count(*) OVER w + {alpha}) AS enc
        FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {col}) < 20 THEN 'RARE' ELSE {col} END AS eff FROM {src})
        WINDOW w AS (PARTITION BY eff ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _oof_sql(name: str, col: str, alpha: int) -> str:
    return f"""{name}_tr AS (
      SELECT b.fold, a.{col} AS c, count(*) AS n, sum(a.y) AS s, max(mu) AS mu
      FROM fo a JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold) b ON a.fold < b.fold GROUP BY 1, 2),
    {name}_st AS (
      SELECT fold, eff, (sum(s) + {alpha} * max(mu)) / (sum(n) + {alpha}) AS enc
      FROM (SELECT *, CASE WHEN n < 20 THEN 'RARE' ELSE c END AS eff FROM {name}_tr) GROUP BY 1, 2),
    {name}_first AS (SELECT * FROM fo WHERE fold = 0),
    {name} AS (
      SELECT f.event_id, coalesce(o.enc, r.enc, f.mu) AS enc FROM fo f
      LEFT JOIN {name}_st o ON o.fold = f.fold AND o.eff = f.{col} AND o.eff <> 'RARE'
      LEFT JOIN {name}_st r ON r.fold = f.fold AND r.eff = 'RARE' WHERE f.fold > 0
      UNION ALL SELECT event_id, enc FROM {_causal_sql(col, name + "_first", alpha)})"""


@query(
    "causal_loo",
    with_tx(f"SELECT event_id, round(enc, 6) AS nk_enc FROM {_causal_sql('nk', 'fo', 50)}", FOLD_SQL),
)
def causal_loo(spark, sf):
    df = coded(spark, sf)
    out = enc.causal_target_means(df, ["nk"], LABEL, enc.label_mean(df, LABEL))
    return rounded(out.select("event_id", "nk_enc"))


@query(
    "oof_target_encode",
    with_tx(
        """SELECT event_id, round(a.enc, 6) AS nk_enc, round(b.enc, 6) AS "nameDest_enc"
           FROM a JOIN b USING (event_id)""",
        FOLD_SQL,
        _oof_sql("a", "nk", 20),
        _oof_sql("b", '"nameDest"', 20),
    ),
)
def oof_target_encode(spark, sf):
    df = coded(spark, sf)
    out = enc.oof_target_encode(df, ["nk", "nameDest"], LABEL, how=enc.TargetStats(alpha=20))
    return rounded(out.select("event_id", "nk_enc", "nameDest_enc"))


@query(
    "sigmoid_target_encode",
    with_tx(
        f"""SELECT t.event_id, round(coalesce(mu * (1 - w) + m * w, mu), 6) AS payment_method_enc
            FROM (SELECT *, avg({Y}) OVER () AS mu FROM tx) t
            LEFT JOIN (SELECT payment_method, avg({Y}) AS m, 1 / (1 + exp(-(count(*) - 50) / 20.0)) AS w
                       FROM tx WHERE payment_method IS NOT NULL GROUP BY 1) s USING (payment_method)"""
    ),
)
def sigmoid_target_encode(spark, sf):
    df = coded(spark, sf)
    state, prior = enc.sigmoid_state(df, ["payment_method"], LABEL)
    out = enc.apply_sigmoid_state(df, state, ["payment_method"], prior)
    return rounded(out.select("event_id", "payment_method_enc"))


_GAPPY = """gap AS (SELECT *, CASE WHEN payment_method IS NOT NULL THEN amount END AS a FROM tx)"""


def _gappy(spark, sf):
    a = F.when(F.col("payment_method").isNotNull(), F.col("amount"))
    return tx(spark, sf).select("event_id", a.alias("a"), "payment_method")


@query(
    "impute_median",
    with_tx("SELECT event_id, round(coalesce(a, (SELECT median(a) FROM gap)), 6) AS a FROM gap", _GAPPY),
)
def impute_median(spark, sf):
    df = _gappy(spark, sf)
    return rounded(enc.impute(df, enc.fit_medians(df, ["a"])).select("event_id", "a"))


@query(
    "robust_scale",
    with_tx(
        """SELECT event_id, round((amount - m) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS amount
           FROM tx, (SELECT median(amount) AS m, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS r FROM tx)"""
    ),
)
def robust_scale(spark, sf):
    df = tx(spark, sf).select("event_id", "amount")
    return rounded(enc.robust_scale(df, enc.fit_robust_scale(df, ["amount"])))


@query(
    "impute_mode",
    with_tx(
        """SELECT event_id, coalesce(payment_method, (SELECT payment_method FROM tx WHERE payment_method IS NOT NULL
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS payment_method FROM tx"""
    ),
)
def impute_mode(spark, sf):
    df = tx(spark, sf).select("event_id", "payment_method")
    modes = {r["col"]: r["value"] for r in enc.most_frequent(df, ["payment_method"]).collect()}
    return enc.impute_most_frequent(df, modes)


@query(
    "one_hot",
    with_tx(
        "SELECT event_id, "
        + ", ".join(
            f"CASE WHEN type = '{t}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS low_card__type_{t}"
            for t in ("click", "error", "purchase", "signup", "view")
        )
        + " FROM tx"
    ),
)
def one_hot(spark, sf):
    df = tx(spark, sf).select("event_id", "type")
    cats = {c: [v for v, _ in vs] for c, vs in enc.category_lists(df, ["type"]).items()}
    return enc.one_hot(df, cats).drop("type")


@query(
    "ordinal_encode",
    with_tx(
        """SELECT event_id, CAST(coalesce(c.code, (SELECT count(*) FROM freq)) AS DOUBLE) AS "orig__merchant"
           FROM (SELECT event_id, "nameDest" AS v FROM tx) t
           LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM freq) c USING (v)""",
        """freq AS (SELECT "nameDest" AS v FROM tx GROUP BY 1 HAVING count(*) >= 100)""",
    ),
)
def ordinal_encode(spark, sf):
    """Merchants with at least 100 events get their own code, the others share the last one."""
    df = tx(spark, sf).select("event_id", F.col("nameDest").alias("merchant"))
    state = enc.ordinal_state(df, ["merchant"], 100)
    return enc.ordinal_encode(df, state, ["merchant"]).drop("merchant")


@query(
    "class_weights",
    with_tx(
        f"""SELECT round(neg / pos, 6) AS scale_pos_weight, round((neg + pos) / (2 * neg), 6) AS weight_negative,
            round((neg + pos) / (2 * pos), 6) AS weight_positive
            FROM (SELECT CAST(sum({Y}) AS DOUBLE) AS pos, CAST(sum(1 - {Y}) AS DOUBLE) AS neg FROM tx)"""
    ),
)
def class_weights(spark, sf):
    return rounded(enc.class_weights(tx(spark, sf), LABEL))


CURVE_SQL = f"""g AS (SELECT score, sum({Y}) AS p, sum(1 - {Y}) AS q FROM tx GROUP BY 1),
  cu AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS an
         FROM g WINDOW w AS (ORDER BY score DESC))"""
RANK_SQL = """round(sum(p * tp / (tp + fp)) / max(ap), 6) AS pr_auc,
              round(sum(q * (tp - p + p / 2.0)) / (max(ap) * max(an)), 6) AS roc_auc"""


def _scored(spark, sf):
    return tx(spark, sf).select("event_id", F.col(LABEL).alias("label"), "score")


@query("average_precision", with_tx("SELECT round(sum(p * tp / (tp + fp)) / max(ap), 6) AS pr_auc FROM cu", CURVE_SQL))
def average_precision(spark, sf):
    return rounded(met.average_precision(_scored(spark, sf)))


@query("roc_auc", with_tx("SELECT round(sum(q * (tp - p + p / 2.0)) / (max(ap) * max(an)), 6) AS roc_auc FROM cu", CURVE_SQL))
def roc_auc(spark, sf):
    return rounded(met.roc_auc(_scored(spark, sf)))


@query(
    "pr_curve",
    with_tx(
        "SELECT score AS threshold, tp / (tp + fp) AS precision, tp / ap AS recall FROM cu",
        CURVE_SQL,
    ),
)
def pr_curve(spark, sf):
    return met.pr_curve(_scored(spark, sf))


CONFUSION_SQL = f"""cf AS (SELECT count(*) FILTER ({Y} = 0 AND score < 0.5) AS tn,
    count(*) FILTER ({Y} = 0 AND score >= 0.5) AS fp, count(*) FILTER ({Y} = 1 AND score < 0.5) AS fn,
    count(*) FILTER ({Y} = 1 AND score >= 0.5) AS tp FROM tx)"""


@query(
    "confusion_matrix",
    with_tx(
        """SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cf""",
        CONFUSION_SQL,
    ),
)
def confusion_matrix(spark, sf):
    return rounded(met.confusion(_scored(spark, sf)))


@query(
    "binary_metrics",
    with_tx(
        f"SELECT {RANK_SQL}, (SELECT round(2 * tp / (2 * tp + fp + fn), 6) FROM cf) AS f1 FROM cu",
        CURVE_SQL,
        CONFUSION_SQL,
    ),
)
def binary_metrics(spark, sf):
    return rounded(met.binary_metrics(_scored(spark, sf)))


GRID_SQL = f"""grid AS (SELECT t / 100.0::DOUBLE AS th FROM range(1, 100) r(t)),
  gr AS (SELECT th, count(*) FILTER (score >= th AND {Y} = 1) AS tp, count(*) FILTER (score >= th AND {Y} = 0) AS fp,
                count(*) FILTER ({Y} = 1) AS ap FROM grid, tx GROUP BY 1)"""


@query(
    "best_threshold_grid",
    with_tx(
        """SELECT * FROM (SELECT 'f1' AS metric, round(th, 6) AS threshold, round(2 * tp / (tp + fp + ap), 6) AS value
             FROM gr ORDER BY 2 * tp / (tp + fp + ap) DESC, th LIMIT 1)
           UNION ALL SELECT * FROM (SELECT 'precision', round(th, 6), round(tp / greatest(tp + fp, 1), 6)
             FROM gr ORDER BY tp / greatest(tp + fp, 1) DESC, th LIMIT 1)
           UNION ALL SELECT * FROM (SELECT 'recall', round(th, 6), round(tp / greatest(ap, 1), 6)
             FROM gr ORDER BY tp / greatest(ap, 1) DESC, th LIMIT 1)""",
        GRID_SQL,
    ),
)
def best_threshold_grid(spark, sf):
    return rounded(met.best_thresholds(_scored(spark, sf)))


@query(
    "best_f1_threshold",
    with_tx(
        """SELECT round(score, 9) AS threshold, round(f1, 6) AS f1 FROM (
             SELECT score, 2 * (tp / (tp + fp)) * (tp / ap) / greatest(tp / (tp + fp) + tp / ap, 1e-12) AS f1 FROM cu)
           ORDER BY f1 DESC, score LIMIT 1""",
        CURVE_SQL,
    ),
)
def best_f1_threshold(spark, sf):
    out = met.best_f1_threshold(_scored(spark, sf))
    return out.select(F.round("threshold", 9).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(
    "threshold_at_fpr",
    with_tx(
        """SELECT round(score, 9) AS threshold, round(tp / ap, 6) AS recall FROM (
             SELECT *, row_number() OVER w AS i, lead(p) OVER w AS lp, lead(q) OVER w AS lq FROM cu
             WINDOW w AS (ORDER BY score DESC))
           WHERE fp / an <= 0.01 AND (i = 1 OR lp IS NULL OR lp <> p OR lq <> q) ORDER BY i DESC LIMIT 1""",
        CURVE_SQL,
    ),
)
def threshold_at_fpr(spark, sf):
    out = met.threshold_at_fpr(_scored(spark, sf))
    return out.select(F.round("threshold", 9).alias("threshold"), F.round("recall", 6).alias("recall"))


@query(
    "minmax_scores",
    with_tx(
        """SELECT event_id, round((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 6) AS scaled
           FROM (SELECT event_id, (amount - 9000) / 2500 AS m FROM tx)"""
    ),
)
def minmax_scores(spark, sf):
    df = tx(spark, sf).select("event_id", ((F.col("amount") - 9000) / 2500).alias("margin"))
    return rounded(met.minmax(df, "margin").select("event_id", "scaled"))


@query(
    "leaderboard",
    with_tx(
        """SELECT model, round(sum(q * (tp - p + p / 2.0)) / (max(ap) * max(an)), 6) AS roc_auc,
             round(sum(p * tp / (tp + fp)) / max(ap), 6) AS pr_auc,
             round(coalesce(max_by(2 * tp / (tp + fp + ap), -score) FILTER (score >= cut), 0), 6) AS f1_05
           FROM mc GROUP BY 1""",
        f"""long AS (SELECT 'amount' AS model, {Y} AS y, score FROM tx
             UNION ALL SELECT 'risk', {Y}, risk_risk_score / 100 FROM tx
             UNION ALL SELECT 'mixed', {Y}, (score + risk_customer_risk_score / 100) / 2 FROM tx)""",
        """mc AS (SELECT *, 0.5 AS cut, sum(p) OVER w AS tp, sum(q) OVER w AS fp,
             sum(p) OVER (PARTITION BY model) AS ap, sum(q) OVER (PARTITION BY model) AS an
           FROM (SELECT model, score, sum(y) AS p, sum(1 - y) AS q FROM long GROUP BY 1, 2)
           WINDOW w AS (PARTITION BY model ORDER BY score DESC))""",
    ),
)
def leaderboard(spark, sf):
    df = tx(spark, sf)
    long = df.select(
        F.col(LABEL).alias("label"),
        F.inline(
            F.array(
                F.struct(F.lit("amount").alias("model"), F.col("score").alias("score")),
                F.struct(F.lit("risk").alias("model"), (F.col("risk_risk_score") / 100).alias("score")),
                F.struct(
                    F.lit("mixed").alias("model"),
                    ((F.col("score") + F.col("risk_customer_risk_score") / 100) / 2).alias("score"),
                ),
            )
        ),
    )
    return rounded(met.leaderboard(long))


@query(
    "weighted_blend",
    with_tx(
        "SELECT event_id, round(0.5 * score + 0.3 * risk_risk_score / 100 + 0.2 * risk_customer_risk_score / 100, 6) AS blend FROM tx"
    ),
)
def weighted_blend(spark, sf):
    df = tx(spark, sf).select(
        "event_id",
        "score",
        (F.col("risk_risk_score") / 100).alias("risk"),
        (F.col("risk_customer_risk_score") / 100).alias("customer"),
    )
    out = met.weighted_blend(df, {"score": 0.5, "risk": 0.3, "customer": 0.2}, "blend")
    return rounded(out.select("event_id", "blend"))
