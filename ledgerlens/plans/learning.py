"""Model queries: fitted on the tables' own events, checked by invariants where no SQL exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.models import importance as imp
from ledgerlens.models import stacking as stk
from ledgerlens.models.bundle import Bundle
from ledgerlens.models.encoder import EventEncoder, TimeAwareTargetEncoder
from ledgerlens.operators import features as feat
from ledgerlens.operators import metrics as met
from ledgerlens.operators import policy as pol
from ledgerlens.operators import split as spl
from ledgerlens.plans.base import query, rounded, table, tx, with_tx
from ledgerlens.plans.training import DAYS, TRAINING, _state_sql, coded
from ledgerlens.session import materialize, scratch_path, spread

LABEL = "isMoneyLaundering"
PARAMS = stk.DEFAULTS
_COLS = (
    "event_id", "timestamp", "type", "category", "nameOrig", "nameDest", "amount", "oldbalanceOrg",
    "newbalanceOrig", "risk_risk_score", "risk_customer_risk_score", "risk_category_risk", LABEL,
)


def frame(spark: SparkSession, sf: str) -> DataFrame:
    """Features with id, instant and label next to them, and the time split.

    The events are dealt out evenly and written once: fitting passes over them many times.
    """
    base = materialize(spread(tx(spark, sf).select(*_COLS), table(spark, sf, "events").count()), "transactions")
    out = base.transform(feat.time_columns).transform(feat.time_features).transform(feat.balance_features)
    split = spl.chronological_split(out.withColumn("timestamp_ts", F.unix_seconds("timestamp")), days=DAYS)
    return split.drop("timestamp_ts")


_PREPARED: dict[tuple[str, str], tuple] = {}


def prepared(spark: SparkSession, sf: str):
    """Fitted encoder and written train, validation and test rows; shared by the model queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREPARED:
        df = frame(spark, sf)
        part = lambda name: df.where(F.col("split") == name).drop("split")
        estimator = EventEncoder(labelCol=LABEL, alpha=20.0, useLogit=True)
        encoder, train = estimator.fit_transform(part("train"))
        rows = {"train": train, "val": encoder.transform(part("val")), "test": encoder.transform(part("test"))}
        shaped = {
            n: materialize(stk.assemble(d, encoder.feature_names, LABEL, "event_id", "timestamp"), n)
            for n, d in rows.items()
        }
        _PREPARED[key] = (encoder, shaped)
    return _PREPARED[key]


_STACKS: dict[tuple[str, str], stk.StackModel] = {}


def stack(spark: SparkSession, sf: str) -> stk.StackModel:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STACKS:
        _, rows = prepared(spark, sf)
        _STACKS[key] = stk.fit_stack(rows["train"], rows["val"], stk.StackConfig(params=PARAMS))
    return _STACKS[key]


@query(
    "target_encoder_model",
    with_tx(
        """SELECT t.event_id, round(coalesce(b.enc, br.enc, ln(mu / (1 - mu))), 6) AS payment_method_enc
           FROM (SELECT *, coalesce(payment_method, 'nan') AS pm, avg("isMoneyLaundering") OVER () AS mu FROM tx) t
           LEFT JOIN st b ON b.col = 'payment_method' AND b.category = t.pm
           LEFT JOIN st br ON br.col = 'payment_method' AND br.category = 'RARE'""",
        _state_sql(20, True),
    ),
)
def target_encoder_model(spark, sf):
    """The target encoder through its estimator."""
    df = coded(spark, sf)
    how = TimeAwareTargetEncoder(cols=["nk", "payment_method"], labelCol=LABEL, alpha=float(TRAINING.alpha), useLogit=True)
    return rounded(how.fit(df).transform(df).select("event_id", "payment_method_enc"))


@query(
    "encode_features",
    with_tx(
        """SELECT t.event_id, round(amount, 6) AS num__amount, CAST(hour(ts) AS DOUBLE) AS num__hour,
           CASE WHEN type = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS low_card__type_view,
           CASE risk_category_risk WHEN 'high' THEN 0.0::DOUBLE WHEN 'low' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS orig__risk_category_risk,
           round(ln(m.v / (1 - m.v)), 6) AS "high_card__nameDest__enc", round(ln(r.v / (1 - r.v)), 6) AS high_card__risk_category_risk__enc
           FROM re t
           JOIN (SELECT eff, greatest((sum("isMoneyLaundering") + 20 * (SELECT avg("isMoneyLaundering") FROM tx)) / (count(*) + 20), 1e-6) AS v
                 FROM re GROUP BY 1) m USING (eff)
           JOIN (SELECT risk_category_risk, (sum("isMoneyLaundering") + 20 * (SELECT avg("isMoneyLaundering") FROM tx)) / (count(*) + 20) AS v
                 FROM tx GROUP BY 1) r USING (risk_category_risk)""",
        """re AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY "nameDest") < 20 THEN 'RARE' ELSE "nameDest" END AS eff FROM tx)""",
    ),
)
def encode_features(spark, sf):
    """All encoders at once, with whole-sample target means."""
    df = frame(spark, sf).drop("split")
    model = EventEncoder(labelCol=LABEL, alpha=20.0, useLogit=True, outOfFold=False).fit(df)
    cols = [
        "num__amount", "num__hour", "low_card__type_view", "orig__risk_category_risk",
        "high_card__nameDest__enc", "high_card__risk_category_risk__enc",
    ]
    return rounded(model.transform(df).select("event_id", *cols))


@query("fit_base")
def fit_base(spark, sf):
    """Test metrics of each base learner fitted on the train split."""
    _, rows = prepared(spark, sf)
    models = stk.side_by_side([lambda n=n: stk.fit_learner(n, PARAMS[n], rows["train"], rows["val"]) for n in PARAMS])
    parts = [
        stk.probability(model, rows["test"], "score").select(F.lit(name).alias("model"), "label", "score")
        for name, model in zip(PARAMS, models, strict=True)
    ]
    return met.leaderboard(stk.all_columns(parts))


@query("tune")
def tune(spark, sf):
    """The search of every learner: its trials with their validation PR-AUC, or that of the short run they ended with."""
    _, rows = prepared(spark, sf)
    data = []
    for name in stk.LEARNERS:
        _, trials = stk.tune(name, rows["train"], rows["val"])
        data += [(name, t.number, t.value, t.short, t.stopped, t.rounds, str(sorted(t.params.items()))) for t in trials]
    return spark.createDataFrame(
        data, "model string, trial int, pr_auc double, short_pr_auc double, stopped boolean, rounds int, params string"
    )


@query("oof_meta")
def oof_meta(spark, sf):
    """Scores every training row gets from models that saw only earlier folds."""
    _, rows = prepared(spark, sf)
    out = stk.oof_meta_features(rows["train"], PARAMS)
    return out.select("event_id", "fold", "label", *[f"{n}_prob" for n in PARAMS])


@query("stack_score")
def stack_score(spark, sf):
    """Stacked scores and hard labels of the test split."""
    _, rows = prepared(spark, sf)
    return stack(spark, sf).predict(rows["test"]).select("event_id", "label", "score", "predicted")


@query("stack_leaderboard")
def stack_leaderboard(spark, sf):
    _, rows = prepared(spark, sf)
    return stack(spark, sf).leaderboard(rows["test"])


@query("blend_weights")
def blend_weights(spark, sf):
    """Weights of the simple blend, learned on validation scores."""
    _, rows = prepared(spark, sf)
    model = stack(spark, sf)
    scored = model.base_scores(rows["val"])
    weights = stk.fit_blend(scored, model.meta_cols)
    return spark.createDataFrame(sorted(weights.items()), "model string, weight double")


@query("score_batch")
def score_batch(spark, sf):
    """All events through the fitted bundle and its policy."""
    encoder, _ = prepared(spark, sf)
    bundle = Bundle.of(encoder, stack(spark, sf))
    scored = bundle.score(frame(spark, sf).drop("split"))
    return pol.scoring_outcome(scored, bundle.policy, features=["amount", "amt_to_balance"]).select(
        "event_id", "score", "verdict", "risk_band", "threshold_review", "threshold_block"
    )


@query(
    "bundle_roundtrip",
    with_tx("SELECT count(*) AS n, 0.0::DOUBLE AS largest_difference FROM tx"),
)
def bundle_roundtrip(spark, sf):
    """Save, load, score again: the same scores for every event."""
    encoder, _ = prepared(spark, sf)
    path = scratch_path(spark, "bundle")
    bundle = Bundle.of(encoder, stack(spark, sf))
    again = Bundle.ensure(spark, path, lambda: bundle)  # builds and saves
    again = Bundle.ensure(spark, path, lambda: bundle)  # loads
    df = frame(spark, sf).drop("split")
    a = bundle.score(df).select("event_id", F.col("score").alias("a"))
    b = again.score(df).select("event_id", F.col("score").alias("b"))
    return a.join(b, "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_difference")
    )


@query("feature_importance")
def feature_importance(spark, sf):
    encoder, rows = prepared(spark, sf)
    return imp.feature_importance(stack(spark, sf).base["gbt"], encoder.feature_names, rows["test"])


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Loss of accuracy on the test split when a feature is shuffled."""
    encoder, rows = prepared(spark, sf)
    model = stack(spark, sf).base["rf"]
    return imp.permutation_importance(model, rows["test"], encoder.feature_names)


@query("meta_importance")
def meta_importance(spark, sf):
    """Mean absolute contribution of each base model to the stacked log-odds."""
    from ledgerlens.operators.profiling import global_importance

    _, rows = prepared(spark, sf)
    model = stack(spark, sf)
    return global_importance(model.score(rows["test"]), model.contributions())


@query("encoding_ab")
def encoding_ab(spark, sf):
    """One learner on plain and on target-encoded categories."""
    df = frame(spark, sf)
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    encoder, shaped = EventEncoder(labelCol=LABEL, alpha=20.0, useLogit=True).fit_transform(train.drop("split"))
    numeric = ["amount", "oldbalanceOrg", "risk_risk_score", "risk_customer_risk_score", "amt_to_balance"]
    return imp.encoding_ab(
        train, test, ["type", "category", "nameDest"], numeric,
        materialize(shaped, "ab-train"), materialize(encoder.transform(test.drop("split")), "ab-test"),
        encoder.feature_names, PARAMS["gbt"], LABEL,
    )
