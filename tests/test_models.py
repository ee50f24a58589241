"""Model fitting, search, stacking, importance, persistence."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.models import importance as imp
from ledgerlens.models import stacking as stk
from ledgerlens.models.bundle import Bundle
from ledgerlens.operators import metrics as met
from ledgerlens.plans import learning

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    encoder, rows = learning.prepared(spark, SF)
    return encoder, rows, learning.stack(spark, SF)


def test_stack_learns(fitted):
    _, rows, stack = fitted
    m = stack.evaluate(rows["test"]).first()
    assert m["roc_auc"] > 0.95 and m["pr_auc"] > 0.8
    assert 0 < stack.threshold < 1 and stack.rounds["gbt"] <= learning.PARAMS["gbt"]["maxIter"]


def test_fit_is_reproducible(fitted):
    _, rows, _ = fitted
    scores = [
        stk.pr_auc(stk.probability(stk.fit_learner("rf", learning.PARAMS["rf"], rows["train"]), rows["test"], "p"), "p")
        for _ in range(2)
    ]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_bundle_round_trip(spark, fitted, tmp_path):
    encoder, _, stack = fitted
    bundle = Bundle.of(encoder, stack, model_version="v7")
    bundle.save(str(tmp_path / "b"))
    again = Bundle.load(spark, str(tmp_path / "b"))
    assert again.feature_names == bundle.feature_names and again.model_version == "v7"
    assert again.policy == bundle.policy
    df = learning.frame(spark, SF).drop("split").limit(500)
    a = {r["event_id"]: r["score"] for r in bundle.score(df).select("event_id", "score").collect()}
    b = {r["event_id"]: r["score"] for r in again.score(df).select("event_id", "score").collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values())


def test_feature_names_follow_the_order(fitted):
    encoder, _, _ = fitted
    kinds = [n.split("__")[0] for n in encoder.feature_names]
    assert kinds == sorted(kinds, key=["num", "low_card", "orig", "high_card"].index)
    numeric = [n for n in encoder.feature_names if n.startswith("num__")]
    assert numeric == sorted(numeric)


def test_permutation_importance_finds_the_signal(fitted):
    encoder, rows, stack = fitted
    out = imp.permutation_importance(
        stack.base["rf"], rows["test"], encoder.feature_names, repeats=1, metric="pr_auc"
    ).collect()
    assert len(out) == len(encoder.feature_names)
    assert {r["feature"] for r in out[:3]} & {"num__amount", "high_card__nameDest__enc"}


def test_blend_weights():
    w = met.blend_weights({"a": 2.0, "b": -1.0, "c": 6.0})
    assert w["b"] == 0 and math.isclose(sum(w.values()), 1.0, abs_tol=1e-9)


def test_one_class_is_refused(fitted):
    _, rows, _ = fitted
    with pytest.raises(ValueError):
        stk.weighted(rows["train"].where(F.col("label") == 0))


def test_unknown_learner():
    with pytest.raises(ValueError):
        stk.build_learner("svm", {})
