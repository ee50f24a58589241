"""A stack fits only the parts a query reads, each once; the encoder asks only for the quantiles it uses."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.models import encoder as enc
from ledgerlens.models import stacking as stk


class _Rows:
    def unionByName(self, other):
        return self


@pytest.fixture
def fits(monkeypatch):
    made = []

    def fit(name, params, train, val=None, *_):
        made.append((name, "first" if val is not None else "final", params.get("maxIter")))
        return name

    monkeypatch.setattr(stk, "fit_learner", fit)
    monkeypatch.setattr(stk, "count_classes", lambda *_: (1, 1))
    monkeypatch.setattr(stk, "rounds", lambda name, model, params: 7 if name == "gbt" else None)
    monkeypatch.setattr(stk, "oof_meta_features", lambda *_: made.append("folds"))
    monkeypatch.setattr(stk, "fit_meta", lambda *_: "meta")
    return made


def test_one_base_model_needs_no_other(fits):
    stack = stk.fit_stack(_Rows(), _Rows(), stk.StackConfig(params=stk.DEFAULTS))
    assert fits == []
    assert stack.base["rf"] == "rf" and fits == [("rf", "final", None)]
    assert stack.base["gbt"] == "gbt" and fits[1:] == [("gbt", "first", 100), ("gbt", "final", 7)]
    assert dict(stack.base) == {n: n for n in stk.LEARNERS} and "folds" not in fits


def test_parts_are_fitted_once_and_folds_next_to_them(fits, monkeypatch):
    meet = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(stk, "oof_meta_features", lambda *_: (meet.wait(), fits.append("folds")))
    plain = stk.fit_learner

    def slow(name, params, train, val=None, *a):
        if name == "gbt" and val is not None:
            meet.wait()  # ends only if the folds are fitted at the same time
        return plain(name, params, train, val, *a)

    monkeypatch.setattr(stk, "fit_learner", slow)
    stack = stk.fit_stack(_Rows(), _Rows(), stk.StackConfig(params=stk.DEFAULTS))
    stack.fit_all()
    stack.fit_all()
    assert len(fits) == 7 and len(set(fits)) == 7 and stack.rounds["gbt"] == 7


@pytest.mark.parametrize("scale, names", [(False, {"m"}), (True, {"q1", "m", "q3"})])
def test_encoder_asks_for_the_quantiles_it_uses(spark, monkeypatch, scale, names):
    seen = []
    plain = enc.enc.quantile_table
    monkeypatch.setattr(enc.enc, "quantile_table", lambda df, cols, probs: seen.append(set(probs)) or plain(df, cols, probs))
    df = spark.range(9).select(
        F.col("id").alias("event_id"), F.col("id").cast("double").alias("amount"), (F.col("id") % 2).alias("isMoneyLaundering")
    )
    fitted = enc.EventEncoder(scale=scale).fit(df).fitted
    assert seen == [names] and fitted["medians"] == {"amount": 4.0}
    assert fitted["ranges"] == ({"amount": 4.0} if scale else None)
