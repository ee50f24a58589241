"""The registered model queries run all learners with the default trials, repeats and rounds."""

from ledgerlens.models import stacking as stk
from ledgerlens.models.search import Trial
from ledgerlens.plans import learning


class _Encoder:
    feature_names = ["f"]


def test_registered_settings(spark, monkeypatch):
    rows = {n: None for n in ("train", "val", "test")}
    monkeypatch.setattr(learning, "prepared", lambda *_: (_Encoder, rows))
    calls = []

    def tune(name, train, val, **settings):
        calls.append((name, settings))
        return {}, [Trial(0, {}, 0.5)]

    monkeypatch.setattr(stk, "tune", tune)
    got = learning.tune(spark, "").collect()
    assert calls == [(n, {}) for n in stk.LEARNERS] and [r["model"] for r in got] == list(stk.LEARNERS)

    class _Stack:
        base = {"rf": None}

    seen = {}
    monkeypatch.setattr(learning, "stack", lambda *_: _Stack)
    monkeypatch.setattr(learning.imp, "permutation_importance", lambda *a, **k: seen.update(k))
    learning.permutation_importance(spark, "")
    assert "repeats" not in seen
    assert learning.PARAMS == stk.DEFAULTS and set(learning.PARAMS) == set(stk.LEARNERS)
