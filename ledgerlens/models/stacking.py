"""Base learners, time-ordered stacking, search, and evaluation on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.models.search import Search, Trial
from ledgerlens.models.staged import best_round, boost
from ledgerlens.operators import metrics as met
from ledgerlens.operators.encoding import all_columns, count_classes
from ledgerlens.operators.split import time_folds
from ledgerlens.session import materialize

LEARNERS = ("gbt", "rf", "lr")
WEIGHT = "_weight"
# Rounds after which a search first looks at boosted trees.
SHORT_ROUNDS = 10

DEFAULTS: dict[str, dict[str, Any]] = {
    "gbt": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8},
    "rf": {"numTrees": 100, "maxDepth": 8, "subsamplingRate": 0.8},
    "lr": {"maxIter": 100, "regParam": 1e-3, "elasticNetParam": 0.0},
}


def build_learner(name: str, params: dict[str, Any], seed: int = 42):
    """A weighted learner."""
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": WEIGHT}
    if name == "gbt":
        return GBTClassifier(**common, **params, seed=seed)
    if name == "rf":
        return RandomForestClassifier(**common, **params, seed=seed)
    if name == "lr":
        return LogisticRegression(**common, **params)
    raise ValueError(f"unknown learner: {name}")


def weighted(df: DataFrame, scheme: str = "balanced", counts: tuple[int, int] | None = None) -> DataFrame:
    """Class weights; both classes must be present. ``counts`` (negative, positive) saves counting them."""
    neg, pos = counts or count_classes(df, "label")
    if not neg:
        raise ValueError("both classes are needed")
    if scheme == "balanced":
        w_neg, w_pos = (neg + pos) / (2 * neg), (neg + pos) / (2 * pos)
    else:
        w_neg, w_pos = 1.0, neg / pos
    return df.withColumn(WEIGHT, F.when(F.col("label") == 1, w_pos).otherwise(w_neg))


def assemble(df: DataFrame, features: Sequence[str], label: str, *keep: str) -> DataFrame:
    """Label and feature vector."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)
    return rows.select(*keep, F.col(label).cast("double").alias("label"), "features")


def probability(model, df: DataFrame, name: str) -> DataFrame:
    """Positive-class probability as a plain column."""
    out = model.transform(df)
    extra = [c for c in ("rawPrediction", "probability", "prediction") if c in out.columns]
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*extra)


def fit_learner(
    name: str,
    params: dict[str, Any],
    train: DataFrame,
    val: DataFrame | None = None,
    seed: int = 42,
    counts: tuple[int, int] | None = None,
):
    """Fit one learner; with validation rows, boosting keeps the rounds with the best PR-AUC on them."""
    rows = weighted(train, "balanced" if name == "rf" else "ratio", counts)
    if name == "gbt" and val is not None:
        most = params.get("maxIter", DEFAULTS["gbt"]["maxIter"])
        return boost(lambda n: build_learner(name, params | {"maxIter": n}, seed).fit(rows), most, val)[0]
    return build_learner(name, params, seed).fit(rows)


def rounds(name: str, model, params: dict[str, Any]) -> int | None:
    return model.getNumTrees if name in ("gbt", "rf") else None


def pr_auc(df: DataFrame, score: str) -> float:
    return float(met.average_precision(df, "label", score).first()["pr_auc"] or 0.0)


def side_by_side(jobs: Sequence[Callable[[], Any]], parallelism: int = 4) -> list[Any]:
    """Results of jobs that run at the same time; each is a series of small Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def judge(models: dict[int, Any], df: DataFrame) -> dict[int, float]:
    """PR-AUC of several models on the same rows, in one grouped pass."""
    parts = [probability(m, df, "p").select(F.lit(i).alias("trial"), "label", "p") for i, m in models.items()]
    found = met.average_precision(all_columns(parts), "label", "p", by=["trial"]).collect()
    return {r["trial"]: float(r["pr_auc"] or 0.0) for r in found}


def tune(
    name: str, train: DataFrame, val: DataFrame, n_trials: int = 50, seed: int = 42, parallelism: int = 8
) -> tuple[dict[str, Any], list[Trial]]:
    """Best settings by validation PR-AUC on a fixed time split, and all trials (see ``search``).

    Boosted trees first run a few rounds; trials whose short run lies below the median stop there. The
    split is held in memory for the search, and classes are counted once.
    """
    counts = count_classes(train, "label")
    train, val = train.select("label", "features").persist(), val.select("label", "features").persist()

    def fitted(t: Trial, rounds: int | None = None):
        return fit_learner(name, t.params | ({"maxIter": rounds} if rounds else {}), train, None, seed, counts)

    def boosted(t: Trial, most: int) -> list[float]:
        return boost(lambda n: fitted(t, n), most, val, most)[1]

    def short(trials: list[Trial]) -> None:
        curves = side_by_side([lambda t=t: boosted(t, SHORT_ROUNDS) for t in trials], parallelism)
        for t, curve in zip(trials, curves, strict=True):
            t.short = max(curve)
            if t.short >= 1.0:
                t.value, t.rounds = t.short, best_round(curve)

    def full(trials: list[Trial]) -> None:
        if name == "gbt":
            # Their short runs are known and have settled nothing, so the whole ones follow at once.
            curves = side_by_side([lambda t=t: boosted(t, t.params["maxIter"]) for t in trials], parallelism)
            for t, curve in zip(trials, curves, strict=True):
                t.rounds = best_round(curve)
                t.value = curve[t.rounds - 1]
            return
        models = dict(zip((t.number for t in trials), side_by_side([lambda t=t: fitted(t) for t in trials], parallelism), strict=True))
        values = judge(models, val)
        for t in trials:
            t.value, t.rounds = values[t.number], rounds(name, models[t.number], t.params)

    search = Search(name, n_trials, parallelism, seed)
    best = search.run(short if name == "gbt" else None, full)
    train.unpersist()
    val.unpersist()
    return best.params, search.trials


@dataclass
class StackConfig:
    learners: tuple[str, ...] = LEARNERS
    n_trials: int = 50
    meta_splits: int = 5
    seed: int = 42
    parallelism: int = 8
    params: dict[str, dict[str, Any]] | None = None  # given = no search


def oof_meta_features(
    train: DataFrame, params: dict[str, dict[str, Any]], splits: int = 5, seed: int = 42, parallelism: int = 8
) -> DataFrame:
    """Scores of models that saw only earlier folds; the first block has none and is left out.

    ``train`` has event_id, timestamp, label, features.
    """
    folded = materialize(time_folds(train, n_splits=splits), "folds")
    counts = folded.groupBy("fold").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = counts.collect()
    for row in counts:
        if row["pos"] in (0, row["n"]):
            raise ValueError(f"fold {row['fold']} must contain both classes")
    sizes = {r["fold"]: (r["n"] - r["pos"], r["pos"]) for r in counts}
    folded = folded.persist()

    def fit(fold: int, name: str):
        seen = tuple(sum(sizes[f][side] for f in sizes if f < fold) for side in (0, 1))
        past, now = folded.where(F.col("fold") < fold), folded.where(F.col("fold") == fold)
        return fit_learner(name, params[name], past, now, seed, seen)

    turns = [(fold, name) for fold in range(1, splits + 1) for name in params]
    models = dict(zip(turns, side_by_side([lambda t=t: fit(*t) for t in turns], parallelism), strict=True))
    parts = []
    for fold in range(1, splits + 1):
        scored = folded.where(F.col("fold") == fold)
        for name in params:
            scored = probability(models[fold, name], scored, f"{name}_prob")
        parts.append(scored)
    out = materialize(all_columns(parts), "oof-meta")
    folded.unpersist()
    return out


def fit_meta(rows: DataFrame, cols: Sequence[str], c: float = 1.0) -> PipelineModel:
    """Standardise, then a balanced logistic regression with inverse penalty ``c``."""
    balanced = weighted(rows, "balanced")
    n = balanced.count()
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_meta"),
        StandardScaler(inputCol="_meta", outputCol="_scaled", withMean=True),
        LogisticRegression(
            featuresCol="_scaled", labelCol="label", weightCol=WEIGHT, regParam=1.0 / (c * n), standardization=False, maxIter=1000
        ),
    ]
    return Pipeline(stages=stages).fit(balanced)


def fit_blend(rows: DataFrame, cols: Sequence[str], c: float = 0.5) -> dict[str, float]:
    """Non-negative blend weights from a balanced logistic regression on the raw scores."""
    balanced = weighted(rows, "balanced")
    data = VectorAssembler(inputCols=list(cols), outputCol="_meta").transform(balanced)
    lr = LogisticRegression(
        featuresCol="_meta", labelCol="label", weightCol=WEIGHT, regParam=1.0 / (c * data.count()), standardization=False, maxIter=2000
    ).fit(data)
    return met.blend_weights(dict(zip(cols, lr.coefficients.toArray())))


@dataclass
class StackModel:
    """Base models refitted on all training data, the meta model, and the learned threshold."""

    base: dict[str, Any]
    meta: PipelineModel
    threshold: float
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    rounds: dict[str, int | None] = field(default_factory=dict)

    @property
    def meta_cols(self) -> list[str]:
        return [f"{n}_prob" for n in self.base]

    def base_scores(self, df: DataFrame) -> DataFrame:
        out = df
        for n, model in self.base.items():
            out = probability(model, out, f"{n}_prob")
        return out

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return probability(self.meta, self.base_scores(df), name).drop("_meta", "_scaled")

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        t = self.threshold if threshold is None else threshold
        return self.score(df).withColumn("predicted", (F.col("score") >= t).cast("int"))

    def contributions(self) -> dict[str, Any]:
        """Contribution of each base score to the log-odds of a row."""
        scaler, lr = self.meta.stages[1], self.meta.stages[2]
        return {
            c: (F.col(c) - float(m)) / (float(s) or 1.0) * float(w)
            for c, m, s, w in zip(self.meta_cols, scaler.mean.toArray(), scaler.std.toArray(), lr.coefficients.toArray())
        }

    def evaluate(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        t = self.threshold if threshold is None else threshold
        return met.binary_metrics(self.score(df), "label", "score", t)

    def leaderboard(self, df: DataFrame) -> DataFrame:
        """Every base model at 0.5 and the stack at its own threshold."""
        scored = self.score(df)
        names = [*self.meta_cols, "score"]
        long = scored.select(
            "label",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit("stack" if n == "score" else n.removesuffix("_prob")).alias("model"),
                            F.col(n).alias("score"),
                        )
                        for n in names
                    ]
                )
            ),
        )
        return met.leaderboard(long, thresholds={"stack": self.threshold})


class Once:
    """Results by key, each made when it is first asked for and only once, whichever threads ask."""

    def __init__(self):
        self._made: dict[Any, Any] = {}
        self._locks: dict[Any, Lock] = {}
        self._guard = Lock()

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        with self._guard:
            lock = self._locks.setdefault(key, Lock())
        with lock:
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]


class Models(Mapping):
    """Models by name, fitted when they are read; ``items`` fits the missing ones side by side."""

    def __init__(self, names: Sequence[str], fit: Callable[[str], Any], parallelism: int):
        self.names, self.fit, self.parallelism = tuple(names), fit, parallelism

    def __getitem__(self, name: str) -> Any:
        if name not in self.names:
            raise KeyError(name)
        return self.fit(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def items(self):
        return zip(self.names, side_by_side([lambda n=n: self.fit(n) for n in self.names], self.parallelism), strict=True)


class StackFit(StackModel):
    """A stack whose parts are fitted when they are first needed; independent parts run side by side.

    ``base`` needs no out-of-fold rows, and one base model needs no other; only the threshold needs all parts.
    """

    def __init__(self, train: DataFrame, val: DataFrame, config: StackConfig):
        self.train, self.val, self.config, self._parts = train, val, config, Once()

    @property
    def params(self) -> dict[str, dict[str, Any]]:
        c = self.config
        return c.params or self._parts.get(
            "params", lambda: {n: tune(n, self.train, self.val, c.n_trials, c.seed, c.parallelism)[0] for n in c.learners}
        )

    def _first(self, name: str):
        """Fitted on the training rows, boosting judged on the validation rows."""
        seen = self._parts.get("seen", lambda: count_classes(self.train, "label"))
        fit = lambda: fit_learner(name, self.params[name], self.train, self.val, self.config.seed, seen)
        return self._parts.get(("first", name), fit)

    def _final(self, name: str):
        """Refitted on training and validation rows, boosting with the rounds that were best."""

        def fit():
            both = self.train.unionByName(self.val)
            every = self._parts.get("every", lambda: count_classes(both, "label"))
            kept = rounds(name, self._first(name), self.params[name]) if name == "gbt" else None
            settings = self.params[name] | ({"maxIter": kept} if kept else {})
            return fit_learner(name, settings, both, None, self.config.seed, every)

        return self._parts.get(("final", name), fit)

    @property
    def first(self) -> Models:
        return Models(self.config.learners, self._first, self.config.parallelism)

    @property
    def base(self) -> Models:
        return Models(self.config.learners, self._final, self.config.parallelism)

    @property
    def rounds(self) -> dict[str, int | None]:
        return {n: rounds(n, m, self.params[n]) for n, m in self.first.items()}

    @property
    def meta(self) -> PipelineModel:
        c = self.config

        def fit():
            params = {n: self.params[n] for n in c.learners}
            return fit_meta(oof_meta_features(self.train, params, c.meta_splits, c.seed, c.parallelism), self.meta_cols)

        return self._parts.get("meta", fit)

    @property
    def threshold(self) -> float:
        def find():
            self.fit_all()
            held = StackModel(dict(self.first), self.meta, 0.5).score(self.val)
            return float(met.best_f1_threshold(held, "label", "score").first()["threshold"])

        return self._parts.get("threshold", find)

    def fit_all(self) -> None:
        """All models, those of the folds next to the others."""
        jobs = [lambda: self.meta, *[lambda n=n: (self._first(n), self._final(n)) for n in self.config.learners]]
        side_by_side(jobs, len(jobs))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        side_by_side([lambda: self.meta, lambda: self.base.items()])
        return super().score(df, name)

    def leaderboard(self, df: DataFrame) -> DataFrame:
        self.fit_all()
        return super().leaderboard(df)


def fit_stack(train: DataFrame, val: DataFrame, config: StackConfig = StackConfig()) -> StackModel:
    """Search, fit on train, out-of-fold meta features, threshold on validation, refit on both.

    Both frames have event_id, timestamp, label, features. They are read many times, so pass
    frames that have been written (see ``session.materialize``). Each part is fitted when it is first needed.
    """
    return StackFit(train, val, config)
