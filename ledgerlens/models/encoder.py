"""Estimators over the column-wise encoders; fitted state is tables and small lists."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import encoding as enc
from ledgerlens.operators.profiling import profile_columns
from ledgerlens.session import materialize


class _EncoderParams(HasLabelCol):
    cols = Param(Params._dummy(), "cols", "columns to encode", TypeConverters.toListString)
    timeCol = Param(Params._dummy(), "timeCol", "event time", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id, breaks ties of the time", TypeConverters.toString)
    nSplits = Param(Params._dummy(), "nSplits", "time folds", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "weight of the overall mean", TypeConverters.toFloat)
    minCount = Param(Params._dummy(), "minCount", "rows below which a category is rare", TypeConverters.toInt)
    useLogit = Param(Params._dummy(), "useLogit", "log-odds instead of rates", TypeConverters.toBoolean)
    eps = Param(Params._dummy(), "eps", "clip of rates before log-odds", TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "robust-scale the numbers", TypeConverters.toBoolean)
    outOfFold = Param(
        Params._dummy(), "outOfFold", "encode training rows from earlier folds only", TypeConverters.toBoolean
    )
    dualEncode = Param(
        Params._dummy(), "dualEncode", "target-encode ordinal columns as well", TypeConverters.toBoolean
    )

    def __init__(self):
        super().__init__()
        self._setDefault(
            labelCol="isMoneyLaundering", timeCol="timestamp", idCol="event_id", nSplits=5, alpha=50.0,
            minCount=20, useLogit=False, eps=1e-6, scale=False, outOfFold=True, dualEncode=True,
        )

    def target_stats(self) -> enc.TargetStats:
        get = self.getOrDefault
        return enc.TargetStats(
            get(self.alpha), get(self.minCount), get(self.useLogit), get(self.eps), get(self.nSplits)
        )


class TimeAwareTargetEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Target means per category; training rows are encoded from earlier rows only."""

    @keyword_only
    def __init__(self, *, cols=None, timeCol="timestamp", idCol="event_id", labelCol="isMoneyLaundering", nSplits=5, alpha=50.0, minCount=20, useLogit=False, eps=1e-6):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _columns(self, df: DataFrame) -> list[str]:
        if self.isDefined(self.cols):
            return self.getOrDefault(self.cols)
        skip = {self.getOrDefault(self.idCol)}
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]

    def _fit(self, df: DataFrame) -> "TargetEncoderModel":
        label, cols, how = self.getLabelCol(), self._columns(df), self.target_stats()
        prior = enc.label_mean(df, label)
        state = materialize(enc.fit_target_state(df, cols, label, prior, how), "target-state")
        return TargetEncoderModel(state, cols, prior, how)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Leak-safe encoding of the rows the encoder is fitted on."""
        return enc.oof_target_encode(
            df, self._columns(df), self.getLabelCol(), self.getOrDefault(self.timeCol),
            self.getOrDefault(self.idCol), self.target_stats(),
        )


class TargetEncoderModel(Model):
    """Lookup of fitted target means."""

    def __init__(self, state: DataFrame, cols: list[str], prior: float, how: enc.TargetStats):
        super().__init__()
        self.state, self.cols, self.prior, self.how = state, cols, prior, how

    def _transform(self, df: DataFrame) -> DataFrame:
        return enc.apply_target_state(df, self.state, self.cols, self.prior, self.how)


class EventEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers, low-cardinality, ordinal and high-cardinality columns to named doubles.

    Output order and names: ``num__`` (sorted), ``low_card__<col>_<value>``, ``orig__``,
    ``high_card__<col>__enc``.
    """

    @keyword_only
    def __init__(self, *, labelCol="isMoneyLaundering", timeCol="timestamp", idCol="event_id", nSplits=5, alpha=50.0, minCount=20, useLogit=False, eps=1e-6, scale=False, outOfFold=True, dualEncode=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "EventEncoderModel":
        get = self.getOrDefault
        label = self.getLabelCol()
        aside = {label, "isFraud", "isMoneyLaundering", get(self.timeCol), get(self.idCol)}
        fields = [f for f in df.schema.fields if f.name not in aside]
        text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        numeric = sorted(
            f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))
        )
        roles = {r["column"]: r["role"] for r in profile_columns(df, text).collect()} if text else {}
        low = [c for c in text if roles[c] == "low_card"]
        ordinal = [c for c in text if roles[c] == "ordinal"]
        high = [c for c in text if roles[c] == "high_card" or (get(self.dualEncode) and roles[c] == "ordinal")]
        plain = df.withColumns({c: F.col(c).cast("double") for c in numeric}) if numeric else df
        scaled = get(self.scale)
        probs = {"m": 0.5} | ({"q1": 0.25, "q3": 0.75} if scaled else {})
        spread = enc.quantile_table(plain, numeric, probs).collect() if numeric else []
        found = {r["column"]: r for r in spread}
        medians = {c: found[c]["m"] if c in found else 0.0 for c in numeric}
        ranges = {
            c: ((found[c]["q3"] - found[c]["q1"]) or 1.0) if c in found else 1.0 for c in numeric if scaled
        }
        modes = {}
        lists: dict[str, list[tuple[str, int]]] = {}
        if low + ordinal:
            modes = {r["col"]: r["value"] for r in enc.most_frequent(df, low + ordinal).collect()}
            lists = enc.category_lists(enc.impute_most_frequent(df, modes), low + ordinal)
        how = self.target_stats()
        prior = enc.label_mean(df, label)
        state = None
        if high:
            state = materialize(enc.fit_target_state(df, high, label, prior, how), "target-state")
        fitted = {
            "numeric": numeric,
            "medians": medians,
            "ranges": ranges if scaled else None,
            "modes": modes,
            "low": {c: [v for v, _ in lists[c]] for c in low},
            "ordinal": {c: enc.ordinal_codes(lists[c]) for c in ordinal},
            "high": high,
            "prior": prior,
            "how": [how.alpha, how.min_count, how.use_logit, how.eps, how.n_splits],
            "keep": [c for c in (get(self.idCol), get(self.timeCol), label) if c in df.columns],
        }
        return EventEncoderModel(fitted, state)

    def fit_transform(self, df: DataFrame) -> tuple["EventEncoderModel", DataFrame]:
        """Fitted model and encoded training rows; those are leak-safe unless told otherwise."""
        model = self.fit(df)
        if not self.getOrDefault(self.outOfFold) or not model.fitted["high"]:
            return model, model.transform(df)
        get = self.getOrDefault
        oof = enc.oof_target_encode(
            df, model.fitted["high"], self.getLabelCol(), get(self.timeCol), get(self.idCol),
            self.target_stats(), suffix="__oof",
        )
        return model, model._finish(oof, {c: F.col(f"{c}__oof") for c in model.fitted["high"]})


class EventEncoderModel(Model):
    def __init__(self, fitted: dict, state: DataFrame | None):
        super().__init__()
        self.fitted, self.state = fitted, state

    @property
    def feature_names(self) -> list[str]:
        f = self.fitted
        return (
            [f"num__{c}" for c in f["numeric"]]
            + [f"low_card__{c}_{v}" for c, values in f["low"].items() for v in values]
            + [f"orig__{c}" for c in f["ordinal"]]
            + [f"high_card__{c}__enc" for c in f["high"]]
        )

    def _finish(self, df: DataFrame, target: dict) -> DataFrame:
        f = self.fitted
        present = set(df.columns)
        missing = [c for c in (*f["numeric"], *f["low"], *f["ordinal"], *f["high"]) if c not in present]
        df = df.withColumns({c: F.lit(None).cast("double" if c in f["numeric"] else "string") for c in missing})
        if f["low"] or f["ordinal"]:
            df = df.withColumns(
                {f"_cat_{c}": F.coalesce(F.col(c).cast("string"), F.lit(f["modes"].get(c))) for c in (*f["low"], *f["ordinal"])}
            )
        out = {}
        for c in f["numeric"]:
            x = F.col(c).cast("double")
            x = F.when(x.isNull() | F.isnan(x), F.lit(f["medians"][c])).otherwise(x)
            if f["ranges"]:
                x = (x - f["medians"][c]) / f["ranges"][c]
            out[f"num__{c}"] = x
        for c, values in f["low"].items():
            for v in values:
                out[f"low_card__{c}_{v}"] = F.coalesce(F.col(f"_cat_{c}") == v, F.lit(False)).cast("double")
        for c, codes in f["ordinal"].items():
            table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
            out[f"orig__{c}"] = F.coalesce(F.try_element_at(table, F.col(f"_cat_{c}")), F.lit(-1)).cast("double")
        for c in f["high"]:
            out[f"high_card__{c}__enc"] = target[c]
        keep = [c for c in f["keep"] if c in present]
        return df.select(*keep, *[col.alias(n) for n, col in out.items()])

    def _transform(self, df: DataFrame) -> DataFrame:
        f = self.fitted
        target = {}
        if f["high"]:
            for c in [c for c in f["high"] if c not in df.columns]:
                df = df.withColumn(c, F.lit(None).cast("string"))
            how = enc.TargetStats(*f["how"])
            df = enc.apply_target_state(df, self.state, f["high"], f["prior"], how, suffix="__te")
            target = {c: F.col(f"{c}__te") for c in f["high"]}
        return self._finish(df, target)

    def save(self, path: str) -> None:
        """Lists as one JSON line, target means as a table."""
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.fitted),)], "fitted string").write.mode("overwrite").parquet(f"{path}/fitted")
        if self.state is not None:
            self.state.write.mode("overwrite").parquet(f"{path}/target_state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EventEncoderModel":
        fitted = json.loads(spark.read.parquet(f"{path}/fitted").first()["fitted"])
        state = spark.read.parquet(f"{path}/target_state") if fitted["high"] else None
        return cls(fitted, state)
