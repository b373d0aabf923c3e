"""ML pipelines, baselines, averaging ensembles, meta-models and the cross-validation driver."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import elapsed_minutes
from tidemark.operators.metrics import evaluate, fold_summary
from tidemark.sources.tables import Fold, staged

UNKNOWN = "UNKNOWN"


def feature_stages(numeric: list[str], categorical: list[str], scale: bool = True, strategy: str = "mean", unknown: bool = False, center: bool = False, drop_last: bool = True) -> list:
    """Imputer, indexer (unseen kept), one-hot encoder, assembler and scaler: one stage each for all columns.

    With `unknown` a null category is one of its own name; `center` takes the mean away, which makes vectors dense.
    """
    num, idx, hot = [f"{c}__n" for c in numeric], [f"{c}__i" for c in categorical], [f"{c}__h" for c in categorical]
    out: list = []
    inputs = list(categorical)
    if categorical and unknown:
        inputs = [f"{c}__c" for c in categorical]
        filled = ", ".join(f"coalesce(cast(`{c}` as string), '{UNKNOWN}') as `{c}__c`" for c in categorical)
        out.append(SQLTransformer(statement=f"select *, {filled} from __THIS__"))
    out += [Imputer(inputCols=numeric, outputCols=num, strategy=strategy)] if numeric else []
    if categorical:
        out += [StringIndexer(inputCols=inputs, outputCols=idx, handleInvalid="keep"), OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=drop_last)]
    out.append(VectorAssembler(inputCols=num + hot, outputCol="__raw" if scale else "features", handleInvalid="keep"))
    return [*out, StandardScaler(inputCol="__raw", outputCol="features", withMean=center)] if scale else out


def regressor(kind: str, label: str, **kw):
    made = {"lr": LinearRegression, "rf": RandomForestRegressor, "gbt": GBTRegressor}[kind]  # xgboost is not installed: gbt stands in
    return made(featuresCol="features", labelCol=label, predictionCol="prediction", **kw)


def pipeline(kind: str, label: str, numeric: list[str], categorical: list[str] = (), **kw) -> Pipeline:
    return Pipeline(stages=[*feature_stages(numeric, list(categorical), scale=kind == "lr"), regressor(kind, label, **kw)])


def log_target_pipeline(kind: str, label: str, numeric: list[str], categorical: list[str] = (), **kw) -> Pipeline:
    """A pipeline that learns sign(y) ln(|y| + 1) and predicts y: both steps are stages, so they are saved with the model.

    Rows without a label pass through as rows to predict; they teach nothing, as the learner leaves null labels out.
    """
    to = SQLTransformer(statement=f"select *, sign(`{label}`) * ln(abs(`{label}`) + 1) as __log_label from __THIS__")
    back = SQLTransformer(statement="select *, sign(__log_prediction) * (exp(abs(__log_prediction)) - 1) as prediction from __THIS__")
    learner = regressor(kind, "__log_label", **kw).setPredictionCol("__log_prediction")
    return Pipeline(stages=[to, *feature_stages(numeric, list(categorical), scale=kind == "lr"), learner, back])


class ConstantBaseline:
    """Predicts the training mean or median; the median is within 1 / accuracy of its rank, found in bounded memory."""

    def __init__(self, label: str, median: bool = False, accuracy: int = 10_000):
        self.label, self.median, self.accuracy = label, median, accuracy

    def fit(self, train: DataFrame) -> ConstantBaseline:
        self.value = train.agg(F.percentile_approx(self.label, 0.5, self.accuracy) if self.median else F.avg(self.label)).first()[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value).cast("double"))


def ensemble(df: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """The mean of the models' predictions in one plan, without joins."""
    out = df
    for i, m in enumerate(models):
        out = m.transform(out).withColumnRenamed("prediction", f"__p{i}")
        out = out.select(*df.columns, *[f"__p{j}" for j in range(i + 1)])
    return out.select(*df.columns, (sum(F.col(f"__p{i}") for i in range(len(models))) / len(models)).alias("prediction"))


class VotingEnsemble:
    """Learners of different columns that vote by the mean of their predictions."""

    def __init__(self, *makers: Callable[[], Pipeline]):
        self.makers, self.models = makers, []

    def fit(self, train: DataFrame) -> VotingEnsemble:
        self.models = [make().fit(train) for make in self.makers]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return ensemble(df, self.models)


def cross_validate(make, folds: list[Fold], label: str) -> DataFrame:
    """Metrics of each fold's held rows (fold, kind, metrics)."""
    return CrossValidation(make, folds, label).fit().results()


class CrossValidation:
    """Fits a learner on each fold's training rows and judges it on the held ones.

    `make` gives a new learner, and is told the fold's number if it takes one.  Results of a fold are computed once.
    """

    def __init__(self, make: Callable, folds: list[Fold], label: str):
        self.make, self.folds, self.label = make, folds, label
        self.models: dict[int, object] = {}
        self._rows: dict[tuple[int, str], DataFrame] = {}

    def _new(self, i: int):
        try:
            return self.make(i)
        except TypeError:
            return self.make()

    def fit_fold(self, i: int):
        """The model of fold i, counted from 1."""
        if i not in self.models:
            train = self.folds[i - 1].train
            self.models[i] = self._new(i).fit(train.filter(F.col(self.label).isNotNull()))
        return self.models[i]

    def fit(self) -> CrossValidation:
        for i in range(1, len(self.folds) + 1):
            self.fit_fold(i)
        return self

    def judged(self, i: int, on_train: bool = False) -> DataFrame:
        """One row: fold, kind (of the held rows, or TRAIN), metrics."""
        f = self.folds[i - 1]
        kind = "TRAIN" if on_train else f.kind
        if (i, kind) not in self._rows:
            part = f.train if on_train else f.held
            row = evaluate(self.fit_fold(i).transform(part), self.label, "prediction")
            self._rows[i, kind] = staged(row.select(F.lit(i).alias("fold"), F.lit(kind).alias("kind"), "*"))
        return self._rows[i, kind]

    def results(self, with_train: bool = False) -> DataFrame:
        out = None
        for i in range(1, len(self.folds) + 1):
            for on_train in (True, False) if with_train else (False,):
                row = self.judged(i, on_train)
                out = row if out is None else out.unionByName(row)
        return out

    def summary(self, with_train: bool = False) -> DataFrame:
        """(kind, metric, mean, sd, folds)."""
        return fold_summary(self.results(with_train))

    def benchmark(self, kinds: tuple[str, ...] = ("VAL", "TEST")) -> list[dict]:
        """Seconds and rows a second of predicting each fold's held rows, model and plan included."""
        out = []
        for i, f in enumerate(self.folds, 1):
            if f.kind in kinds:
                model = self.fit_fold(i)
                began = time.perf_counter()
                rows = model.transform(f.held).agg(F.count("prediction")).first()[0]
                took = time.perf_counter() - began
                out.append({"fold": i, "kind": f.kind, "rows": rows, "seconds": took, "rows_per_second": rows / took if took else 0.0})
        return out


def grid(make: Callable, choices: dict[str, list], folds: list[Fold], label: str, metric: str = "rmse") -> list[dict]:
    """Each combination of the choices with its mean metric over the folds' held rows, the least first."""
    out = []
    for values in itertools.product(*choices.values()):
        kw = dict(zip(choices, values, strict=True))
        cv = CrossValidation(lambda kw=kw: make(**kw), folds, label)
        mean = cv.results().agg(F.avg(metric)).first()[0]
        out.append(kw | {metric: mean})
    return sorted(out, key=lambda r: r[metric])


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of a feature vector's places, from the attributes that its stages left in the schema."""
    meta = df.schema[column].metadata.get("ml_attr", {})
    found = {a["idx"]: a.get("name", f"{column}_{a['idx']}") for kind in meta.get("attrs", {}).values() for a in kind}
    return [found.get(i, f"{column}_{i}") for i in range(meta.get("num_attrs", len(found)))]


def importances(model: PipelineModel, df: DataFrame, column: str = "features", of: str = "__raw", k: int | None = None) -> list[tuple[str, float]]:
    """(name, weight) of the last learner's importances or coefficients, the greatest first; a category is `column__h_value`."""
    learner = next(s for s in reversed(model.stages) if hasattr(s, "featureImportances") or hasattr(s, "coefficients"))
    weights = (learner.featureImportances if hasattr(learner, "featureImportances") else learner.coefficients).toArray().tolist()
    made = model.transform(df.limit(0))
    names = feature_names(made, of if of in made.columns else column)
    return sorted(zip(names, weights, strict=True), key=lambda x: (-abs(x[1]), x[0]))[:k]


# ---------------------------------------------------------------- meta-models


def turnover_target(df: DataFrame) -> DataFrame:
    """target_turnover: minutes on the ground, from the first of: given, actual, scheduled; rows that have none are null."""
    ways = [F.col(c).cast("double") for c in ("lineage_actual_turnover_time_minutes", "actual_turnover_time_minutes", "scheduled_lineage_turnover_time_minutes") if c in df.columns]
    return df.withColumn("target_turnover", F.coalesce(*ways) if ways else F.lit(None).cast("double"))


def rotation_target(df: DataFrame) -> DataFrame:
    """target_rotation: minutes from the previous actual departure to this one, over midnight if need be."""
    return df.withColumn("target_rotation", elapsed_minutes(F.col("prev_flight_dep_time"), F.col("dep_time")).cast("double"))


def boosting_size(rows: int) -> tuple[int, int]:
    """(rounds, depth) by training rows."""
    return (50, 5) if rows > 10_000_000 else (60, 6) if rows > 5_000_000 else (75, 6)


#: What each meta-model predicts, and what stands in where it can't.
META = {"meta_air_time": ("prev_flight_air_time", "crs_elapsed_time", 120.0), "meta_taxi_time": ("prev_flight_taxi_time", None, 25.0), "meta_total_duration": ("prev_flight_actual_elapsed_time", "crs_elapsed_time", 120.0)}


class MetaModels:
    """Models of the previous flight's durations, learned on rows whose lineage is whole, as features for another model.

    A target with fewer than `least` rows gets no model; its prediction is the fallback column, then the constant.
    """

    def __init__(self, numeric: list[str], categorical: list[str] = (), targets: dict = META, kind: str = "rf", least: int = 100, **kw):
        self.numeric, self.categorical, self.targets, self.kind, self.least = list(numeric), list(categorical), targets, kind, least
        self.kw = kw or ({"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 10, "seed": 42} if kind == "rf" else {})
        self.models: dict[str, PipelineModel | None] = {}

    def _prepared(self, df: DataFrame) -> DataFrame:
        if "prev_flight_taxi_time" not in df.columns and {"prev_flight_taxi_in", "prev_flight_taxi_out"} <= set(df.columns):
            df = df.withColumn("prev_flight_taxi_time", F.col("prev_flight_taxi_in").cast("double") + F.col("prev_flight_taxi_out").cast("double"))
        return df

    def fit(self, train: DataFrame) -> MetaModels:
        rows = self._prepared(train).filter((F.col("lineage_rank") > 1) & ~F.col("lineage_is_jump"))
        counts = rows.agg(*[F.count(t).alias(n) if t in rows.columns else F.lit(0).alias(n) for n, (t, _, _) in self.targets.items()]).first()
        for name, (target, _, _) in self.targets.items():
            self.models[name] = None
            if counts[name] >= self.least:
                kw = self.kw
                if self.kind == "gbt" and not kw:
                    rounds, depth = boosting_size(counts[name])
                    kw = {"maxIter": rounds, "maxDepth": depth, "seed": 42}
                made = pipeline(self.kind, target, self.numeric, self.categorical, **kw)
                self.models[name] = made.fit(rows.filter(F.col(target).isNotNull()))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = self._prepared(df), list(df.columns)
        for name, (_, fallback, constant) in self.targets.items():
            ways = [F.lit(constant)]
            if fallback and fallback in df.columns:
                ways.insert(0, F.col(fallback).cast("double"))
            if self.models[name]:
                out = self.models[name].transform(out)
                # a first flight has no previous one to predict
                ways.insert(0, F.when((F.col("lineage_rank") > 1) & ~F.col("lineage_is_jump"), F.col("prediction")))
            names.append(name)
            out = out.withColumn(name, F.coalesce(*ways))
            keep = [*names, *(["prev_flight_taxi_time"] if "prev_flight_taxi_time" in out.columns and "prev_flight_taxi_time" not in names else [])]
            out = out.select(*keep)
        return out.select(*names)
