"""Two-target regressors, their search, and the log of runs.

The loops here run on the driver and start Spark jobs; the number of jobs
depends on the grid, never on the data.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from importlib import import_module

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.contract import LIMITS, TARGETS, Limits
from cashtrail.operators import adaboost, splits, trees
from cashtrail.operators.metrics import regression_metrics
from cashtrail.operators.neighbours import DonorIndex, donor_index, predict_from
from cashtrail.sources.writers import load_model, save_model

SEED = 42
KEY = "complaint_id"


def hat(target: str) -> str:
    return f"{target}_hat"


class PerTarget:
    """One fitted model per target."""

    def __init__(self, models: Mapping[str, object]):
        self.models = dict(models)

    def transform(self, df: DataFrame) -> DataFrame:
        for target, model in self.models.items():
            df = model.transform(df).withColumnRenamed("prediction", hat(target))
        return df

    def save(self, path: str) -> None:
        """One folder per target; boosted trees keep a folder per tree."""
        kinds = []
        for target, model in self.models.items():
            save_model(model, f"{path}/{target}")
            kinds.append((target, type(model).__module__, type(model).__name__, 0))
        _write_parts(path, kinds)

    @classmethod
    def load(cls, path: str, parts: Sequence) -> PerTarget:
        return cls({p["part"]: load_model(getattr(import_module(p["module"]), p["kind"]), f"{path}/{p['part']}") for p in parts})


class Nearest:
    """K nearest training rows; keeps the training table, which is laid out for its first answers and not again."""

    def __init__(self, train: DataFrame, targets: Sequence[str], k: int):
        self.train, self.targets, self.k = train, targets, k
        self._laid_out: tuple[list[str], DonorIndex | None] | None = None

    @staticmethod
    def _flat(df: DataFrame) -> tuple[DataFrame, list[str]]:
        width = df.schema["features"].metadata.get("ml_attr", {}).get("num_attrs")
        if not width:
            width = len(df.select(vector_to_array("features").alias("f")).first()["f"])
        names = [f"_x{i}" for i in range(width)]
        array = vector_to_array("features")
        return df.withColumns({n: array[i] for i, n in enumerate(names)}), names

    def transform(self, df: DataFrame) -> DataFrame:
        if self._laid_out is None:
            train, names = self._flat(self.train)
            self._laid_out = names, donor_index(train, names, self.k, KEY, payload=self.targets)
        names, index = self._laid_out
        asked, _ = self._flat(df)
        return predict_from(asked, index, names, self.targets, self.k, KEY).drop(*names)

    def save(self, path: str) -> None:
        """The training rows; their number of neighbours goes with the parts."""
        self.train.select(KEY, "features", *self.targets).write.mode("overwrite").parquet(f"{path}/rows")
        _write_parts(path, [(t, __name__, "Nearest", self.k) for t in self.targets])

    @classmethod
    def load(cls, path: str, parts: Sequence) -> Nearest:
        rows = SparkSession.getActiveSession().read.parquet(f"{path}/rows")
        return cls(rows, [p["part"] for p in parts], parts[0]["neighbours"])


def _write_parts(path: str, parts: Sequence[tuple]) -> None:
    rows = [(i, *part) for i, part in enumerate(parts)]
    schema = "position int, part string, module string, kind string, neighbours int"
    SparkSession.getActiveSession().createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/parts")


def load(spark: SparkSession, path: str) -> PerTarget | Nearest:
    """A stored model of any kind; one row per target says what it is made of."""
    parts = spark.read.parquet(f"{path}/parts").orderBy("position").collect()
    kind = Nearest if parts[0]["kind"] == "Nearest" else PerTarget
    return kind.load(path, parts)


Fitter = Callable[[DataFrame, Sequence[str], dict], object]


def _each_target(build: Callable[[DataFrame, str, dict], object]) -> Fitter:
    def fit(train: DataFrame, targets: Sequence[str], params: dict) -> PerTarget:
        return PerTarget({t: build(train, t, params) for t in targets})

    return fit


def _ridge(train: DataFrame, target: str, params: dict):
    """Least squares with penalty ``alpha``.

    Spark divides the squared error by the rows and scales the penalty by the
    label's deviation, so ``alpha`` is converted.
    """
    facts = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    return LinearRegression(
        labelCol=target,
        solver="normal",
        elasticNetParam=0.0,
        regParam=params["alpha"] * facts["s"] / facts["n"],
        standardization=False,
    ).fit(train)


def _linear(train: DataFrame, target: str, params: dict):
    return LinearRegression(labelCol=target, solver="normal", regParam=0.0).fit(train)


def _tree(train: DataFrame, target: str, params: dict):
    return DecisionTreeRegressor(labelCol=target, maxDepth=params["max_depth"], seed=SEED).fit(train)


def _forest(train: DataFrame, target: str, params: dict):
    return RandomForestRegressor(
        labelCol=target,
        numTrees=params["n_estimators"],
        maxDepth=params["max_depth"],
        featureSubsetStrategy="all",
        bootstrap=params.get("bootstrap", True),
        seed=SEED,
    ).fit(train)


def _boosted(train: DataFrame, target: str, params: dict):
    return GBTRegressor(
        labelCol=target,
        maxIter=params["n_estimators"],
        stepSize=params["learning_rate"],
        maxDepth=params.get("max_depth", 3),
        seed=SEED,
    ).fit(train)


def _adaptive(train: DataFrame, target: str, params: dict):
    return adaboost.fit(train, target, rounds=params["n_estimators"], key=KEY)


def _nearest(train: DataFrame, targets: Sequence[str], params: dict) -> Nearest:
    return Nearest(train, targets, params["n_neighbors"])


@dataclass(frozen=True)
class Learner:
    name: str
    fit: Fitter
    grid: Mapping[str, Sequence]

    def candidates(self) -> list[dict]:
        return [dict(zip(self.grid, values)) for values in itertools.product(*self.grid.values())]

    def with_grid(self, **grid: Sequence) -> Learner:
        return Learner(self.name, self.fit, grid)


# fixed values: names and grids
LEARNERS = (
    Learner("Random Forest", _each_target(_forest), {"n_estimators": (50, 100), "max_depth": (10, 20)}),
    Learner("Gradient Boosting", _each_target(_boosted), {"n_estimators": (50, 100), "learning_rate": (0.1, 0.2)}),
    Learner("Linear Regression", _each_target(_linear), {}),
    Learner("Ridge Regression", _each_target(_ridge), {"alpha": (1.0, 10.0)}),
    Learner("Decision Tree", _each_target(_tree), {"max_depth": (10, 20)}),
    Learner("KNN", _nearest, {"n_neighbors": (5, 7)}),
    Learner("AdaBoost", _each_target(_adaptive), {"n_estimators": (50, 100)}),
)


def learner(name: str) -> Learner:
    return next(x for x in LEARNERS if x.name == name)


def measure(model, df: DataFrame, targets: Sequence[str] = TARGETS) -> dict[str, float]:
    return regression_metrics(model.transform(df), {t: hat(t) for t in targets}).first().asDict()


def cross_validate(
    chosen: Learner, params: dict, train: DataFrame, targets: Sequence[str] = TARGETS, folds: int = 3
) -> float:
    """Mean R2 over both targets and all folds. What leads to the rows is run once: they are written."""
    train, scores = trees.shelved(train, "folds"), []
    for i in range(folds):
        held_out = splits.fold(KEY, folds) == i
        model = chosen.fit(train.where(~held_out), targets, params)
        scores.append(measure(model, train.where(held_out), targets)["r2"])
    return math.fsum(scores) / folds


def search(
    chosen: Learner,
    train: DataFrame,
    targets: Sequence[str] = TARGETS,
    folds: int = 3,
    parallel: int = 2,
) -> tuple[dict, float | None]:
    """The parameters with the best cross-validated R2 (the first wins a tie)."""
    options = chosen.candidates()
    if len(options) == 1:
        return options[0], None
    with ThreadPoolExecutor(parallel) as pool:
        scores = list(pool.map(lambda p: cross_validate(chosen, p, train, targets, folds), options))
    best = max(range(len(options)), key=lambda i: scores[i])
    return options[best], scores[best]


SCORE_SCHEMA = (
    "model string, params string, cv_r2 double, train_r2 double, train_mse double, train_mae double, "
    "test_r2 double, test_mse double, test_mae double"
)


LOG_SCHEMA = f"{SCORE_SCHEMA}, below_expected boolean, overfit boolean, run_ts string"


def evaluate(
    train: DataFrame,
    test: DataFrame,
    learners: Sequence[Learner] = LEARNERS,
    targets: Sequence[str] = TARGETS,
    folds: int = 3,
    parallel: int = 2,
    limits: Limits = LIMITS,
) -> tuple[DataFrame, dict[str, object]]:
    """Search, refit and measure each learner; a score table and the fitted models."""
    kept = [df.persist() for df in (train, test)]
    rows, models = [], {}
    try:
        for one in learners:
            params, cv = search(one, train, targets, folds, parallel)
            model = one.fit(train, targets, params)
            on_train, on_test = measure(model, train, targets), measure(model, test, targets)
            rows.append(
                (
                    one.name,
                    json.dumps(params, sort_keys=True),
                    cv,
                    *[on_train[m] for m in ("r2", "mse", "mae")],
                    *[on_test[m] for m in ("r2", "mse", "mae")],
                )
            )
            models[one.name] = model
    finally:
        for df in kept:
            df.unpersist()
    return judge(train.sparkSession.createDataFrame(rows, SCORE_SCHEMA), limits), models


def judge(scores: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Flag models below the expected R2 and models that fit the training rows too well."""
    return scores.withColumns(
        {
            "below_expected": F.col("test_r2") < limits.expected_r2,
            "overfit": F.col("train_r2") - F.col("test_r2") > limits.overfit_gap,
        }
    )


def best_model(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by("model", "test_r2").alias("model"), F.max("test_r2").alias("test_r2"))


def best_of_runs(runs: DataFrame) -> DataFrame:
    """One row per run: how many models it holds, and its best one with its flags."""
    order = F.struct(F.round("test_r2", 6), "model")
    row = F.struct("model", "params", "test_r2", "below_expected", "overfit")
    best = runs.groupBy("run_ts").agg(F.count(F.lit(1)).alias("models"), F.max_by(row, order).alias("best"))
    return best.select("run_ts", "models", "best.*")


def log_runs(scores: DataFrame, path: str, run_ts: str) -> None:
    """One row per model of a run; a run that is logged again replaces its rows."""
    writer = scores.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The log, with the names of runs as text."""
    return spark.read.schema(LOG_SCHEMA).parquet(path)
