"""From a complaint file to a chosen model, with every stage stored below one run folder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.contract import LIMITS, MODEL_FEATURES, TARGETS, Limits
from cashtrail.operators import clean, learn, neighbours, quality, scoring, search, splits
from cashtrail.sources import readers, writers


@dataclass(frozen=True)
class Stages:
    """Where a run keeps its tables. The run's name is always passed in."""

    base: str
    run_ts: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return writers.stage_path(self.base, self.run_ts, name)


@dataclass(frozen=True)
class TrainingResult:
    stages: Stages
    validation_status: bool
    scores: DataFrame
    best_model: str
    best_r2: float
    preprocessor: PipelineModel
    model: object


def ingest_stage(spark: SparkSession, source: str, stages: Stages, publish_to: str | None = None) -> None:
    rows = writers.ingest(spark, source, publish_to)
    stored = writers.write_feature_store(rows, stages.feature_store)
    writers.write_split(splits.with_split(stored), stages.split)


def validate_stage(spark: SparkSession, stages: Stages, limits: Limits = LIMITS) -> bool:
    """Stop on a broken contract; report drift and bad content without stopping."""
    sides = {name: readers.read_split(spark, stages.split, name) for name in ("train", "test")}
    for rows in sides.values():
        quality.require_contract(rows)
    drift = quality.mean_drift(sides["train"], sides["test"], threshold=limits.drift_ratio)
    writers.write_report(drift, stages.drift_report)
    flagged = quality.flag_violations(readers.read_stage(spark, stages.split), limits)
    writers.write_split(flagged.where(F.size("violations") > 0), stages.quarantine)
    return quality.no_drift(spark.read.schema(drift.schema).json(stages.drift_report))


def transform_stage(
    spark: SparkSession, stages: Stages, features: Sequence[str] = MODEL_FEATURES
) -> PipelineModel:
    train, test = (
        clean.add_model_features(readers.read_split(spark, stages.split, name)) for name in ("train", "test")
    )
    # what fills the gaps is stored with the run: scoring opens the same rows and indexes
    imputer = neighbours.fit_imputer(train, features, stages.imputer, key=learn.KEY)
    train, test = imputer.transform(train), imputer.transform(test)
    preprocessor = clean.fit_preprocessor(train, features)
    writers.save_model(preprocessor, stages.preprocessor)
    for name, rows in (("train", train), ("test", test)):
        writers.replace_table(clean.feature_frame(rows, preprocessor), f"{stages.matrix}_{name}")
    return preprocessor


def train_stage(
    spark: SparkSession,
    stages: Stages,
    learners: Sequence[learn.Learner] = learn.LEARNERS,
    runs: str | None = None,
    limits: Limits = LIMITS,
) -> tuple[DataFrame, dict[str, object]]:
    train, test = (readers.read_stage(spark, f"{stages.matrix}_{name}") for name in ("train", "test"))
    candidates, scores, models = search.evaluate(train, test, learners, TARGETS, limits=limits)
    writers.replace_table(candidates, stages.candidates)
    learn.log_runs(scores, runs or f"{stages.base}/runs", stages.run_ts)
    return scores, models


def run_training(
    spark: SparkSession,
    source: str,
    base: str,
    run_ts: str,
    learners: Sequence[learn.Learner] = learn.LEARNERS,
    publish_to: str | None = None,
    limits: Limits = LIMITS,
) -> TrainingResult:
    stages = Stages(base, run_ts)
    ingest_stage(spark, source, stages, publish_to)
    status = validate_stage(spark, stages, limits)
    preprocessor = transform_stage(spark, stages)
    scores, models = train_stage(spark, stages, learners, limits=limits)
    best = learn.best_model(scores).first()
    chosen = models[best["model"]]
    chosen.save(stages.model)
    return TrainingResult(stages, status, scores, best["model"], best["test_r2"], preprocessor, chosen)


def predict(rows: DataFrame, preprocessor: PipelineModel, model) -> DataFrame:
    """Transform, then predict: ``<target>_hat`` columns for clean complaints."""
    features = clean.add_model_features(rows)
    return clean.drop_working_columns(model.transform(preprocessor.transform(features)))


@dataclass(frozen=True)
class StoredRun:
    """A run as it was stored: scores new complaints like the run itself would."""

    preprocessor: PipelineModel
    model: object
    imputer: neighbours.FittedImputer

    def predict(self, rows: DataFrame) -> DataFrame:
        filled = self.imputer.transform(clean.add_model_features(rows))
        scored = self.model.transform(self.preprocessor.transform(filled))
        return clean.drop_working_columns(scored, self.imputer.features)

    def bulk_score(self, rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
        """The prediction columns from the model's probability."""
        return scoring.from_model(self.predict(rows), learn.hat(TARGETS[0]), limits)


def load_run(spark: SparkSession, base: str, run_ts: str) -> StoredRun:
    stages = Stages(base, run_ts)
    return StoredRun(
        writers.load_model(PipelineModel, stages.preprocessor), learn.load(spark, stages.model), neighbours.load_imputer(spark, stages.imputer)
    )
