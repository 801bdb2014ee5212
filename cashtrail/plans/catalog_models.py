"""Registered queries of the learned models, all over the whole complaint table."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cashtrail import contract
from cashtrail.functions import money
from cashtrail.operators import clean, learn, neighbours, search, splits
from cashtrail.plans import training
from cashtrail.plans.catalog import register
from cashtrail.session import new_folder
from cashtrail.sources import demo_tables, readers, writers

# Features that are the same doubles in every engine (no trigonometry in them).
PLAIN_FEATURES = (
    "amount_lost",
    "complaint_lat",
    "complaint_lng",
    "predicted_withdrawal_lat",
    "predicted_withdrawal_lng",
    "hour",
    "day_of_week",
)


def _rows(spark, sf):
    return clean.add_model_features(clean.prepare_complaints(demo_tables.complaints(spark, sf)))


def _frames(spark, sf):
    train, test = splits.train_test(_rows(spark, sf))
    preprocessor = clean.fit_preprocessor(train)
    return clean.feature_frame(train, preprocessor), clean.feature_frame(test, preprocessor)


@register
def knn_impute(spark, sf):
    rows = clean.add_time_features(demo_tables.gappy_complaints(spark, sf))
    train, _ = splits.train_test(rows)
    filled = neighbours.knn_impute(rows, train, PLAIN_FEATURES)
    return filled.select("complaint_id", F.round("amount_lost", 4).alias("amount_lost"))


@register
def knn_regress(spark, sf):
    train, test = splits.train_test(clean.add_time_features(demo_tables.complaints(spark, sf)))
    guessed = neighbours.knn_predict(test, train, PLAIN_FEATURES, contract.TARGETS)
    return guessed.select("complaint_id", *[F.round(learn.hat(t), 6).alias(learn.hat(t)) for t in contract.TARGETS])


@register
def feature_frame(spark, sf):
    """Assemble, store and read back the model matrix."""
    rows = _rows(spark, sf)
    path = new_folder(spark, "matrix")
    writers.replace_table(clean.feature_frame(rows, clean.fit_preprocessor(rows)), path)
    values = vector_to_array("features")
    return readers.read_stage(spark, path).select(
        "complaint_id",
        F.size(values).alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 3).alias("feature_sum"),
        *contract.TARGETS,
    )


def _one_feature(spark, sf, name):
    """Key, one feature as a vector, and the targets: what is not asked for is not derived."""
    rows = demo_tables.complaints(spark, sf)
    wanted = rows if name in rows.columns else clean.add_time_features(rows)
    wanted = wanted.select("complaint_id", name, *contract.TARGETS).dropna()
    return VectorAssembler(inputCols=[name], outputCol="features").transform(wanted)


def _hats(spark, sf, learner, name, params, digits=6):
    rows = _one_feature(spark, sf, name)
    model = learn.learner(learner).fit(rows, contract.TARGETS, params)
    hats = [learn.hat(t) for t in contract.TARGETS]
    return model.transform(rows).select("complaint_id", *[F.round(h, digits).alias(h) for h in hats])


@register
def ridge_single(spark, sf):
    return _hats(spark, sf, "Ridge Regression", "amount_lost", {"alpha": 10.0})


@register
def tree_by_day(spark, sf):
    """A full tree over the days of the week predicts the mean of each."""
    return _hats(spark, sf, "Decision Tree", "day_of_week", {"max_depth": 10})


@register
def forest_by_day(spark, sf):
    return _hats(spark, sf, "Random Forest", "day_of_week", {"n_estimators": 50, "max_depth": 10, "bootstrap": False})


@register
def boosting_by_day(spark, sf):
    """Trees of depth six part seven days in any order of cuts: the first fits the means, later ones add nothing."""
    params = {"n_estimators": 50, "learning_rate": 0.1, "max_depth": 6}
    return _hats(spark, sf, "Gradient Boosting", "day_of_week", params, digits=4)


@register
def cross_validation(spark, sf):
    """Mean R2 of a line over both targets and three folds."""
    rows = _one_feature(spark, sf, "amount_lost")
    found = learn.cross_validate(learn.learner("Linear Regression"), {}, rows)
    return spark.createDataFrame([(found,)], "cv_r2 double").select(F.round("cv_r2", 6).alias("cv_r2"))


def _single_feature():
    return LinearRegression(featuresCol="features", labelCol="risk_score", solver="normal", regParam=0.0)


@register
def ols_single(spark, sf):
    model = _single_feature().fit(_one_feature(spark, sf, "amount_lost"))
    line = [(float(model.coefficients[0]), float(model.intercept))]
    return spark.createDataFrame(line, "slope double, intercept double").select(
        F.round("slope", 10).alias("slope"), F.round("intercept", 6).alias("intercept")
    )


@register
def model_roundtrip(spark, sf):
    """Fit a pipeline, store it, load it and score with it."""
    rows = _one_feature(spark, sf, "amount_lost").drop("features")
    stages = [VectorAssembler(inputCols=["amount_lost"], outputCol="features"), _single_feature()]
    path = new_folder(spark, "model")
    writers.save_model(Pipeline(stages=stages).fit(rows), path)
    scored = writers.load_model(PipelineModel, path).transform(rows)
    return scored.select("complaint_id", F.round("prediction", 4).alias("prediction"))


def _scored_by_run(spark, rows, features):
    """Train a line on the features, store the run, load it and score the whole table with it."""
    stages = training.Stages(new_folder(spark, "run"), "2024-01-31")
    writers.write_split(splits.with_split(rows), stages.split)
    training.transform_stage(spark, stages, features)
    train = readers.read_stage(spark, f"{stages.matrix}_train")
    learn.learner("Linear Regression").fit(train, contract.TARGETS, {}).save(stages.model)
    scored = training.load_run(spark, stages.base, stages.run_ts).bulk_score(rows)
    return scored.select(
        "complaint_id", "withdrawal_probability", "predicted_hours_to_withdrawal", "risk_level", "confidence_score", "alert_radius_km"
    )


@register
def model_bulk_score(spark, sf):
    """A stored run of one feature scores the whole table."""
    return _scored_by_run(spark, _rows(spark, sf), ("amount_lost",))


@register
def model_bulk_score_gaps(spark, sf):
    """A stored run of two features, whose gaps are filled from the nearest training rows when it learns and when it scores."""
    rows = clean.add_time_features(demo_tables.gappy_complaints(spark, sf))
    return _scored_by_run(spark, rows, ("amount_lost", "hour"))


def _scores(spark, sf, *learners):
    table, _ = learn.evaluate(*_frames(spark, sf), learners=learners)
    return table


@register
def model_scores(spark, sf):
    return _scores(spark, sf, learn.learner("Linear Regression"), learn.learner("Ridge Regression"))


@register
def learned_ridge_tree_forest(spark, sf):
    return _scores(
        spark,
        sf,
        learn.learner("Ridge Regression").with_grid(alpha=(1.0,)),
        learn.learner("Decision Tree").with_grid(max_depth=(10,)),
        learn.learner("Random Forest").with_grid(n_estimators=(10,), max_depth=(8,)),
        learn.learner("Gradient Boosting").with_grid(n_estimators=(10,), learning_rate=(0.2,)),
    )


@register
def knn_scores(spark, sf):
    return _scores(spark, sf, learn.learner("KNN").with_grid(n_neighbors=(5,)))


@register
def adaboost(spark, sf):
    return _scores(spark, sf, learn.learner("AdaBoost").with_grid(n_estimators=(6,)))


@register
def run_log(spark, sf):
    scores = _scores(spark, sf, learn.learner("Linear Regression"), learn.learner("Ridge Regression"))
    path = new_folder(spark, "runs")
    learn.log_runs(scores, path, "2024-01-31")
    return learn.best_model(learn.read_runs(spark, path))


def _by_level(spark, sf):
    """Train and test rows whose one feature is the amount's level: four values, which trees of depth three part."""
    rows = demo_tables.complaints(spark, sf).withColumn("amount_level", money.amount_risk_level(F.col("amount_lost")).cast("double"))
    rows = rows.select("complaint_id", "amount_level", *contract.TARGETS).dropna()
    return splits.train_test(VectorAssembler(inputCols=["amount_level"], outputCol="features").transform(rows))


@register
def model_search(spark, sf):
    """All learners over their whole grids: every candidate, the choice, its scores and flags, the best model."""
    candidates, scores, _ = search.evaluate(*_by_level(spark, sf))
    best = "row_number() OVER (ORDER BY round(test_r2, 6) DESC, model) = 1 AS best"
    scores = scores.drop("cv_r2", "params").selectExpr("*", best, "true AS chosen")
    figures = ["cv_r2", "train_r2", "train_mse", "train_mae", "test_r2", "test_mse", "test_mae"]
    return candidates.join(scores, ["model", "chosen"], "left").select(
        "model", "params", "chosen", *[F.round(c, 6).alias(c) for c in figures], "below_expected", "overfit", "best"
    )


@register
def run_history(spark, sf):
    """Two runs of a search in one log, one of them logged twice; the best model of each."""
    path = new_folder(spark, "runs")
    quick = [learn.learner(n) for n in ("Decision Tree", "Ridge Regression", "Linear Regression")]
    _, scores, _ = search.evaluate(*_by_level(spark, sf), learners=quick)
    for run_ts, kept in (("2024-01-30", "model <> 'Decision Tree'"), ("2024-01-31", "true"), ("2024-01-31", "true")):
        learn.log_runs(scores.where(kept), path, run_ts)
    return learn.best_of_runs(learn.read_runs(spark, path)).select(
        "run_ts", "models", "model", "params", F.round("test_r2", 6).alias("test_r2"), "below_expected", "overfit"
    )
