import json

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cashtrail.operators import adaboost, learn, metrics, scoring
from cashtrail.plans import dashboard, training
from cashtrail.session import new_folder
from cashtrail.sources import demo_tables, writers


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (400, 3))
    y1 = 1 + x @ [0.5, -2.0, 0.3] + rng.normal(0, 0.1, 400)
    y2 = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1]
    rows = [(f"r{i:04d}", *map(float, x[i]), float(y1[i]), float(y2[i])) for i in range(400)]
    df = spark.createDataFrame(
        rows, "complaint_id string, a double, b double, c double, withdrawal_probability double, risk_score double"
    )
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist(), x, y1, y2


def test_linear_equals_normal_equations(table):
    df, x, y1, _ = table
    model = learn.learner("Linear Regression").fit(df, ["withdrawal_probability"], {})
    fitted = model.models["withdrawal_probability"]
    solved, *_ = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y1, rcond=None)
    np.testing.assert_allclose([fitted.intercept, *fitted.coefficients], solved, rtol=1e-8)


@pytest.mark.parametrize("alpha", [1.0, 10.0])
def test_ridge_equals_closed_form(table, alpha):
    df, x, y1, _ = table
    fitted = learn.learner("Ridge Regression").fit(df, ["withdrawal_probability"], {"alpha": alpha}).models[
        "withdrawal_probability"
    ]
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y1 - y1.mean()))
    np.testing.assert_allclose(list(fitted.coefficients), weights, rtol=1e-6)


def test_r_squared_limits(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (3.0, 3.0, 2.0)], "y double, good double, mean double")
    got = df.select(metrics.r_squared("y", "good"), metrics.r_squared("y", "mean")).first()
    assert tuple(got) == (1.0, 0.0)


def test_classification_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    assert tuple(metrics.classification_metrics(df, "y", "p").first()) == (0.5, 0.5, 0.5)
    none = spark.createDataFrame([(0, 0)], "y int, p int")
    assert tuple(metrics.classification_metrics(none, "y", "p").first()) == (0.0, 0.0, 0.0)


def test_boosting_beats_one_tree_and_survives_storage(spark, table):
    df, *_ = table
    one = adaboost.fit(df, "withdrawal_probability", rounds=1)
    many = adaboost.fit(df, "withdrawal_probability", rounds=12, checkpoint_every=4)

    def r2(model):
        scored = model.transform(df)
        return scored.agg(metrics.r_squared("withdrawal_probability", "prediction")).first()[0]

    assert len(many.trees) > 1 and r2(many) > r2(one)
    path = new_folder(spark, "boosted")
    many.write().overwrite().save(path)
    assert r2(adaboost.BoostedTrees.load(path)) == pytest.approx(r2(many))


def test_weighted_median(spark, table):
    """The median of the trees' answers is the smallest one that half the votes do not exceed."""
    df, *_ = table
    model = adaboost.fit(df, "withdrawal_probability", rounds=5)
    rows = df.limit(20)
    answers = rows
    for i, tree in enumerate(model.trees):
        answers = tree.transform(answers).withColumnRenamed("prediction", f"p{i}")
    got = {r["complaint_id"]: r["prediction"] for r in model.transform(rows).collect()}
    for r in answers.collect():
        ranked = sorted(zip([r[f"p{i}"] for i in range(len(model.trees))], model.votes))
        upto = np.cumsum([v for _, v in ranked])
        assert got[r["complaint_id"]] == ranked[int(np.argmax(upto >= 0.5 * upto[-1]))][0]


def test_search_and_choice(table):
    df, *_ = table
    train, test = df.where("complaint_id < 'r0300'"), df.where("complaint_id >= 'r0300'")
    scores, models = learn.evaluate(
        train,
        test,
        [
            learn.learner("Linear Regression"),
            learn.learner("Decision Tree").with_grid(max_depth=(2, 6)),
            learn.learner("KNN").with_grid(n_neighbors=(5, 7)),
        ],
    )
    rows = {r["model"]: r for r in scores.collect()}
    assert json.loads(rows["Decision Tree"]["params"]) == {"max_depth": 6}
    assert rows["Decision Tree"]["cv_r2"] is not None and rows["Linear Regression"]["cv_r2"] is None
    best = learn.best_model(scores).first()
    assert best["test_r2"] == max(r["test_r2"] for r in rows.values())
    assert set(models) == set(rows)


def test_default_grids_are_complete():
    sizes = {one.name: len(one.candidates()) for one in learn.LEARNERS}
    assert sizes == {
        "Random Forest": 4,
        "Gradient Boosting": 4,
        "Linear Regression": 1,
        "Ridge Regression": 2,
        "Decision Tree": 2,
        "KNN": 2,
        "AdaBoost": 2,
    }


def test_training_run(spark, complaints):
    base = new_folder(spark, "training")
    complaints.write.options(**writers.CSV_OPTIONS).csv(base + "/source.csv")
    result = training.run_training(
        spark,
        base + "/source.csv",
        base + "/artifact",
        "20240131",
        [learn.learner("Linear Regression"), learn.learner("Decision Tree").with_grid(max_depth=(5,))],
        publish_to=base + "/published",
    )
    assert result.best_model == "Decision Tree"
    n = complaints.count()
    for stage in ("feature_store", "split"):
        assert spark.read.parquet(getattr(result.stages, stage)).count() == n
    assert spark.read.parquet(base + "/published").count() == n
    assert learn.read_runs(spark, base + "/artifact/runs").count() == 2
    scored = training.predict(spark.read.parquet(result.stages.feature_store), result.preprocessor, result.model)
    assert {"withdrawal_probability_hat", "risk_score_hat"} <= set(scored.columns) and scored.count() == n
    loaded = training.load_run(spark, base + "/artifact", "20240131").predict(spark.read.parquet(result.stages.feature_store))
    guess = ["complaint_id", "risk_score_hat"]
    assert loaded.select(guess).exceptAll(scored.select(guess)).isEmpty()


def test_single_score_is_the_bulk_score(spark, complaints):
    row = complaints.orderBy("complaint_id").first().asDict()
    row["timestamp"] = row["timestamp"].isoformat()
    single = scoring.single_score(spark, row, "2024-01-31").first()
    bulk = scoring.score(complaints.drop(*scoring.RESULT_COLUMNS[1:])).where(
        F.col("complaint_id") == row["complaint_id"]
    )
    assert single == bulk.select(*scoring.RESULT_COLUMNS).first()


def test_routing(spark):
    alerts = spark.createDataFrame([("1", "lea"), ("2", "bank"), ("3", "other")], "alert_id string, role string")
    routed = scoring.route(alerts, F.col("role")).select("alert_id", "recipient")
    assert sorted(map(tuple, routed.collect())) == [("1", "lea"), ("2", "bank"), ("3", "bank"), ("3", "lea")]


def test_dashboards(spark, sf_dir, complaints):
    as_of = F.lit("2024-01-31")
    log = scoring.prediction_log(scoring.score(complaints.drop(*scoring.RESULT_COLUMNS[1:])))
    pages = {
        **dashboard.system_stats(complaints, log, as_of),
        **dashboard.analytics_data(complaints),
        **dashboard.enhanced_analytics(complaints, as_of),
        **dashboard.dataset_report(complaints),
        **dashboard.dataset_summary(complaints),
    }
    for name, page in pages.items():
        assert page.count() > 0, name
    assert dashboard.risk_heatmap(log, as_of, 30).count() > dashboard.risk_heatmap(log, as_of, 30, "NATION_2").count() > 0


def test_cities_of_one_name(spark):
    from cashtrail.operators import analytics

    df = spark.createDataFrame(
        [("1", "Udaipur", "Rajasthan", 70.0), ("2", "Udaipur", "Tripura", 80.0)],
        "complaint_id string, complaint_city string, complaint_state string, risk_score double",
    )
    assert tuple(analytics.city_stats(df).first()) == ("Udaipur", 2, 0.75)
    assert analytics.city_stats(df, by_state=True).count() == 2


def test_reports_equal_complaints(spark, sf_dir, complaints):
    reports = demo_tables.reports(spark, sf_dir)
    assert reports.exceptAll(complaints.select(*reports.columns)).isEmpty()


def test_every_kind_of_model_can_be_stored(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(str(i), Vectors.dense([float(i), float(i % 3)]), float(i), float(i * 2)) for i in range(40)]
    train = spark.createDataFrame(rows, ["complaint_id", "features", "a", "b"])
    for name, params in (("Linear Regression", {}), ("KNN", {"n_neighbors": 3}), ("AdaBoost", {"n_estimators": 3}), ("Decision Tree", {"max_depth": 3})):
        model = learn.learner(name).fit(train, ["a", "b"], params)
        path = new_folder(spark, "model")
        model.save(path)
        one, other = (m.transform(train).select("complaint_id", "a_hat", "b_hat") for m in (model, learn.load(spark, path)))
        assert one.exceptAll(other).isEmpty() and other.count() == 40, name


def test_folds_read_written_rows(spark):
    """What leads to the training rows, a join say, is not run again for each fold."""
    rows = [(f"r{i}", float(i % 7), float(i % 7) + i % 3, float(i % 5)) for i in range(90)]
    left = spark.createDataFrame([r[:2] for r in rows], "complaint_id string, a double")
    right = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "complaint_id string, withdrawal_probability double, risk_score double")
    train = VectorAssembler(inputCols=["a"], outputCol="features").transform(left.join(right, "complaint_id"))
    line, plans = learn.learner("Linear Regression"), []

    def fit(some, targets, params):
        plans.append(some._jdf.queryExecution().optimizedPlan().toString())
        return line.fit(some, targets, params)

    learn.cross_validate(learn.Learner("line", fit, {}), {}, train)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
