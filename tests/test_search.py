"""Shared searches and level-wise trees against one-by-one models in NumPy."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cashtrail.operators import learn, search, splits, trees
from cashtrail.session import new_folder

TARGETS = ["withdrawal_probability", "risk_score"]
SIZES = {name: getattr(trees, name) for name in ("FEW", "CELLS", "NODES")}


@pytest.fixture(autouse=True)
def own_sizes(request, monkeypatch):
    """Sizes that a frame shared by several tests makes small hold in these tests only."""
    if "framed" not in request.fixturenames:
        for name, size in SIZES.items():
            monkeypatch.setattr(trees, name, size)


def table(spark, n=300, values=5, parts=3):
    rng = np.random.default_rng(11)
    x = rng.integers(0, values, (n, 2)).astype(float)
    y1 = np.where(x[:, 0] > 1, 2.0, -1.0) + 0.3 * x[:, 1] + rng.normal(0, 0.2, n).round(3)
    y2 = x[:, 0] * x[:, 1] + rng.normal(0, 0.3, n).round(3)
    rows = [(f"r{i:04d}", *map(float, x[i]), float(y1[i]), float(y2[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "complaint_id string, a double, b double, withdrawal_probability double, risk_score double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.repartition(parts)), x, np.column_stack([y1, y2])


def folds_of(n):
    return np.array([int(hashlib.md5(f"r{i:04d}fold".encode()).hexdigest()[:7], 16) % 3 for i in range(n)])


def plain_tree(x, y, w, depth):
    """Greedy least squares; a function of rows."""
    some = w > 0
    value = (w * y).sum() / w.sum()
    best = (1e-12 * max(1.0, (w * y).sum() ** 2 / w.sum()), None, None)
    for f in range(x.shape[1]):
        seen = np.unique(x[some, f])
        for c in (seen[:-1] + seen[1:]) / 2:
            low = x[:, f] <= c
            gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (low, ~low)) - (w * y).sum() ** 2 / w.sum()
            if gain > best[0] + 1e-9:
                best = (gain, f, c)
    if depth == 0 or best[1] is None:
        return lambda z: np.full(len(z), value)
    low = x[:, best[1]] <= best[2]
    below, above = (plain_tree(x[s], y[s], w[s], depth - 1) for s in (low, ~low))
    return lambda z: np.where(z[:, best[1]] <= best[2], below(z), above(z))


def binned(frame, x):
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(frame.limits)], axis=1).astype(np.uint8)


@pytest.fixture(scope="module", params=["few", "several passes"])
def framed(spark, request):
    df, x, y = table(spark)
    patch = pytest.MonkeyPatch()
    if request.param != "few":
        patch.setattr(trees, "FEW", 3)
        patch.setattr(trees, "CELLS", 80)
        patch.setattr(trees, "NODES", 2)
    frame = trees.frame(df, splits.fold("complaint_id"), "complaint_id", TARGETS, members=6)
    assert (frame.few is None) == (request.param != "few")
    yield frame, x, y
    patch.undo()


def test_a_depth_cuts_a_deeper_tree(framed):
    frame, x, y = framed
    models = [(h, t) for h in range(4) for t in range(2)]
    deep = trees.single_trees(frame, models, 4)
    fold = folds_of(len(x))
    for (h, t), model in zip(models, deep):
        for depth in (1, 2, 4):
            expected = plain_tree(x, y[:, t], (fold != h).astype(float), depth)(x)
            np.testing.assert_allclose(model.part(1, depth).predict(binned(frame, x)), expected, rtol=1e-9)


def test_forest_members_are_drawn_by_key(framed):
    frame, x, y = framed

    def drawn(i, j):
        number = int(hashlib.md5(f"r{i:04d}bag{j // 4}".encode()).hexdigest()[7 * (j % 4) : 7 * (j % 4) + 7], 16) / 2**28
        return next((k for k, p in enumerate(trees.POISSON) if number < p), 9)

    weights = np.array([[drawn(i, j) for j in range(6)] for i in range(len(x))], dtype=float)
    forest = trees.forests(frame, [(3, 1)], 6, 3)[0]
    for members in (2, 6):
        expected = np.mean([plain_tree(x, y[:, 1], weights[:, j], 3)(x) for j in range(members)], axis=0)
        np.testing.assert_allclose(forest.part(members).predict(binned(frame, x)), expected, rtol=1e-9)


def test_boosting_equals_stages_one_by_one(framed, monkeypatch):
    frame, x, y = framed
    monkeypatch.setattr(trees, "SEGMENT", 2)
    models = [(0, 0, 0.1), (3, 1, 0.5)]
    got = trees.boosted(frame, models, 4, depth=2)
    fold = folds_of(len(x))
    for (h, t, rate), model in zip(models, got):
        w = (fold != h).astype(float)
        now = np.full(len(x), y[w > 0, t].mean())
        for i in range(4):
            now = now + rate * plain_tree(x, y[:, t] - now, w, 2)(x)
            np.testing.assert_allclose(model.part(i + 1).predict(binned(frame, x)), now, rtol=1e-9)


def test_adaboost_equals_rounds_one_by_one(framed, monkeypatch):
    frame, x, y = framed
    monkeypatch.setattr(trees, "SEGMENT", 2)
    models = [(1, 0), (3, 1)]
    fold = folds_of(len(x))
    for (h, t), model in zip(models, trees.reweighted(frame, models, 5, depth=1)):
        learns = fold != h
        w, answers, votes = learns.astype(float), [], []
        for _ in range(5):
            guess = plain_tree(x, y[:, t], w, 1)(x)
            miss = np.abs(guess - y[:, t])
            worst = miss[learns].max()
            loss = (w * miss).sum() / worst / w.sum()
            if loss >= 0.5:
                break
            answers.append(guess)
            votes.append(math.log((1 - loss) / loss))
            w = w * (loss / (1 - loss)) ** (1 - np.minimum(miss / worst, 1))
        np.testing.assert_allclose(model.votes, votes, rtol=1e-9)
        expected = [sorted(zip(row, votes)) for row in np.array(answers).T]
        for row, got in zip(expected, model.predict(binned(frame, x))):
            upto = list(itertools.accumulate(v for _, v in row))
            assert math.isclose(next(a for (a, _), u in zip(row, upto) if u >= 0.5 * sum(votes) - 1e-12), got, rel_tol=1e-9)


def test_perfect_trees_and_no_variance(spark):
    df = spark.createDataFrame([(f"r{i}", float(i % 2), float(i % 2) * 3, 7.0) for i in range(40)], "complaint_id string, a double, withdrawal_probability double, risk_score double")
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    frame = trees.frame(rows, splits.fold("complaint_id"), "complaint_id", TARGETS)
    perfect, flat = trees.reweighted(frame, [(3, 0), (3, 1)], 5)
    assert len(perfect.trees) == 1 and perfect.predict(np.array([[0], [1]], dtype=np.uint8)).tolist() == [0.0, 3.0]
    assert flat.predict(np.array([[0], [1]], dtype=np.uint8)).tolist() == [7.0, 7.0]


def test_missing_numbers_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0, None, 1.0), ("b", 2.0, 1.0, 1.0)], "complaint_id string, a double, withdrawal_probability double, risk_score double")
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    with pytest.raises(Exception, match="must be there"):
        trees.frame(rows, splits.fold("complaint_id"), "complaint_id", TARGETS).data.count()


def test_wide_features_are_cut_at_quantiles(spark):
    df, x, _ = table(spark, n=400, values=300)
    frame = trees.frame(df, splits.fold("complaint_id"), "complaint_id", TARGETS, most=16)
    assert all(10 <= len(c) <= 15 for c in frame.limits)
    counts = np.bincount(binned(frame, x)[:, 0])
    assert counts.max() < 60


def test_stored_ensembles_answer_alike(spark, framed):
    frame, x, _ = framed
    df, *_ = table(spark, n=50)
    for model in (trees.forests(frame, [(3, 0)], 3, 3)[0].part(2, 2), trees.boosted(frame, [(3, 1, 0.3)], 3)[0], trees.reweighted(frame, [(3, 1)], 4)[0]):
        path = new_folder(spark, "ensemble")
        model.write().overwrite().save(path)
        again = trees.Ensemble.load(path)
        pair = [m.transform(df).select("complaint_id", "prediction").orderBy("complaint_id").collect() for m in (model, again)]
        assert pair[0] == pair[1]


def test_shared_scores_equal_separate_ones(spark):
    df, *_ = table(spark, n=240)
    context = search.Context(df.persist(), TARGETS, 3, 0)
    for name, grid in (("Ridge Regression", {"alpha": (1.0, 10.0)}), ("Linear Regression", {}), ("KNN", {"n_neighbors": (3, 5)})):
        one = learn.learner(name).with_grid(**grid)
        found = search.tried(context, one)
        assert [c.params for c in found] == one.candidates()
        for c in found:
            assert c.cv_r2 == pytest.approx(learn.cross_validate(one, c.params, df, TARGETS), abs=1e-9)


def test_choice_and_flags(spark):
    df, *_ = table(spark, n=240)
    train, test = splits.train_test(df)
    own = learn.Learner("Mean of one tree", learn.learner("Decision Tree").fit, {"max_depth": (1, 3)})
    learners = [learn.learner("Decision Tree").with_grid(max_depth=(1, 4, 9)), learn.learner("AdaBoost").with_grid(n_estimators=(2, 4)), own]
    candidates, scores, models = search.evaluate(train, test, learners, TARGETS)
    assert candidates.count() == 7 and candidates.where("chosen").count() == 3
    best = candidates.where("model = 'Decision Tree'").orderBy(F.round("cv_r2", 9).desc(), "position").first()
    assert best["chosen"] and scores.where("model = 'Decision Tree'").first()["params"] == best["params"]
    row = scores.where("model = 'Decision Tree'").first()
    assert row["test_r2"] == pytest.approx(learn.measure(models["Decision Tree"], test, TARGETS)["r2"])


def test_a_run_that_is_logged_again_replaces_its_rows(spark):
    scores = spark.createDataFrame([("a", "{}", 0.1, *[0.5] * 6), ("b", "{}", 0.2, *[0.6] * 6)], learn.SCORE_SCHEMA)
    path = new_folder(spark, "runs")
    for run in ("one", "two", "two"):
        learn.log_runs(learn.judge(scores), path, run)
    runs = learn.read_runs(spark, path)
    assert runs.count() == 4
    assert {(r["run_ts"], r["model"], r["models"]) for r in learn.best_of_runs(runs).collect()} == {("one", "b", 2), ("two", "b", 2)}


def test_packed_weights_and_totals_equal_rows(spark):
    """Few rows of bins: no round writes a state, and the held-out error comes from sums."""
    df, x, y = table(spark)
    frame = trees.frame(df, splits.fold("complaint_id"), "complaint_id", TARGETS, members=2)
    written = []
    patch = pytest.MonkeyPatch()
    shelved = trees.shelved
    patch.setattr(trees, "shelved", lambda rows, purpose: written.append(purpose) or shelved(rows, purpose))
    patch.setattr(trees, "SEGMENT", 1)
    patch.setattr(trees, "PACK", 4)
    trees.boosted(frame, [(0, 0, 0.1)], 3)
    (model,) = trees.reweighted(frame, [(0, 1)], 3)
    patch.undo()
    assert written == ["packed"] and len(model.trees) == 3
    found, fold = trees.totals(frame), folds_of(len(x))
    assert found.folds == [0, 1, 2]
    np.testing.assert_allclose(found.n.sum(axis=1), np.bincount(fold))
    context = search.Context(df, TARGETS, 3, 2)
    context._frame = frame
    grown = [trees.single_trees(frame, context.models, 3)]
    sums = search._held_out_r2(context, grown)
    bins, expected = binned(frame, x), []
    for e, (h, t) in zip(grown[0], context.models):
        if h < 3:
            own = y[fold == h, t]
            expected.append(1 - ((own - e.predict(bins[fold == h])) ** 2).sum() / ((own - own.mean()) ** 2).sum())
    assert sums[0] == pytest.approx(np.mean(expected), abs=1e-12)


def test_draws_and_bytes_are_read_without_a_list(monkeypatch):
    import pyarrow as pa

    texts = ["".join(hashlib.md5(f"r{i}bag{j}".encode()).hexdigest()[:28] for j in range(2)) for i in range(500)]
    # on both sides of a limit that the first four digits don't decide
    edge = int(trees.POISSON[2] * 2**28)
    texts += [f"{edge:07x}{edge + 1:07x}" + "0" * 42, "f" * 56]
    expected = [[next((k for k, p in enumerate(trees.POISSON) if int(t[7 * j : 7 * j + 7], 16) / 2**28 < p), 9) for j in range(6)] for t in texts]
    column = pa.array(["skipped", *texts]).slice(1)
    assert trees._drawn(trees._rows_of(column), 6).tolist() == expected
    rows = np.arange(12.0).reshape(4, 3)
    assert trees._rows_of(trees._bytes_of(rows).slice(1, 2), np.float64).tolist() == rows[1:3].tolist()
    assert trees._rows_of(trees._bytes_of(np.zeros((4, 0)))).shape == (4, 0)


def test_answers_and_totals_leave_draws_unread(spark):
    df, *_ = table(spark, n=60)
    frame = trees.frame(df, splits.fold("complaint_id"), "complaint_id", TARGETS, members=8)
    read = trees._without_draws(frame.data).select("fold", "bins", "y", "drawn")._jdf.queryExecution().executedPlan().toString()
    assert "drawn" not in read.split("ReadSchema")[1]
    (model,) = trees.single_trees(frame, [(3, 0)], 2)
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "pandas" not in plan.lower()


def test_equal_targets_are_packed_once_with_their_number(spark):
    rows = [(f"r{i:03d}", float(i % 2), float(i % 6), float(i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "complaint_id string, a double, withdrawal_probability double, risk_score double").repartition(4)
    frame = trees.frame(VectorAssembler(inputCols=["a"], outputCol="features").transform(df), splits.fold("complaint_id"), "complaint_id", TARGETS)
    packed = trees.Packed.of(frame)
    found = {}
    for r in packed.data.collect():
        y, n = (np.frombuffer(r[c], dtype=float) for c in ("y", "n"))
        assert (np.diff(y) > 0).all() and (r["low"], r["high"]) == (y[0], y[-1])
        for value, number in zip(y.tolist(), n.tolist()):
            key = (r["fold"], r["place"], r["target"], value)
            assert key not in found
            found[key] = number
    assert len(found) == 3 * 2 * (3 + 3) and sum(found.values()) == 1200
    expected = {}
    ids = [int(hashlib.md5(f"r{i:03d}fold".encode()).hexdigest()[:7], 16) % 3 for i in range(600)]
    for i, f in enumerate(ids):
        for t, value in enumerate((i % 6, i % 3)):
            expected[f, i % 2, t, float(value)] = expected.get((f, i % 2, t, float(value)), 0) + 1
    assert found == expected
