"""Cross-validated choice of parameters, where the candidates of a learner share their work.

The rows are binned, folded and stored once. A candidate that is part of a larger one is
not learnt again: half the trees of a forest, the first rounds of boosting, a tree cut at
a smaller depth, the nearest five of the nearest seven. All folds, both targets and the
refit on all rows (the model with no fold held out) grow side by side in the same passes.
Ridge candidates are solved from one table of moments per fold, and their errors on the
fold held out follow from the same moments. So each learner costs passes by its largest
candidate, whatever the size of its grid.

Scores are compared at nine digits; the first candidate of a grid wins a tie.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtrail.contract import LIMITS, TARGETS, Limits
from cashtrail.operators import learn, splits, trees
from cashtrail.operators.neighbours import donor_index, with_means

DIGITS = 9
CANDIDATE_SCHEMA = "model string, params string, position int, cv_r2 double, chosen boolean"


@dataclass
class Context:
    """What the learners share: the training rows and their stored frame."""

    train: DataFrame
    targets: Sequence[str]
    folds: int
    bags: int
    key: str = learn.KEY
    _frame: trees.Frame | None = field(default=None, repr=False)
    _totals: trees.Totals | None = field(default=None, repr=False)

    @property
    def frame(self) -> trees.Frame:
        if self._frame is None:
            self._frame = trees.frame(self.train, splits.fold(self.key, self.folds), self.key, self.targets, self.bags)
        return self._frame

    @property
    def totals(self) -> trees.Totals:
        if self._totals is None:
            self._totals = trees.totals(self.frame)
        return self._totals

    @property
    def models(self) -> list[tuple[int, int]]:
        """(fold held out, target); the number of folds stands for none."""
        return [(h, t) for h in range(self.folds + 1) for t in range(len(self.targets))]


@dataclass
class Tried:
    params: dict
    cv_r2: float
    refit: Callable[[], object]


def _r2(n: float, y: float, yy: float, error: float) -> float:
    spread = yy - y * y / n if n else 0.0
    return 1 - error / spread if spread > 0 else (1.0 if error == 0 else 0.0)


def _held_out_r2(context: Context, kinds: Sequence[Sequence[trees.Ensemble]]) -> list[float]:
    """Mean R2 over folds and targets of each kind, a list of one ensemble per model; one pass."""
    models = [(m, h, t) for m, (h, t) in enumerate(context.models) if h < context.folds]
    if context.frame.few is not None:
        # rows of equal bins get equal answers, so their sums tell the error
        known, shapes = context.totals, trees._shapes(context.frame.few)

        def r2(ensemble: trees.Ensemble, h: int, t: int) -> float:
            own = [f == h for f in known.folds]
            n, y, yy = known.n[own].sum(axis=0), known.y[own, :, t].sum(axis=0), known.yy[own, :, t].sum(axis=0)
            guess = ensemble.predict(shapes) - known.middle[t]
            return _r2(n.sum(), y.sum(), yy.sum(), (yy - 2 * guess * y + n * guess * guess).sum())

        return [math.fsum(r2(ensembles[m], h, t) for m, h, t in models) / len(models) for ensembles in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kinds), len(models), 4))
        for raw in batches:
            batch = trees.Batch.of(raw)
            for j, (m, h, t) in enumerate(models):
                some = batch.fold == h
                y, bins = batch.y[some, t], batch.bins[some]
                for k, ensembles in enumerate(kinds):
                    miss = y - ensembles[m].predict(bins) if len(y) else y
                    sums[k, j] += (len(y), y.sum(), (y * y).sum(), (miss * miss).sum())
        flat = sums.reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), *[pa.array(c) for c in flat.T]], ["at", "n", "y", "yy", "error"])

    parts = context.frame.data.mapInArrow(run, "at int, n double, y double, yy double, error double")
    found = np.zeros((len(kinds) * len(models), 4))
    for r in parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "error")]).collect():
        found[r["at"]] = tuple(r)[1:]
    return [math.fsum(_r2(*row) for row in part) / len(models) for part in found.reshape(len(kinds), len(models), 4)]


def _of_ensembles(context: Context, options: Sequence[dict], parts: Sequence[Sequence[trees.Ensemble]]) -> list[Tried]:
    """Candidates whose ensembles, one per model, are grown already."""
    scores = _held_out_r2(context, parts)
    refits = [ensembles[context.folds * len(context.targets) :] for ensembles in parts]
    return [
        Tried(p, s, lambda own=own: learn.PerTarget(dict(zip(context.targets, own)))) for p, s, own in zip(options, scores, refits)
    ]


def _forest(context: Context, options: Sequence[dict]) -> list[Tried]:
    members, depth = max(p["n_estimators"] for p in options), max(p["max_depth"] for p in options)
    whole = trees.forests(context.frame, context.models, members, depth)
    return _of_ensembles(context, options, [[e.part(p["n_estimators"], p["max_depth"]) for e in whole] for p in options])


def _tree(context: Context, options: Sequence[dict]) -> list[Tried]:
    whole = trees.single_trees(context.frame, context.models, max(p["max_depth"] for p in options))
    return _of_ensembles(context, options, [[e.part(1, p["max_depth"]) for e in whole] for p in options])


def _boosting(context: Context, options: Sequence[dict]) -> list[Tried]:
    rates = list(dict.fromkeys(p["learning_rate"] for p in options))
    models = [(h, t, rate) for rate in rates for h, t in context.models]
    whole = trees.boosted(context.frame, models, max(p["n_estimators"] for p in options))
    size = len(context.models)
    of_rate = {rate: whole[i * size : (i + 1) * size] for i, rate in enumerate(rates)}
    return _of_ensembles(context, options, [[e.part(p["n_estimators"]) for e in of_rate[p["learning_rate"]]] for p in options])


def _adaptive(context: Context, options: Sequence[dict]) -> list[Tried]:
    whole = trees.reweighted(context.frame, context.models, max(p["n_estimators"] for p in options))
    return _of_ensembles(context, options, [[e.part(p["n_estimators"]) for e in whole] for p in options])


def moments(context: Context) -> tuple[np.ndarray, int]:
    """Folds x q x q sums of products of (1, features, targets), less the overall means."""
    rows = context.train.select(
        splits.fold(context.key, context.folds).alias("fold"),
        vector_to_array("features").alias("x"),
        F.array(*[F.col(t).cast("double") for t in context.targets]).alias("y"),
    )
    width = len(rows.select("x").first()["x"])
    size = 1 + width + len(context.targets)
    both = F.concat("x", "y")
    means = np.array(rows.agg(*[F.avg(both[i]) for i in range(size - 1)]).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((context_folds, size, size))
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            z = np.hstack([c.flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1) for c in batch.columns[1:]]) - means
            z = np.hstack([np.ones((len(fold), 1)), z])
            for f in range(context_folds):
                own = z[fold == f]
                total[f] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(range(context_folds), pa.int32()), pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64()))], ["fold", "sums"])

    context_folds = context.folds
    summed = rows.mapInArrow(run, "fold int, sums array<double>").groupBy("fold")
    found = np.zeros((context.folds, size, size))
    for r in summed.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size * size)]).alias("sums")).collect():
        found[r["fold"]] = np.reshape(r["sums"], (size, size))
    return found, width


def _linear(context: Context, options: Sequence[dict], name: str) -> list[Tried]:
    by_fold, width = moments(context)
    out = []
    for p in options:
        scores = []
        for held in by_fold:
            own = by_fold.sum(axis=0) - held
            n = own[0, 0]
            middle = own - np.outer(own[0], own[0]) / n  # about the means of the rows learnt from
            xx = middle[1 : width + 1, 1 : width + 1] + p.get("alpha", 0.0) * np.eye(width)
            for t in range(width + 1, len(own)):
                slope = np.linalg.lstsq(xx, middle[1 : width + 1, t], rcond=None)[0]
                base = (own[0, t] - own[0, 1 : width + 1] @ slope) / n
                v = np.zeros(len(own))
                v[0], v[1 : width + 1], v[t] = -base, -slope, 1.0
                scores.append(_r2(held[0, 0], held[0, t], held[t, t], float(v @ held @ v)))
        chosen = learn.learner(name)
        out.append(Tried(p, math.fsum(scores) / len(scores), lambda p=p: chosen.fit(context.train, context.targets, p)))
    return out


def _nearest(context: Context, options: Sequence[dict]) -> list[Tried]:
    """One search per fold for the largest k; smaller ones read its first neighbours."""
    flat, names = learn.Nearest._flat(context.train)
    flat = trees.shelved(flat.select(context.key, *names, *context.targets, splits.fold(context.key, context.folds).alias("fold")), "points")
    sums = np.zeros((len(options), context.folds, len(context.targets), 4))
    for f in range(context.folds):
        asked = flat.where(F.col("fold") == f)
        sizes = [p["n_neighbors"] for p in options]
        index = donor_index(flat.where(F.col("fold") != f), names, max(sizes), context.key, payload=context.targets)
        guessed = with_means(asked, index, names, context.targets, sizes, context.key, lambda i, j: f"g{i}_{j}")
        judged = guessed.where(F.col("g0_0").isNotNull())
        figures = []
        for i in range(len(options)):
            for j, t in enumerate(context.targets):
                miss = F.col(t) - F.col(f"g{i}_{j}")
                figures += [F.count(F.lit(1)), F.sum(t), F.sum(F.col(t) * F.col(t)), F.sum(miss * miss)]
        row = judged.agg(*[c.alias(f"c{n}") for n, c in enumerate(figures)]).first()
        sums[:, f] = np.array([x or 0.0 for x in row], dtype=float).reshape(len(options), len(context.targets), 4)
    return [
        Tried(
            p,
            math.fsum(_r2(*row) for row in sums[i].reshape(-1, 4)) / sums[i][..., 0].size,
            lambda p=p: learn.Nearest(context.train, context.targets, p["n_neighbors"]),
        )
        for i, p in enumerate(options)
    ]


_SHARED = {
    "Random Forest": _forest,
    "Gradient Boosting": _boosting,
    "Linear Regression": lambda c, o: _linear(c, o, "Linear Regression"),
    "Ridge Regression": lambda c, o: _linear(c, o, "Ridge Regression"),
    "Decision Tree": _tree,
    "KNN": _nearest,
    "AdaBoost": _adaptive,
}


def tried(context: Context, one: learn.Learner) -> list[Tried]:
    """Every candidate of a learner with its score; learners of other names are fitted one by one."""
    options = one.candidates()
    if one.name in _SHARED:
        return _SHARED[one.name](context, options)
    return [
        Tried(
            p,
            learn.cross_validate(one, p, context.train, context.targets, context.folds),
            lambda p=p: one.fit(context.train, context.targets, p),
        )
        for p in options
    ]


def best_of(candidates: Sequence[Tried]) -> int:
    return max(range(len(candidates)), key=lambda i: (round(candidates[i].cv_r2, DIGITS), -i))


def evaluate(
    train: DataFrame,
    test: DataFrame,
    learners: Sequence[learn.Learner] = learn.LEARNERS,
    targets: Sequence[str] = TARGETS,
    folds: int = 3,
    limits: Limits = LIMITS,
    parallel: int = 4,
) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """(all candidates, scores of the chosen ones with their flags, the chosen models).

    ``parallel`` learners run side by side: their rounds are many small jobs.
    """
    spark = train.sparkSession
    bags = max([p["n_estimators"] for one in learners if one.name == "Random Forest" for p in one.candidates()], default=0)
    context = Context(train.persist(), targets, folds, bags)
    test = test.persist()
    candidates, rows, models = [], [], {}

    def judged(one: learn.Learner) -> tuple[list[Tried], int, object, dict, dict]:
        found = tried(context, one)
        model = found[best_of(found)].refit()
        return found, best_of(found), model, learn.measure(model, context.train, targets), learn.measure(model, test, targets)

    try:
        if any(one.name in _SHARED for one in learners):
            _ = context.frame  # once, before the learners start
        with ThreadPoolExecutor(parallel) as pool:
            results = list(pool.map(judged, learners))
        for one, (found, best, model, on_train, on_test) in zip(learners, results):
            for i, c in enumerate(found):
                candidates.append((one.name, json.dumps(c.params, sort_keys=True), i, float(c.cv_r2), i == best))
            models[one.name] = model
            figures = [*[on_train[m] for m in ("r2", "mse", "mae")], *[on_test[m] for m in ("r2", "mse", "mae")]]
            rows.append((one.name, json.dumps(found[best].params, sort_keys=True), float(found[best].cv_r2), *figures))
    finally:
        context.train.unpersist()
        test.unpersist()
    scores = learn.judge(spark.createDataFrame(rows, learn.SCORE_SCHEMA), limits)
    return spark.createDataFrame(candidates, CANDIDATE_SCHEMA), scores, models
