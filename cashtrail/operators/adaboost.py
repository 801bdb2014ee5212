"""AdaBoost.R2 (Drucker, 1997) with weighted regression trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.session import shared_folder

_WEIGHT = "_boost_weight"


@dataclass(frozen=True)
class BoostedTrees:
    trees: tuple[DecisionTreeRegressionModel, ...]
    votes: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the trees' predictions."""
        names = []
        for i, tree in enumerate(self.trees):
            names.append(f"_tree_{i}")
            df = tree.transform(df).withColumnRenamed("prediction", names[-1])
        ballots = F.array_sort(
            F.array(*[F.struct(F.col(n).alias("p"), F.lit(v).alias("v")) for n, v in zip(names, self.votes)])
        )
        half = 0.5 * math.fsum(self.votes)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))

        def step(state, ballot):
            total = state["sum"] + ballot["v"]
            reached = state["p"].isNull() & (total >= half)
            return F.struct(total.alias("sum"), F.when(reached, ballot["p"]).otherwise(state["p"]).alias("p"))

        last = F.element_at(ballots, -1)["p"]
        median = F.coalesce(F.aggregate(ballots, start, step)["p"], last)
        return df.withColumn("prediction", median).drop(*names)

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.getActiveSession()
        votes = [r["vote"] for r in spark.read.parquet(f"{path}/votes").orderBy("position").collect()]
        trees = [DecisionTreeRegressionModel.load(f"{path}/tree_{i}") for i in range(len(votes))]
        return cls(tuple(trees), tuple(votes))


class _Writer:
    def __init__(self, model: BoostedTrees):
        self.model = model

    def overwrite(self) -> _Writer:
        return self

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        for i, tree in enumerate(self.model.trees):
            tree.write().overwrite().save(f"{path}/tree_{i}")
        rows = [(i, v) for i, v in enumerate(self.model.votes)]
        spark.createDataFrame(rows, "position int, vote double").write.mode("overwrite").parquet(f"{path}/votes")


def fit(
    train: DataFrame,
    target: str,
    rounds: int = 50,
    max_depth: int = 3,
    key: str = "complaint_id",
    seed: int = 42,
    checkpoint_every: int = 5,
) -> BoostedTrees:
    """Boost ``rounds`` trees with linear loss.

    The weights of a round depend on all trees before it; the table is
    checkpointed every few rounds so that neither its plan nor the work to
    rebuild a lost partition keeps growing.
    """
    shared_folder(train.sparkSession)
    rows = train.select(key, "features", target).withColumn(_WEIGHT, F.lit(1.0))
    trees: list[DecisionTreeRegressionModel] = []
    votes: list[float] = []
    for i in range(rounds):
        tree = DecisionTreeRegressor(
            labelCol=target, weightCol=_WEIGHT, maxDepth=max_depth, seed=seed + i
        ).fit(rows)
        missed = tree.transform(rows).withColumn("_miss", F.abs(F.col("prediction") - F.col(target)))
        sums = missed.agg(
            F.max("_miss").alias("worst"),
            F.sum(F.col("_miss") * F.col(_WEIGHT)).alias("missed"),
            F.sum(_WEIGHT).alias("weight"),
        ).first()
        if sums["worst"] == 0:
            trees.append(tree)
            votes.append(1.0)
            break
        loss = sums["missed"] / sums["worst"] / sums["weight"]
        if loss >= 0.5:
            if not trees:
                trees.append(tree)
                votes.append(1.0)
            break
        beta = loss / (1 - loss)
        trees.append(tree)
        votes.append(math.log(1 / beta))
        factor = F.pow(F.lit(beta), 1 - F.col("_miss") / sums["worst"])
        rows = missed.withColumn(_WEIGHT, F.col(_WEIGHT) * factor).select(key, "features", target, _WEIGHT)
        if (i + 1) % checkpoint_every == 0 and i + 1 < rounds:
            rows = rows.checkpoint()
    return BoostedTrees(tuple(trees), tuple(votes))
