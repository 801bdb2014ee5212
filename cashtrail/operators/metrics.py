"""Errors and scores of predictions, each from a single aggregate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtrail.functions import geo
from cashtrail.operators.ordered import kept, medians_of_counts


def geo_error(
    df: DataFrame,
    truth: tuple[str, str],
    guess: tuple[str, str],
    radii_km: tuple[float, ...] = (0.5, 1.0, 5.0),
    digits: int = 9,
) -> DataFrame:
    """Mean and exact median distance, and the share of points within each radius.

    Points without a distance don't count. Distances are rounded to ``digits`` for
    mean and median; the radius is held against the unrounded distance. All figures
    come from the counts of the distinct distances, so the points are read once.
    """
    distance = geo.haversine_km(*[F.col(c) for c in (*truth, *guess)])
    measured = df.select(F.lit("all").alias("scope"), distance.alias("_km")).where("_km IS NOT NULL")
    inside = {f"within_{f'{r:g}'.replace('.', '_')}_km_pct": r for r in radii_km}
    counted = measured.groupBy("scope", F.round("_km", digits).alias("km")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_km") <= r).alias(name) for name, r in inside.items()]
    )
    counted = kept(counted)
    total = F.sum("n")
    facts = counted.groupBy("scope").agg(
        (F.sum(F.col("km") * F.col("n")) / total).alias("mean_km"),
        *[(F.sum(name) / total * 100).alias(name) for name in inside],
    )
    # one row each
    return facts.join(F.broadcast(medians_of_counts(counted, "scope", "km")), "scope").drop("scope").withColumnRenamed(
        "median", "median_km"
    )


def r_squared(truth: str, guess: str) -> Column:
    error = F.sum(F.pow(F.col(truth) - F.col(guess), 2))
    spread = F.var_pop(truth) * F.count(truth)
    return F.when(spread > 0, 1 - error / spread).when(error == 0, 1.0).otherwise(0.0)


def regression_metrics(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """R2, MSE and MAE averaged over the targets; ``pairs`` maps truth to prediction."""
    n = len(pairs)

    def over_targets(metric) -> Column:
        total = F.lit(0.0)
        for truth, guess in pairs.items():
            total = total + metric(truth, guess)
        return total / n

    return df.agg(
        over_targets(r_squared).alias("r2"),
        over_targets(lambda y, p: F.avg(F.pow(F.col(y) - F.col(p), 2))).alias("mse"),
        over_targets(lambda y, p: F.avg(F.abs(F.col(y) - F.col(p)))).alias("mae"),
    )


def classification_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and F1 of the class 1; zero where undefined."""
    y, p = F.col(truth) == 1, F.col(guess) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        ratio(tp, tp + fp).alias("precision_score"),
        ratio(tp, tp + fn).alias("recall_score"),
    )
