"""Running totals and exact medians without sorting a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashtrail.session import shared_folder

RANGE_ROWS = 50_000  # distinct values that one task sorts
CELLS = 1024  # parts of an interval in one pass of a selection
FEW_ROWS = 10_000  # distinct values that end a selection


def kept(grouped: DataFrame) -> DataFrame:
    """Counted values in the shared folder, so that they are not counted again."""
    shared_folder(grouped.sparkSession)
    return grouped.checkpoint()


def running_totals(
    grouped: DataFrame, key: str, value: str, measures: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Add ``<measure>_upto``, summed over all smaller or equal values, and ``<measure>_total``.

    ``grouped`` has one row per (key, value) and is kept already. A prefix sum in three
    steps: rows are dealt to tasks by ranges of (key, value), about ``RANGE_ROWS`` each, and
    written with the number of their range; every range is summed; the sums of the ranges
    before it are joined back and added to the running total inside. The driver sees no
    cut point, and a range is as long as its share of the rows, whatever the key.
    """
    if ranges is None:
        ranges = max(1, math.ceil(grouped.count() / RANGE_ROWS))
    ranged = kept(grouped.repartitionByRange(ranges, key, value).withColumn("_range", F.spark_partition_id()))

    everything = Window.partitionBy(key)
    earlier = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = sums.select(
        key,
        "_range",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(m).over(everything).alias(f"{m}_total") for m in measures],
    )
    inside = Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"_{m}_here": F.sum(m).over(inside) for m in measures})
    joined = local.join(offsets, [key, "_range"])
    return joined.select(
        *grouped.columns,
        *[(F.col(f"_{m}_here") + F.col(f"_{m}_before")).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def exact_medians(df: DataFrame, key: str, value: str, few: int = FEW_ROWS, cells: int = CELLS) -> DataFrame:
    """Median of ``value`` per key; values that are missing or no number don't count."""
    numbers = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = numbers.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return medians_of_counts(kept(counted), key, value, few, cells)


def medians_of_counts(counted: DataFrame, key: str, value: str, few: int = FEW_ROWS, cells: int = CELLS) -> DataFrame:
    """Median per key, the mean of the two middle values, from kept rows (key, value, n).

    Selection by successive histograms. An open interval per key and rank starts as the
    whole range of values; each pass counts the rows in its equal parts and keeps the part
    that holds the rank, until the parts hold ``few`` different values together or can't
    be halved; only these are sorted. The intervals are a table as long as the keys.
    """
    value_of = F.col(value).cast("double")
    ends = counted.groupBy(key).agg(F.min(value_of).alias("low"), F.max(value_of).alias("high"), F.sum("n").alias("total"))
    ranks = F.array(F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2))
    # rank: how many rows from the least value of the interval on
    wanted = kept(ends.select(key, F.posexplode(ranks).alias("which", "rank"), "low", "high"))
    while True:
        inside = counted.join(F.broadcast(wanted) if wanted.count() <= 100_000 else wanted, key).where(
            (value_of >= F.col("low")) & (value_of <= F.col("high"))
        )
        middle = F.col("low") + (F.col("high") - F.col("low")) / 2
        size = inside.groupBy(key, "which").agg(
            F.count(F.lit(1)).alias("values"), F.first((middle > F.col("low")) & (middle < F.col("high"))).alias("splits")
        )
        if size.where((F.col("values") > few) & F.col("splits")).isEmpty():
            break
        share = (value_of - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(5e-324))
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        counts = inside.withColumn("cell", cell).groupBy(key, "which", "rank", "cell").agg(
            F.sum("n").alias("n"), F.min(value_of).alias("low"), F.max(value_of).alias("high")
        )
        before = Window.partitionBy(key, "which").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        holds = (F.col("_before") < F.col("rank")) & (F.col("_before") + F.col("n") >= F.col("rank"))
        wanted = kept(counts.where(holds).select(key, "which", (F.col("rank") - F.col("_before")).alias("rank"), "low", "high"))
    upto = Window.partitionBy(key, "which").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    chosen = inside.withColumn("_upto", F.sum("n").over(upto))
    at_rank = (F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("n") < F.col("rank"))
    return chosen.where(at_rank).groupBy(key).agg((F.sum(value) / 2).alias("median"))
