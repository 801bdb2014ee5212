"""Repeatable train / test / fold assignment: a row's side depends on its id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtrail.contract import LIMITS
from cashtrail.functions import draws


def is_test(key: str = "complaint_id", share: float = LIMITS.test_share) -> Column:
    return draws.draw(F.col(key), "split") < share


def with_split(df: DataFrame, key: str = "complaint_id", share: float = LIMITS.test_share) -> DataFrame:
    return df.withColumn("split", F.when(is_test(key, share), "test").otherwise("train"))


def train_test(df: DataFrame, key: str = "complaint_id", share: float = LIMITS.test_share) -> tuple[DataFrame, DataFrame]:
    return df.where(~is_test(key, share)), df.where(is_test(key, share))


def fold(key: str = "complaint_id", folds: int = 3) -> Column:
    return draws.bucket(F.col(key), folds, "fold")
