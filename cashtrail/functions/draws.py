"""Repeatable stand-ins for random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest_number(key: Column, salt: str) -> Column:
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 7), 16, 10)


def draw(key: Column, salt: str) -> Column:
    """Uniform value in [0, 1) that depends only on the key and the salt."""
    return _digest_number(key, salt).cast("double") / float(2**28)


def bucket(key: Column, buckets: int, salt: str = "") -> Column:
    return (_digest_number(key, salt).cast("bigint") % buckets).cast("int")
