"""Numbers that may be missing, and sums that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Eighteen digits fit a machine word. Money keeps four decimals, scores six.
MONEY = "decimal(18,4)"
SCORE = "decimal(18,6)"


def known(value: Column) -> Column:
    """The value as a double, null where it is NaN."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def all_known(*values: Column) -> Column:
    """True where no value is null or NaN."""
    out = F.lit(True)
    for value in values:
        number = value.cast("double")
        out = out & number.isNotNull() & ~F.isnan(number)
    return out


def at_most(value: Column, bound: float) -> Column:
    """The smaller of the two; a missing value stays missing."""
    return F.when(value.isNotNull(), F.least(value, F.lit(bound)))


def between(value: Column, low: float, high: float) -> Column:
    """The value moved into the range; a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def exact_sum(value: Column, kind: str = MONEY) -> Column:
    """Sum of the values cut to the scale of ``kind``; name a finer one for finer numbers."""
    return F.sum(known(value).cast(kind)).cast("double")


def exact_mean(value: Column, kind: str = SCORE) -> Column:
    return exact_sum(value, kind) / F.count(known(value))
