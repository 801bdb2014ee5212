"""Windows by difference arrays against windows added up one by one."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cashtrail.operators import heatmap

DAY = dt.date(2024, 1, 1)


def test_windows_with_gaps_and_a_hot_cell(spark):
    draw = random.Random(4)
    rows = [(DAY + dt.timedelta(draw.randrange(90)), c, draw.randint(0, 9), draw.randint(1, 5)) for c in ("hot",) * 60 + ("a", "b", None)]
    rows += [(None, "a", 3, 3), (DAY, "zero", 0, 0)]
    daily = spark.createDataFrame(rows, "day date, cell string, x long, n long").groupBy("day", "cell").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    for length in (1, 7, 30):
        expected = {}
        for day, cell, x, n in rows:
            for i in range(length if day else 0):
                sums = expected.setdefault((day - dt.timedelta(i), cell), [0, 0])
                sums[0] += x
                sums[1] += n
        got = heatmap.rolling(daily, length, ("cell",), ("x", "n")).collect()
        assert {(r["window_start"], r["cell"]): [r["x"], r["n"]] for r in got} == expected
        assert len(got) == len(expected)


def test_two_changes_for_each_day_and_key(spark):
    daily = spark.createDataFrame([(DAY, "a", 1)], "day date, cell string, n long")
    plan = heatmap.rolling(daily, 3000, ("cell",), ("n",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("Window") < plan.index("Aggregate")
