"""Exact search against all inner products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cashtrail.llm import maxscore


def brute(rows, k):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    asked = {}
    for i, v in ints:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, w in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ints if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def ask(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df = maxscore.weighted(df.withColumn("weights", F.lit("clash")), "vec_id", "embedding", 1024)
    found = maxscore.top_k(df.filter("vec_id % 100 = 0"), df, k, **kw).collect()
    assert len(found) == len({(r["query_id"], r["rank"]) for r in found})
    return {tuple(r) for r in found}


@pytest.mark.parametrize("seed,width,spread", [(1, 16, 1.0), (2, 3, 0.01), (3, 40, 50.0)])
def test_equal_to_all_products(spark, seed, width, spread):
    draw = random.Random(seed)
    scale = [spread ** draw.random() for _ in range(width)]
    rows = [(i, [draw.gauss(0.2, 1) * s for s in scale]) for i in range(1500)]
    assert ask(spark, rows) == brute(rows, 10)
    assert ask(spark, rows, k=3, shards=4, blocks=3) == brute(rows, 3)


def test_ties_nulls_and_other_lengths(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, [float("inf")]), (None, [1.0, 1.0])]
    rows += [(600, []), (700, [1.0]), (700, [1.0]), (701, [-1.0, 5.0, 9.0])] + [(i, [1.0, 1.0]) for i in range(1, 30)]
    assert ask(spark, rows, k=5) == {r for r in brute(rows, 5)}


def test_large_weights_stay_exact(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([1e6, -1e6, 3.3e5]) * draw.random() for _ in range(8)]) for i in range(150)]
    assert ask(spark, rows, k=4) == brute(rows, 4)


def test_no_rows(spark):
    assert ask(spark, [(1, [1.0])]) == set()
