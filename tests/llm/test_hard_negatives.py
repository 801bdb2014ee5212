"""Mined negatives against all inner products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashtrail.llm import hard_negatives as hn


def brute(rows, positives=5, k=10, low=30, high=90):
    fine = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, y, w in fine:
        if i % 100 == 0:
            key = (y, np.array(w, dtype=np.int64).tobytes())
            asked[i] = min(asked.get(i, (key, w)), (key, w))
    out = []
    for a, ((y, _), w) in asked.items():
        scored = [(-sum(p * q for p, q in zip(w, v)), i, z) for i, z, v in fine if i != a]
        best = sorted((s, i) for s, i, z in scored if z == y)[:positives]
        found = {}
        for s, p in best:
            found.setdefault(p, []).extend(sorted((t, i, s) for t, i, z in scored if z != y and low * -s <= 100 * -t <= high * -s))
        for p, negatives in found.items():
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, s) in enumerate(sorted(negatives)[:k])]
    return sorted(out)


def ask(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("planes", F.lit("clash")).withColumn("shard", F.lit(3))
    found = hn.mined(hn.participants(df, F.col("label"), 256), F.col("vec_id") % 100 == 0, **kw)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("width,spread,shard,block", [(16, 1.0, 300, 4), (3, 0.02, 100, 4096), (21, 40.0, 2048, 4096)])
def test_equal_to_all_products(spark, monkeypatch, width, spread, shard, block):
    monkeypatch.setattr(hn, "SHARD", shard)
    monkeypatch.setattr(hn, "BLOCK", block)
    draw = random.Random(width)
    rows = [(i, [draw.gauss(0.3, 1) * spread for _ in range(width)], draw.randrange(4)) for i in range(900)]
    assert ask(spark, rows) == brute(rows)
    assert ask(spark, rows, positives=2, k=3, low=10, high=60) == brute(rows, 2, 3, 10, 60)


def test_nulls_ties_repeats_and_other_lengths(spark):
    draw = random.Random(5)
    rows = [(0, [1.0, 2.0, 0.5], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [1.0], None), (None, [1.0], 1)]
    rows += [(500, [], 2), (600, [2.0] * 9, 2), (600, [2.0] * 9, 2), (700, [float("inf")], 1), (800, [-1.0, -1.0], 3)]
    rows += [(i, [1.0, 1.0], i % 3) for i in range(1, 40)] + [(i, [draw.choice([0.25, 0.5, 1.0]), 0.5], i % 3) for i in range(40, 90)]
    assert ask(spark, rows) == brute(rows)


def test_large_numbers_stay_exact(spark):
    draw = random.Random(6)
    rows = [(i, [draw.choice([1e6, -1e6, 4e6]) * draw.random() for _ in range(8)], i % 2) for i in range(220)]

    assert ask(spark, rows) == brute(rows)
    anchors = hn.Anchors(pa.table({"vec_id": [1], "label": [1], "numbers": [np.array([1 << 50], dtype=np.int64).tobytes()]}), 1)
    assert anchors.kind(40) is object and anchors.kind(9) is np.int64


def test_lookups_give_inner_products():
    draw = np.random.default_rng(7)
    rows, asked = draw.integers(-300, 300, (50, 24)), draw.integers(-150, 150, (6, 24))
    planes = np.stack([np.pad(p, ((10 - len(p), 0), (0, 0)), mode="edge") for p in map(hn.bit_planes, rows)])
    assert (hn.scores(hn.subset_sums(asked, np.int64), planes) == rows @ asked.T).all()


def test_no_rows(spark):
    assert ask(spark, []) == []
    assert ask(spark, [(1, [1.0], 0)]) == []
