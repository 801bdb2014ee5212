"""Exact top-k search by inner product, MaxScore style.

The components of a vector are its terms, floor(scale * x) their weights. Queries
and candidates are dealt in blocks: every block of queries meets every shard of
candidates once. In a shard each term has its largest and least weight, so a query
knows how much a term can add at most. Terms are ordered by that bound. With the
k-th best score so far as the threshold, the terms of small bounds that together
cannot reach it are non-essential: only the others are traversed for all candidates,
and the rest is probed, largest bound first, for those still competitive. The best k
of each shard are merged. Sums are exact integers.

Vectors that are null or hold a null or a number that is not finite take no part; an
empty vector has no terms and scores 0 with everything. Vectors of different lengths
count as padded with zeros. A null id takes no part. Rows that repeat an id are
candidates of their own; a query that is repeated is asked once, with the row that
comes first by its weights, and never meets rows of its own id. Ties go to the smaller
id. Weights and scores beyond 64 bits are held at the largest or least long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD = 1024  # candidates
BLOCK = 512  # queries
STEP = 8  # terms probed at once
EXACT = 1 << 53  # sums below are exact as floating-point numbers
RESULT = "query_id long, vec_id long, score long"


def weighted(vectors: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """(vec_id, weights) of the vectors that take part."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weights = F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"), weights.alias("weights")
    )


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_of_shard(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query, vec_id, score) of the best k rows for each query."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    largest = [max(map(int, (m.max(initial=0), -int(m.min(initial=0))))) for m in (queries, rows)]
    kind = float if largest[0] * largest[1] * max(1, rows.shape[1]) < EXACT else object
    rows, queries = rows.astype(kind), queries.astype(kind)
    high, low = (rows.max(axis=0), rows.min(axis=0)) if rows.shape[1] else (rows[:0].sum(axis=0),) * 2
    columns = np.asfortranarray(rows)
    out = []
    for query_id, query in zip(query_ids.tolist(), queries):
        bound = np.maximum(query * high, query * low)  # the most that each term adds
        spread = bound - np.minimum(query * high, query * low)
        terms = np.argsort(-spread.astype(float), kind="stable")
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # of the terms from here on
        own = ids != query_id
        # threshold from the first rows, in full
        first = np.flatnonzero(own)[: 8 * k]
        scores = rows[first].dot(query)
        threshold = np.sort(scores)[-k] if len(first) >= k else None
        # Non-essential: the last terms that cannot lift a row without the others to the threshold.
        # A row's least part from the essential terms stands for "without".
        least = np.minimum(query * high, query * low)[terms]
        if threshold is None:
            essential = len(terms)
        else:
            reach = np.cumsum(least) + rest[1:]
            short = np.flatnonzero(reach < threshold)
            essential = min(len(terms), max(STEP, (int(short[0]) + 1) if len(short) else len(terms)))
        alive = np.flatnonzero(own)
        have = columns[:, terms[:essential]].dot(query[terms[:essential]])[alive]
        at = essential
        while True:
            if threshold is not None:
                keep = have + rest[at] >= threshold
                alive, have = alive[keep], have[keep]
            if at >= len(terms) or not len(alive):
                break
            # the most promising row settles a better threshold before the next probe
            if len(alive) > 4 * k:
                best = alive[np.argpartition(-have.astype(float), k)[: 2 * k]]
                found = np.sort(rows[best].dot(query))
                threshold = found[-k] if threshold is None else max(threshold, found[-k])
            some = terms[at : at + STEP]
            have = have + rows[np.ix_(alive, some)].dot(query[some])
            at += STEP
            at = min(at, len(terms))
        best = sorted(zip((-have).tolist(), ids[alive].tolist()))[:k]
        out += [(query_id, vec_id, _held(-score)) for score, vec_id in best]
    return out


def _held(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, shards: int | None = None, blocks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score); both tables are (vec_id, weights).

    The number of shards and blocks follows the numbers of rows.
    """
    shards = shards or max(1, -(-candidates.count() // SHARD))
    blocks = blocks or max(1, -(-queries.count() // BLOCK))
    asked = queries.groupBy("vec_id").agg(F.min("weights").alias("weights"))
    left = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # dealt by place and not by value, so that equal rows don't pile up
    right = candidates.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    def search(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            width = max(asked.weights.map(len).max(), rows.weights.map(len).max())
            found = top_of_shard(
                _matrix(asked.weights.tolist(), width), asked.vec_id.to_numpy(), _matrix(rows.weights.tolist(), width), rows.vec_id.to_numpy(), k
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    partial = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, RESULT)
    best = partial.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 1024)
    return top_k(rows.filter(F.col("vec_id") % 100 == 0), rows, 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
