"""Hard negatives for labelled vectors, scored by the method of Four Russians.

Components become whole numbers, floor(scale * x). A candidate is kept as packed
bit-planes: for each bit of its components in two's complement, from the sign down, one
byte for every eight dimensions. An anchor gets, for every eight dimensions, a table with
the sums of all 256 subsets of its eight numbers. A byte of a candidate is an index into
that table; the sums of one plane are added, the total is doubled for the next plane and
the sign plane counts negatively. After the last plane it is the full inner product,
exact: in 32 or 64 bits where a bound on the sums allows it, in Python's whole numbers
otherwise.

A first round scores anchors against candidates of their own label and keeps the best
``positives``. A second round scores them against all other labels and keeps, for each
positive, the best ``k`` whose score lies between ``low`` and ``high`` percent of the
positive's. Every block of anchors meets every shard of candidates once a round; a shard
is some 2,000 rows of packed bytes and a block up to 4,096 anchors, and the best of the
shards are merged. Candidates are dealt by place, so equal rows or labels don't pile up.

Rows take no part if id, label or vector is null or if a component is null or not finite.
An empty vector scores 0 with everything; shorter vectors count as padded with zeros.
Numbers and scores beyond 64 bits are held at the largest or least long. Rows that repeat
an id are candidates of their own; a repeated anchor is asked once, with the row that
comes first by label and its numbers' bytes, and never meets rows of its own id. Ties go to the
smaller id. An anchor without positives, or a positive without a row in its range, gives
no rows. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm.common import stored, tidy

SHARD = 2048  # candidates
BLOCK = 4096  # anchors
AT_ONCE = 256  # anchors whose tables are held together
_PACKED = "vec_id long, label long, groups int, planes binary, numbers binary"
_PAIRS = "anchor_id long, vec_id long, score long"
_RANGES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
_LONG = (-(1 << 63), (1 << 63) - 1)


def participants(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, numbers) of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", "label", numbers.alias("numbers")
    )


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """Planes x groups bytes of one vector, sign plane first; few planes for small numbers."""
    bits = max([int(x).bit_length() if x >= 0 else int(~x).bit_length() for x in (numbers.max(initial=0), numbers.min(initial=0))]) + 1
    padded = np.zeros(-(-len(numbers) // 8) * 8, dtype=np.int64)
    padded[: len(numbers)] = numbers
    shifts = np.arange(bits - 1, -1, -1, dtype=np.int64)[:, None]
    return np.packbits(((padded[None, :] >> shifts) & 1).astype(np.uint8), axis=1, bitorder="little")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = [np.array(n, dtype=np.int64) for n in batch.column(2).to_pylist()]
        planes = [bit_planes(n) for n in numbers]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([p.shape[1] for p in planes], pa.int32()),
                pa.array([p.tobytes() for p in planes], pa.binary()),
                pa.array([n.tobytes() for n in numbers], pa.binary()),
            ],
            ["vec_id", "label", "groups", "planes", "numbers"],
        )


def subset_sums(numbers: np.ndarray, kind: type) -> np.ndarray:
    """Groups x 256 x anchors: sums of all subsets of every eight numbers of the anchors."""
    anchors, width = numbers.shape
    out = np.zeros((width // 8, 256, anchors), dtype=kind)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + numbers.T[bit::8][:, None, :].astype(kind)
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Candidates x anchors: inner products by shifted sums of looked-up subset sums."""
    total = None
    for plane in range(planes.shape[1]):
        row = tables[0][planes[:, plane, 0]]
        for group in range(1, len(tables)):
            row = row + tables[group][planes[:, plane, group]]
        total = -row if total is None else total + total + row
    return total


class Shard:
    """Candidates ordered by id, with planes of one shape."""

    def __init__(self, table: pa.Table, groups: int):
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        self.ids, self.labels = table.column("vec_id").to_numpy()[order], table.column("label").to_numpy()[order]
        widths, found = table.column("groups").to_pylist(), table.column("planes").to_pylist()
        own = [np.frombuffer(p, dtype=np.uint8).reshape(-1, w) if w else np.zeros((1, 0), np.uint8) for p, w in zip(found, widths)]
        self.bits = max((len(p) for p in own), default=1)
        self.planes = np.zeros((len(own), self.bits, groups), dtype=np.uint8)
        for i, j in enumerate(order):
            p = own[j]
            self.planes[i, self.bits - len(p) :, : p.shape[1]] = p
            self.planes[i, : self.bits - len(p), : p.shape[1]] = p[0]  # the sign goes on


class Anchors:
    def __init__(self, table: pa.Table, groups: int):
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.numbers = np.zeros((len(self.ids), groups * 8), dtype=np.int64)
        for i, packed in enumerate(table.column("numbers").to_pylist()):
            own = np.frombuffer(packed, dtype=np.int64)
            self.numbers[i, : len(own)] = own

    def kind(self, bits: int) -> type:
        """The narrowest whole numbers that hold every sum on the way."""
        largest = sum(max(abs(int(c.max())), abs(int(c.min()))) for c in self.numbers.T) if len(self.ids) else 0
        return next((k for k, room in ((np.int32, 31), (np.int64, 63)) if (largest << bits) < 1 << room), object)


def _held(score) -> int:
    return max(_LONG[0], min(_LONG[1], int(score)))


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties to the earlier place, in order."""
    if len(values) > 4 * k and values.dtype != object:
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = np.flatnonzero(values > least)
        ties = np.flatnonzero(values == least)[: k - len(above)]
        places = np.concatenate([above, ties])
    else:
        places = np.arange(len(values))
    keyed = sorted(places.tolist(), key=lambda i: (-int(values[i]), i))
    return np.array(keyed[:k], dtype=np.int64)


def _meet(rows: pa.Table, asked: pa.Table) -> tuple[Shard, Anchors, type]:
    groups = max([1, *rows.column("groups").to_pylist(), *asked.column("groups").to_pylist()])
    shard, anchors = Shard(rows, groups), Anchors(asked, groups)
    return shard, anchors, anchors.kind(shard.bits)


def _same_label(positives: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(asked):
            shard, anchors, kind = _meet(rows, asked)
            for label in np.unique(anchors.labels):
                mine, places = np.flatnonzero(shard.labels == label), np.flatnonzero(anchors.labels == label)
                for some in np.split(places, range(AT_ONCE, len(places), AT_ONCE)) if len(mine) else ():
                    products = scores(subset_sums(anchors.numbers[some], kind), shard.planes[mine])
                    for at, column in zip(some, products.T):
                        others = np.flatnonzero(shard.ids[mine] != anchors.ids[at])
                        for i in others[_best(column[others], positives)]:
                            found.append((int(anchors.ids[at]), int(shard.ids[mine[i]]), _held(column[i])))
        return _rows(found, ("anchor_id", "vec_id", "score"))

    return work


def _other_labels(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(asked):
            shard, anchors, kind = _meet(rows, asked)
            ranges = asked.column("ranges").to_pylist()
            for some in np.split(np.arange(len(anchors.ids)), range(AT_ONCE, len(anchors.ids), AT_ONCE)):
                products = scores(subset_sums(anchors.numbers[some], kind), shard.planes)
                for at, column in zip(some, products.T):
                    others = np.flatnonzero(shard.labels != anchors.labels[at])
                    order = others[np.argsort(-column[others], kind="stable")]  # ids ascend, so ties are in order
                    falling = -column[order]
                    for one in ranges[at]:
                        top, least = high * one["score"] // 100, -(-low * one["score"] // 100)
                        first, past = np.searchsorted(falling, -top, side="left"), np.searchsorted(falling, -least, side="right")
                        for i in order[first : min(past, first + k)]:
                            found.append((int(anchors.ids[at]), one["vec_id"], one["score"], int(shard.ids[i]), _held(column[i])))
        return _rows(found, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return work


def _rows(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*found)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _dealt(anchors: DataFrame, candidates: DataFrame, shards: int, blocks: int):
    """Both sides by (shard, block): each block of anchors meets each shard."""
    left = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, numbers)."""
    packed = stored(rows.mapInArrow(tidy(_packed), _PACKED), "packed")
    shards = max(1, math.ceil(packed.count() / SHARD))
    first = "row_number() OVER (PARTITION BY vec_id ORDER BY label, numbers) AS first"
    asked = packed.filter(is_anchor).selectExpr("*", first).filter("first = 1").drop("first", "planes")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    # by place and not by value, so that equal rows don't pile up
    place = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")
    candidates = packed.select("vec_id", "label", "groups", "planes", place.alias("shard"))

    same = _dealt(asked, candidates, shards, blocks).applyInArrow(_same_label(positives), _PAIRS)
    best = same.selectExpr("*", "row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS rank").filter(F.col("rank") <= positives)
    ranges = best.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("ranges"))
    ready = stored(asked.join(ranges.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "asked")

    others = _dealt(ready, candidates, shards, blocks).applyInArrow(_other_labels(k, low, high), _RANGES)
    order = "row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS rank"
    out = others.selectExpr("*", order).filter(F.col("rank") <= k)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = participants(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, 256)
    return mined(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, label, unnest(w) AS w, unnest(range(len(w))) AS i FROM v),
s AS (
  SELECT q.vec_id AS anchor_id, q.label, c.vec_id, c.label AS other, sum(q.w * c.w)::BIGINT AS score
  FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
p AS (
  SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE label = other),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.other AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.place <= 5)
SELECT * FROM n WHERE rank <= 10
"""
