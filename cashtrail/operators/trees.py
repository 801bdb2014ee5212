"""Regression trees of many models at once, level by level, over one stored frame.

The frame holds each row's fold, its binned features, its targets and its draws for
bagging; it is written once. All trees of all folds, targets and settings that can grow
side by side share a pass: every task adds up, for each open node, weight and weighted
target by feature and bin; the sums of the tasks meet by node and the best cut of each
node is chosen where they meet. The driver sees one cut per node, which is the model.
Forests with more open nodes than ``CELLS`` allow take several passes per level. Where no
more than ``FEW`` different rows of bins occur, one pass adds up weight and target for
each of them, and all levels are cut from these sums: the same trees in fewer passes.
There, boosting needs no row after the first pass: what a round leaves behind is one
margin for each row of bins. Rounds on weights read the different targets, with the number of
their rows, packed by fold and row of bins, in order of size: a row's weight is the exponential of a broken line over its
target, so no weight is stored (``Packed``).

What a round of boosting leaves behind (a row's margin, or its weight) is a column of
the frame otherwise. It is written to the shared folder every ``SEGMENT`` rounds, so each round
reads the same small state and recomputes a few trees at most, and a lost task never
goes back further than the last written table.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.session import new_folder

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64
CELLS = 1 << 22  # weight and target sums that a task holds
SEGMENT = 10  # rounds between two written states
FEW = 4096  # different rows of bins
DENSE = 256  # rows of bins whose targets are packed
SORTED, PACK = 1 << 18, 1 << 13  # rows that a task sorts at once, targets that travel together
NODES = 256  # nodes whose sums travel together
NO_GAIN = 1e-12
POISSON = tuple(math.fsum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(9))
_FRAME = "fold int, bins binary, y array<double>, drawn binary, state binary"


def shelved(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- the frame


@dataclass(frozen=True)
class Frame:
    """The stored rows, the limits of each feature's bins, and the rows of bins that occur, if few."""

    data: DataFrame
    limits: list[list[float]]
    few: np.ndarray | None = None


def thresholds(rows: DataFrame, width: int, most: int = BINS) -> list[list[float]]:
    """For each feature the numbers that part its bins: midpoints of few values, else quantiles."""
    at = [F.col("x")[i] for i in range(width)]
    few = rows.agg(*[F.approx_count_distinct(c, 0.02) for c in at]).first()
    small = [i for i in range(width) if few[i] <= most]
    # sets only of features that have few values
    sets = rows.agg(*[F.collect_set(at[i]) for i in small]).first() if small else ()
    shares = [i / most for i in range(1, most)]
    wide = [i for i in range(width) if i not in small]
    cuts = rows.agg(*[F.percentile_approx(at[i], shares, 10000) for i in wide]).first() if wide else ()
    out: list[list[float]] = [[] for _ in range(width)]
    for i, values in zip(small, sets):
        ordered = sorted(values)
        out[i] = [(a + b) / 2 for a, b in zip(ordered, ordered[1:])][:254]
    for i, values in zip(wide, cuts):
        out[i] = sorted(set(values))[:254]
    return out


def bag_digits(key: Column, members: int) -> Column:
    """Seven hexadecimal digits for each member, from md5 sums of the key."""
    sums = [F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"bag{j}"))), 1, 28) for j in range(-(-members // 4))]
    return F.concat(*sums) if sums else F.lit("")


def _rows_of(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """Texts or bytes of equal length as rows of an array, without a Python object for each."""
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else column.type).cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    if ends[0] == ends[-1]:
        return np.zeros((len(column), 0), dtype=kind)
    raw = bytes(memoryview(data)[ends[0] : ends[-1]])
    return np.frombuffer(raw, dtype=kind).reshape(len(column), -1)


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """Rows of an array as bytes."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


_DIGIT = np.zeros(256, dtype=np.uint16)
_DIGIT[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = np.arange(16)
_UNSURE = 255


def _by_four_digits() -> np.ndarray:
    """What the first four digits tell of a draw."""
    first = np.searchsorted(np.array(POISSON), np.arange(1 << 16) / 2.0**16, side="right")
    last = np.searchsorted(np.array(POISSON), (np.arange(1, (1 << 16) + 1) * 4096 - 1) / 2.0**28, side="right")
    return np.where(first == last, first, _UNSURE).astype(np.uint8)


def _drawn(digits: np.ndarray, members: int) -> np.ndarray:
    """How often each member draws each row: Poisson with mean one. Four of the seven digits tell most of them."""
    if not members or not len(digits):
        return np.zeros((len(digits), members), dtype=np.uint8)
    raw = digits.reshape(len(digits), -1, 7)[:, :members]
    known = np.zeros(raw.shape[:2], dtype=np.uint16)
    for j in range(4):
        known = known << 4 | _DIGIT[raw[:, :, j]]
    out = _by_four_digits()[known]
    row, member = np.nonzero(out == _UNSURE)
    numbers = _DIGIT[raw[row, member]].astype(np.int64) @ (16 ** np.arange(6, -1, -1))
    out[row, member] = np.searchsorted(np.array(POISSON), numbers / 2.0**28, side="right")
    return out


def frame(rows: DataFrame, fold: Column, key: str, targets: Sequence[str], members: int = 0, most: int = BINS) -> Frame:
    """The stored frame of rows with a ``features`` vector.

    ``fold`` is -1 for rows that no model learns from. Limits come from all other rows.
    Rows without a fold, a feature vector or a target don't belong here and raise.
    """
    wanted = rows.select(
        fold.cast("int").alias("fold"),
        vector_to_array("features").alias("x"),
        F.array(*[F.col(t).cast("double") for t in targets]).alias("y"),
        bag_digits(F.col(key), members).alias("digits"),
    )
    first = wanted.select(F.size("x").alias("width")).first()
    width = first["width"] if first else 0
    limits = thresholds(wanted.where("fold >= 0"), width, most) if first else []

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            if np.isnan(x).any() or batch.column(0).null_count or batch.column(2).flatten().null_count:
                raise ValueError("fold, features and targets must be there")
            bins = np.stack([np.searchsorted(limits[i], x[:, i], side="left") for i in range(width)], axis=1).astype(np.uint8)
            drawn = _drawn(_rows_of(batch.column(3)), members)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _bytes_of(bins), batch.column(2), _bytes_of(drawn), _bytes_of(np.zeros((n, 0), dtype=np.uint8))],
                ["fold", "bins", "y", "drawn", "state"],
            )

    data = shelved(wanted.mapInArrow(binned, _FRAME), "frame")
    found = data.select("bins").distinct().limit(FEW + 1).collect()
    few = np.sort(np.array([bytes(r["bins"]) for r in found], dtype=f"S{max(1, width)}"))
    return Frame(data, limits, few if 0 < len(few) <= FEW else None)


def _without_draws(data: DataFrame) -> DataFrame:
    """A frame's rows for a pass that needs no draws, which are most of its bytes."""
    return data.withColumn("drawn", F.lit(bytearray()))


@dataclass
class Batch:
    """Some rows of a frame as arrays."""

    fold: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    drawn: np.ndarray
    state: np.ndarray
    at: np.ndarray | None = None

    def places(self, few: np.ndarray) -> np.ndarray:
        """Where each row's bins stand among the few that occur."""
        if self.at is None:
            self.at = np.searchsorted(few, np.ascontiguousarray(self.bins).view(few.dtype).ravel())
        return self.at

    def answers(self, tree: Tree, few: np.ndarray | None) -> np.ndarray:
        if few is None:
            return tree.predict(self.bins)
        return tree.predict(few.view(np.uint8).reshape(len(few), -1))[self.places(few)]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Batch:
        y = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        bins, drawn, state = _rows_of(batch.column(1)), _rows_of(batch.column(3)), _rows_of(batch.column(4), np.float64)
        return cls(batch.column(0).to_numpy(zero_copy_only=False), bins, y, drawn, state)


# ---- trees


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. Every node has a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node each row ends in, after ``depth`` steps at most."""
        feature, cut, left, right = map(np.asarray, (self.feature, self.cut, self.left, self.right))
        at, rows, steps = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins)), 0
        while depth is None or steps < depth:
            f = feature[at]
            if (f < 0).all():
                break
            lower = bins[rows, np.maximum(f, 0)] <= cut[at]
            at = np.where(f < 0, at, np.where(lower, left[at], right[at]))
            steps += 1
        return at

    def predict(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        return np.asarray(self.value)[self.nodes(bins, depth)]


Sampler = Callable[[Batch], Callable[[int], tuple[np.ndarray, np.ndarray]]]


def _cuts(sums: np.ndarray) -> list[tuple]:
    """For each node: feature or -1, cut, its value, and the values of its children."""
    weight, target = sums[..., 0], sums[..., 1]
    whole_w, whole_t = weight[:, 0].sum(axis=1), target[:, 0].sum(axis=1)
    low_w, low_t = np.cumsum(weight, axis=2), np.cumsum(target, axis=2)
    high_w, high_t = whole_w[:, None, None] - low_w, whole_t[:, None, None] - low_t
    empty = 1e-12 * whole_w[:, None, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = whole_t**2 / whole_w
        gain = np.where((low_w > empty) & (high_w > empty), low_t**2 / low_w + high_t**2 / high_w - rest[:, None, None], -np.inf)
        flat = gain.reshape(len(gain), -1)
        best = flat.argmax(axis=1)
        f, b = np.divmod(best, sums.shape[2])
        i = np.arange(len(gain))
        value = np.where(whole_w > 0, whole_t / whole_w, 0.0)
        split = flat[i, best] > NO_GAIN * np.maximum(1.0, rest)
        low, high = low_t[i, f, b] / low_w[i, f, b], high_t[i, f, b] / high_w[i, f, b]
    return [(int(f[k]) if split[k] else -1, int(b[k]), float(value[k]), float(low[k]), float(high[k])) for k in i]


_SUMS = "block int, part int, sums binary"
_CHOSEN = "node int, feature int, cut int, value double, low double, high double"


def _cut_rows(first: int, sums: np.ndarray) -> pa.RecordBatch:
    rows = [(first + k, *cut) for k, cut in enumerate(_cuts(sums))]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 3 + [pa.float64()] * 3)]
    return pa.RecordBatch.from_arrays(columns, ["node", "feature", "cut", "value", "low", "high"])


def _best_cuts(
    data: DataFrame, sampler: Sampler, trees: list[Tree], open_nodes: list[tuple[int, int]], width: int, bins: int, alone: bool
) -> dict[int, tuple]:
    """The best cut of each open node, a pair of tree and node; one pass over the frame.

    ``alone`` says that the frame is one partition, whose sums need not meet others.
    """
    place: dict[int, list[tuple[int, int]]] = {}
    for k, (t, node) in enumerate(open_nodes):
        place.setdefault(t, []).append((node, k))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((len(open_nodes) * width * bins, 2))
        columns = np.arange(width) * bins
        for raw in batches:
            batch = Batch.of(raw)
            sample = sampler(batch)
            for t, nodes in place.items():
                weight, target = sample(t)
                slot = np.full(len(trees[t].feature), -1, dtype=np.int64)
                slot[[n for n, _ in nodes]] = [k for _, k in nodes]
                at = slot[trees[t].nodes(batch.bins)]
                some = np.flatnonzero((at >= 0) & (weight > 0))
                cells = (at[some, None] * (width * bins) + columns + batch.bins[some]).ravel()
                low = cells.min(initial=0)
                for j, values in enumerate((weight, weight * target)):
                    found = np.bincount(cells - low, weights=np.repeat(values[some], width))
                    sums[low : low + len(found), j] += found
        if alone:
            yield _cut_rows(0, sums.reshape(-1, width, bins, 2))
            return
        part, blocks = TaskContext.get().partitionId(), sums.reshape(len(open_nodes), -1)
        found = [(b, part, blocks[b * NODES : (b + 1) * NODES].tobytes()) for b in range(-(-len(open_nodes) // NODES))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary()))], ["block", "part", "sums"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for raw in batches:
            for block, part, sums in zip(*[raw.column(i).to_pylist() for i in range(3)]):
                parts.setdefault(block, []).append((part, sums))
        for block, found in parts.items():
            # in the order of the parts, so that the sums don't depend on arrival
            whole = sum(np.frombuffer(s, dtype=np.float64).reshape(-1, width, bins, 2) for _, s in sorted(found))
            yield _cut_rows(block * NODES, whole)

    if alone:
        cuts = data.mapInArrow(summed, _CHOSEN)
    else:
        sums = data.mapInArrow(summed, _SUMS)
        cuts = sums.repartition(-(-len(open_nodes) // NODES), "block").mapInArrow(chosen, _CHOSEN)
    return {r["node"]: tuple(r)[1:] for r in cuts.collect()}


def _added(data: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray], count: int, width: int) -> np.ndarray:
    """Sum of the count x width tables that ``fill`` makes of each task's batches."""
    kind = "part int, tree int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, part = fill(batches), [TaskContext.get().partitionId()] * count
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(range(count), pa.int32()), pa.array([t.tobytes() for t in sums], pa.binary())], ["part", "tree", "sums"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, bytes]]] = {}
        for raw in batches:
            for part, tree, sums in zip(*[raw.column(i).to_pylist() for i in range(3)]):
                parts.setdefault(tree, []).append((part, sums))
        for tree, found in parts.items():
            # in the order of the parts, so that the sums don't depend on arrival
            whole = sum(np.frombuffer(x, dtype=np.float64) for _, x in sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([tree], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["part", "tree", "sums"])

    rows = data.mapInArrow(run, kind)
    if data.rdd.getNumPartitions() > 1:
        rows = rows.repartition(min(count, 32), "tree").mapInArrow(met, kind)
    out = np.zeros((count, width))
    for r in rows.toLocalIterator() if count * width > 2 * CELLS else rows.collect():
        out[r["tree"]] = np.frombuffer(r["sums"], dtype=np.float64)
    return out


@dataclass(frozen=True)
class Totals:
    """Sums by fold and row of bins: rows, and of each target, less ``middle``, the values and their squares."""

    folds: list[int]
    middle: np.ndarray  # target
    n: np.ndarray  # fold x row of bins
    y: np.ndarray  # fold x row of bins x target
    yy: np.ndarray

    def learnt(self, held_out: int) -> np.ndarray:
        """The folds that a model learns from."""
        return np.array([f >= 0 and f != held_out for f in self.folds], dtype=bool)


def _by_fold(batch: Batch, few: np.ndarray, folds: list[int]) -> np.ndarray:
    return np.searchsorted(folds, batch.fold) * len(few) + batch.places(few)


def totals(frame: Frame) -> Totals:
    """One pass over a frame of few rows of bins."""
    few, y = frame.few, F.col("y")
    width = len(frame.data.select("y").first()["y"])
    ends = [end(y[t]) for t in range(width) for end in (F.min, F.max)]
    first = frame.data.agg(F.sort_array(F.collect_set("fold")), *ends).first()
    folds, middle = first[0], np.array(first[1:], dtype=float).reshape(width, 2).mean(axis=1)

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((1 + 2 * width, len(folds) * len(few)))
        for raw in batches:
            batch = Batch.of(raw)
            at, z = _by_fold(batch, few, folds), batch.y - middle
            for row, values in zip(sums, [np.ones(len(at)), *z.T, *(z * z).T]):
                row += np.bincount(at, weights=values, minlength=len(row))
        return sums

    sums = _added(_without_draws(frame.data), fill, 1 + 2 * width, len(folds) * len(few)).reshape(1 + 2 * width, len(folds), len(few))
    return Totals(folds, middle, sums[0], np.moveaxis(sums[1 : 1 + width], 0, 2), np.moveaxis(sums[1 + width :], 0, 2))


def _shapes(few: np.ndarray) -> np.ndarray:
    return few.view(np.uint8).reshape(len(few), -1)


def _size(frame: Frame) -> tuple[int, int]:
    return len(frame.limits), max([len(c) for c in frame.limits], default=0) + 1


def grow(frame: Frame, sampler: Sampler, count: int, depth: int) -> list[Tree]:
    """``count`` trees; ``sampler`` gives weights and targets of a batch for a tree's number."""
    if frame.few is not None:
        few = frame.few

        def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            sums = np.zeros((count, 2, len(few)))
            for raw in batches:
                batch = Batch.of(raw)
                at = batch.places(few)
                sample = sampler(batch)
                for t in range(count):
                    weight, target = sample(t)
                    for j, values in enumerate((weight, weight * target)):
                        sums[t, j] += np.bincount(at, weights=values, minlength=len(few))
            return sums

        return grown(frame, _added(frame.data, fill, count, 2 * len(few)).reshape(count, 2, -1).transpose(0, 2, 1), depth)
    trees, alone = [Tree() for _ in range(count)], frame.data.rdd.getNumPartitions() == 1
    return _levels(frame, trees, depth, lambda some: _best_cuts(frame.data, sampler, trees, some, *_size(frame), alone))


def grown(frame: Frame, sums: np.ndarray, depth: int) -> list[Tree]:
    """Trees from their sums: trees x rows of bins x (weight, weighted target)."""
    trees, shapes = [Tree() for _ in sums], _shapes(frame.few)
    width, bins = _size(frame)

    def cuts(some: list[tuple[int, int]]) -> dict[int, tuple]:
        met = np.zeros((len(some), width, bins, 2))
        for k, (t, node) in enumerate(some):
            here = trees[t].nodes(shapes) == node
            for f in range(width):
                np.add.at(met[k, f], shapes[here, f], sums[t][here])
        return dict(enumerate(_cuts(met)))

    return _levels(frame, trees, depth, cuts)


def _levels(frame: Frame, trees: list[Tree], depth: int, cuts: Callable[[list[tuple[int, int]]], dict[int, tuple]]) -> list[Tree]:
    width, bins = _size(frame)
    at_once = max(1, CELLS // (width * bins))
    open_nodes = [(t, 0) for t in range(len(trees))]
    for level in range(max(1, depth)):
        following = []
        for start in range(0, len(open_nodes), at_once):
            some = open_nodes[start : start + at_once]
            for k, (feature, cut, value, low, high) in cuts(some).items():
                t, node = some[k]
                tree = trees[t]
                if level == 0:
                    tree.value[node] = value
                if feature < 0 or depth == 0:
                    continue
                tree.feature[node], tree.cut[node] = feature, cut
                tree.left[node], tree.right[node] = len(tree.value), len(tree.value) + 1
                for child in (low, high):
                    for column, new in ((tree.feature, -1), (tree.cut, 0), (tree.left, 0), (tree.right, 0), (tree.value, child)):
                        column.append(new)
                following += [(t, tree.left[node]), (t, tree.right[node])]
        open_nodes = following
        if not open_nodes:
            break
    return trees


# ---- ensembles


@dataclass
class Ensemble:
    """Trees and how their answers become one: mean, sum from ``base``, or weighted median."""

    kind: str
    trees: list[Tree]
    votes: list[float]
    base: float
    limits: list[list[float]]
    depth: int | None = None

    def part(self, members: int, depth: int | None = None) -> Ensemble:
        """The model that fewer rounds or a smaller depth would have given."""
        return Ensemble(self.kind, self.trees[:members], self.votes[:members], self.base, self.limits, depth)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        if self.kind == "median":
            return weighted_median(np.stack([t.predict(bins, self.depth) for t in self.trees], axis=1), np.asarray(self.votes))
        total = np.zeros(len(bins))
        for tree, vote in zip(self.trees, self.votes):
            total += vote * tree.predict(bins, self.depth)
        return self.base + total if self.kind == "sum" else total / sum(self.votes)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` for rows with a ``features`` vector."""
        model = self

        @F.arrow_udf("double")
        def predicted(features: pa.Array) -> pa.Array:
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), len(model.limits))
            bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(model.limits)], axis=1).astype(np.uint8)
            few, place = np.unique(bins.view(f"S{bins.shape[1]}"), return_inverse=True)  # each row of bins is answered once
            return pa.array(model.predict(_shapes(few))[place.ravel()])

        return df.withColumn("prediction", predicted(vector_to_array("features")))

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def load(cls, path: str) -> Ensemble:
        spark = SparkSession.getActiveSession()
        head = spark.read.parquet(f"{path}/model").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect()
        trees = [Tree([], [], [], [], []) for _ in head["votes"]]
        for r in nodes:
            tree = trees[r["tree"]]
            for column, value in zip((tree.feature, tree.cut, tree.left, tree.right, tree.value), tuple(r)[2:]):
                column.append(value)
        return cls(head["kind"], trees, list(head["votes"]), head["base"], [list(c) for c in head["limits"]], head["depth"])


class _Writer:
    def __init__(self, model: Ensemble):
        self.model = model

    def overwrite(self) -> _Writer:
        return self

    def save(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        rows = [(t, n, *cells) for t, tree in enumerate(m.trees) for n, cells in enumerate(zip(tree.feature, tree.cut, tree.left, tree.right, tree.value))]
        spark.createDataFrame(rows, "tree int, node int, feature int, cut int, left int, right int, value double").write.mode("overwrite").parquet(f"{path}/nodes")
        head = [(m.kind, m.votes, m.base, m.limits, m.depth)]
        kinds = "kind string, votes array<double>, base double, limits array<array<double>>, depth int"
        spark.createDataFrame(head, kinds).write.mode("overwrite").parquet(f"{path}/model")


def weighted_median(answers: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """For each row the first answer, in order of size, that half of the votes have reached."""
    order = np.argsort(answers, axis=1, kind="stable")
    reached = np.cumsum(votes[order], axis=1)
    first = (reached >= 0.5 * votes.sum()).argmax(axis=1)
    return np.take_along_axis(answers, order, axis=1)[np.arange(len(answers)), first]


# ---- ways of learning; a model is a pair (fold held out, target)

Model = tuple[int, int]


def _learns(batch: Batch, held_out: int) -> np.ndarray:
    return (batch.fold >= 0) & (batch.fold != held_out)


def forests(frame: Frame, models: Sequence[Model], members: int, depth: int, bagged: bool = True) -> list[Ensemble]:
    """``members`` trees for each model, over all features and drawn rows."""
    if frame.few is not None:
        trees = grown(frame, _sums_of_bags(frame, models, members) if bagged else _sums_of_models(totals(frame), models), depth)
        return _of_members(frame, models, trees, members)

    def sampler(batch: Batch):
        def sample(t: int) -> tuple[np.ndarray, np.ndarray]:
            held_out, target = models[t // members]
            weight = _learns(batch, held_out).astype(float)
            return (weight * batch.drawn[:, t % members] if bagged else weight), batch.y[:, target]

        return sample

    return _of_members(frame, models, grow(frame, sampler, members * len(models), depth), members)


def _of_members(frame: Frame, models: Sequence[Model], trees: list[Tree], members: int) -> list[Ensemble]:
    return [Ensemble("mean", trees[i * members : (i + 1) * members], [1.0] * members, 0.0, frame.limits) for i in range(len(models))]


def _sums_of_models(found: Totals, models: Sequence[Model]) -> np.ndarray:
    """Models x rows of bins x (rows, sum of their targets)."""
    out = np.zeros((len(models), found.n.shape[1], 2))
    for m, (held_out, t) in enumerate(models):
        own = found.learnt(held_out)
        out[m, :, 0] = found.n[own].sum(axis=0)
        out[m, :, 1] = found.y[own, :, t].sum(axis=0) + out[m, :, 0] * found.middle[t]
    return out


def _sums_of_bags(frame: Frame, models: Sequence[Model], members: int) -> np.ndarray:
    """Trees x rows of bins x (weight, weighted target): draws are added up by fold, and a model adds its folds."""
    few, targets = frame.few, sorted({t for _, t in models})
    folds = sorted(r[0] for r in frame.data.select("fold").distinct().collect())

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((1 + len(targets), len(folds) * len(few), members))
        for raw in batches:
            batch = Batch.of(raw)
            at = _by_fold(batch, few, folds)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            drawn = batch.drawn[order, :members].astype(float)
            for j, values in enumerate([None, *[batch.y[order, t, None] for t in targets]]):
                sums[j, at[order[starts]]] += np.add.reduceat(drawn if values is None else drawn * values, starts, axis=0)
        return sums.reshape(1 + len(targets), len(folds), -1).reshape((1 + len(targets)) * len(folds), -1)

    found = _added(frame.data, fill, (1 + len(targets)) * len(folds), len(few) * members).reshape(1 + len(targets), len(folds), len(few), members)
    out = np.zeros((len(models), members, len(few), 2))
    for m, (held_out, t) in enumerate(models):
        own = np.array([f >= 0 and f != held_out for f in folds], dtype=bool)
        for j, k in enumerate((0, 1 + targets.index(t))):
            out[m, :, :, j] = found[k, own].sum(axis=0).T
    return out.reshape(-1, len(few), 2)


def single_trees(frame: Frame, models: Sequence[Model], depth: int) -> list[Ensemble]:
    return forests(frame, models, 1, depth, bagged=False)


def _sums(data: DataFrame, numbers: Callable[[Batch], np.ndarray], count: int, largest: bool = False) -> np.ndarray:
    """Column sums, or with ``largest`` maxima of the first column, of a table of count x 3 per batch."""
    kind = "part int, model int, a double, b double, c double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((count, 3))
        for raw in batches:
            found = numbers(Batch.of(raw))
            total[:, 0] = np.maximum(total[:, 0], found[:, 0]) if largest else total[:, 0] + found[:, 0]
            total[:, 1:] += found[:, 1:]
        part = [TaskContext.get().partitionId()] * count
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(range(count), pa.int32()), *[pa.array(c) for c in total.T]], ["part", "model", "a", "b", "c"])

    parts = data.mapInArrow(run, kind)
    first = F.max("a") if largest else F.sum("a")
    rows = parts.groupBy("model").agg(first.alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")).collect()
    out = np.zeros((count, 3))
    for r in rows:
        out[r["model"]] = (r["a"], r["b"], r["c"])
    return out


def _with_state(frame: Frame, state: Callable[[Batch], np.ndarray], purpose: str) -> Frame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            rows = _bytes_of(state(Batch.of(raw)))
            yield pa.RecordBatch.from_arrays([*[raw.column(i) for i in range(4)], rows], ["fold", "bins", "y", "drawn", "state"])

    return replace(frame, data=shelved(frame.data.mapInArrow(run, _FRAME), purpose))


def boosted(frame: Frame, models: Sequence[tuple[int, int, float]], rounds: int, depth: int = 3) -> list[Ensemble]:
    """Least-squares boosting from the mean; a model is (fold held out, target, rate)."""
    if frame.few is not None:
        return _boosted_few(frame, models, rounds, depth)
    count, few = len(models), frame.few

    def means(batch: Batch) -> np.ndarray:
        learns = [(_learns(batch, h), batch.y[:, t]) for h, t, _ in models]
        return np.array([[w.sum(), y[w].sum(), 0.0] for w, y in learns]).reshape(count, 3)

    totals = _sums(frame.data, means, count)
    base = totals[:, 1] / np.maximum(totals[:, 0], 1)
    frame = _with_state(frame, lambda batch: np.tile(base, (len(batch.fold), 1)), "margins")
    made: list[list[Tree]] = [[] for _ in models]
    recent: list[list[Tree]] = [[] for _ in models]

    def margins(batch: Batch) -> np.ndarray:
        out = batch.state.copy()
        for m, trees in enumerate(recent):
            for tree in trees:
                out[:, m] += models[m][2] * batch.answers(tree, few)
        return out

    def sampler(batch: Batch):
        now = margins(batch)
        return lambda m: (_learns(batch, models[m][0]).astype(float), batch.y[:, models[m][1]] - now[:, m])

    for i in range(rounds):
        for m, tree in enumerate(grow(frame, sampler, count, depth)):
            made[m].append(tree)
            recent[m].append(tree)
        if (i + 1) % SEGMENT == 0 and i + 1 < rounds:
            frame = _with_state(frame, margins, "margins")
            for trees in recent:
                trees.clear()
    return [Ensemble("sum", made[m], [models[m][2]] * rounds, float(base[m]), frame.limits) for m in range(count)]


def _boosted_few(frame: Frame, models: Sequence[tuple[int, int, float]], rounds: int, depth: int) -> list[Ensemble]:
    found, shapes = totals(frame), _shapes(frame.few)
    sums = _sums_of_models(replace(found, middle=np.zeros_like(found.middle)), [m[:2] for m in models])
    middle = np.array([found.middle[t] for _, t, _ in models])
    weight, target = sums[..., 0], sums[..., 1]  # targets less their middle
    base = target.sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    margins, made = np.repeat(base[:, None], len(shapes), axis=1), [[] for _ in models]
    for _ in range(rounds):
        for m, tree in enumerate(grown(frame, np.stack([weight, target - weight * margins], axis=2), depth)):
            made[m].append(tree)
            margins[m] += models[m][2] * tree.predict(shapes)
    return [Ensemble("sum", made[m], [rate] * rounds, float(base[m] + middle[m]), frame.limits) for m, (_, _, rate) in enumerate(models)]


@dataclass(frozen=True)
class Packed:
    """Different targets by (fold, row of bins, target) with the number of their rows, in order of size, a block of them in each row.

    A model's round multiplies a row's weight by beta ** (1 - |answer - y| / worst). For rows of
    equal bins the answer is the same, so the logarithm of the weight after some rounds is a
    broken line over y whose knots are the answers.
    """

    data: DataFrame
    ends: dict[tuple[int, int, int], tuple[float, float]]  # least and largest target

    @classmethod
    def of(cls, frame: Frame) -> Packed:
        few = frame.few

        def sorted_runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """An order by all columns, the first counting most, and the starts of equal rows."""
            order = np.lexsort(columns[::-1])
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
            return order, np.flatnonzero(new)

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
            waiting, size = [], 0
            for raw in batches:
                waiting += [raw] if raw.num_rows else []
                size += raw.num_rows
                if size >= SORTED:
                    yield waiting
                    waiting, size = [], 0
            if waiting:
                yield waiting

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in gathered(batches):
                rows = [Batch.of(raw) for raw in some]
                fold, y = np.concatenate([b.fold for b in rows]), np.concatenate([b.y for b in rows])
                place = np.concatenate([b.places(few) for b in rows])
                for t in range(y.shape[1]):
                    order, starts = sorted_runs(fold, place, y[:, t])
                    first, n = order[starts], np.diff(starts, append=len(order))
                    found = (fold[first], place[first], np.full(len(first), t), y[first, t], n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["fold", "place", "target", "y", "n"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in gathered(batches):
                fold, place, target, y, n = (np.concatenate([raw.column(i).to_numpy() for raw in some]) for i in range(5))
                order = np.lexsort((y, target, place, fold))
                y, n, rows = y[order], n[order].astype(float), []
                own = np.stack([fold[order], place[order], target[order]])
                starts = np.flatnonzero(np.concatenate([[True], (own[:, 1:] != own[:, :-1]).any(axis=0)]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(y)]):
                    for c in range(a, b, PACK):
                        d = min(b, c + PACK)
                        rows.append((*own[:, a].tolist(), float(y[c]), float(y[d - 1]), y[c:d].tobytes(), n[c:d].tobytes()))
                packed = [pa.int32()] * 3 + [pa.float64()] * 2 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), packed)], ["fold", "place", "target", "low", "high", "y", "n"])

        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        counted = _without_draws(frame.data).where("fold >= 0").mapInArrow(count, "fold int, place int, target int, y double, n long")
        counted = counted.groupBy("fold", "place", "target", "y").agg(F.sum("n").alias("n"))
        data = shelved(counted.mapInArrow(pack, "fold int, place int, target int, low double, high double, y binary, n binary"), "packed")
        ends = data.groupBy("fold", "place", "target").agg(F.min("low"), F.max("high")).collect()
        return cls(data, {tuple(r)[:3]: tuple(r)[3:] for r in ends})

    def worst(self, model: Model, answers: np.ndarray) -> float:
        """The largest distance of an answer from a target the model learns from."""
        found = [max(abs(answers[s] - low), abs(answers[s] - high)) for (f, s, t), (low, high) in self.ends.items() if f != model[0] and t == model[1]]
        return max(found, default=0.0)

    def added(self, models: Sequence[Model], lines: Sequence[Lines], size: int, figures: Callable[[int, int, np.ndarray, np.ndarray], tuple]) -> np.ndarray:
        """Models x rows of bins x 2: sums over the blocks of ``figures`` of model, row of bins, different targets and the weights of their rows."""

        def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            sums = np.zeros((len(models), size, 2))
            for raw in batches:
                for fold, place, target, packed, counts in zip(*[raw.column(i).to_pylist() for i in range(5)]):
                    y, n = np.frombuffer(packed, dtype=np.float64), np.frombuffer(counts, dtype=np.float64)
                    for m, (held_out, t) in enumerate(models):
                        if t == target and fold != held_out:
                            sums[m, place] += figures(m, place, y, n * lines[m].weights(place, y))
            return sums

        return _added(self.data.select("fold", "place", "target", "y", "n"), fill, len(models), 2 * size).reshape(len(models), size, 2)


@dataclass(frozen=True)
class Lines:
    """For each row of bins a broken line over the targets: knots, and height and slope of each piece."""

    knots: np.ndarray  # row of bins x knot
    height: np.ndarray  # row of bins x piece
    slope: np.ndarray

    @classmethod
    def of(cls, size: int, steps: Sequence[tuple[np.ndarray, float, float]]) -> Lines:
        """The logarithm of the weights after steps (answers, worst, beta)."""
        if not steps:
            return cls(np.zeros((size, 0)), np.zeros((size, 1)), np.zeros((size, 1)))
        answers, log = np.stack([a for a, _, _ in steps], axis=1), np.array([math.log(b) for _, _, b in steps])
        rate = np.broadcast_to(log / np.array([w for _, w, _ in steps]), answers.shape)
        order = np.argsort(answers, axis=1, kind="stable")
        knots, rate = np.take_along_axis(answers, order, axis=1), np.take_along_axis(rate, order, axis=1)
        none = np.zeros((size, 1))
        # of the knots below a piece, and of those above it
        below, above = (np.concatenate([none, np.cumsum(x, axis=1)], axis=1) for x in (rate, rate[:, ::-1]))
        low, high = (np.concatenate([none, np.cumsum(x, axis=1)], axis=1) for x in (rate * knots, (rate * knots)[:, ::-1]))
        return cls(knots, log.sum() + low - high[:, ::-1], above[:, ::-1] - below)

    def weights(self, place: int, y: np.ndarray) -> np.ndarray:
        """The weights of targets in order of size."""
        if not self.knots.shape[1]:
            return np.ones(len(y))
        pieces = np.diff(np.searchsorted(y, self.knots[place]), prepend=0, append=len(y))
        return np.exp(np.repeat(self.height[place], pieces) + np.repeat(self.slope[place], pieces) * y)


def _voted(going: list[int], trees: list[Tree], facts: np.ndarray, made: list[list[Tree]], votes: list[list[float]]) -> dict[int, tuple[float, float]]:
    """Takes the trees in; (worst, beta) of those models that go on. Facts are worst, lost and weight."""
    kept = {}
    for k, (worst, lost, weight) in enumerate(facts):
        m = going[k]
        loss = lost / worst / weight if worst > 0 else 0.0
        if loss <= 0 or loss >= 0.5:
            if loss <= 0 or not made[m]:
                made[m].append(trees[k])
                votes[m].append(1.0)
            continue
        beta = loss / (1 - loss)
        made[m].append(trees[k])
        votes[m].append(math.log(1 / beta))
        kept[k] = (float(worst), float(beta))
    return kept


def _reweighted_few(frame: Frame, models: Sequence[Model], rounds: int, depth: int) -> list[Ensemble]:
    packed, shapes = Packed.of(frame), _shapes(frame.few)
    size = len(shapes)
    made: list[list[Tree]] = [[] for _ in models]
    votes: list[list[float]] = [[] for _ in models]
    steps: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in models]  # answers, largest miss, beta
    going = list(range(len(models)))
    for _ in range(rounds):
        if not going:
            break
        own, lines = [models[m] for m in going], [Lines.of(size, steps[m]) for m in going]
        sums = packed.added(own, lines, size, lambda m, place, y, w: (w.sum(), w @ y))
        trees = grown(frame, sums, depth)
        answers = [tree.predict(shapes) for tree in trees]
        lost = packed.added(own, lines, size, lambda m, place, y, w: (w @ np.abs(answers[m][place] - y), 0.0))
        worst = [packed.worst(model, a) for model, a in zip(own, answers)]
        facts = np.stack([worst, lost[..., 0].sum(axis=1), sums[..., 0].sum(axis=1)], axis=1)
        kept = _voted(going, trees, facts, made, votes)
        for k, (most, beta) in kept.items():
            steps[going[k]].append((answers[k], most, beta))
        going = [going[k] for k in kept]
    return [Ensemble("median", made[m], votes[m], 0.0, frame.limits) for m in range(len(models))]


def reweighted(frame: Frame, models: Sequence[Model], rounds: int, depth: int = 3) -> list[Ensemble]:
    """AdaBoost.R2 (Drucker, 1997) with linear loss: trees on weights, no resampling.

    A model stops early when a tree is perfect, or when its weighted loss reaches a half
    (that tree doesn't count, unless it is the first).
    """
    if frame.few is not None and len(frame.few) <= DENSE:
        return _reweighted_few(frame, models, rounds, depth)
    count, few = len(models), frame.few
    frame = _with_state(frame, lambda batch: np.ones((len(batch.fold), count)), "weights")
    made: list[list[Tree]] = [[] for _ in models]
    votes: list[list[float]] = [[] for _ in models]
    recent: list[list[tuple[Tree, float, float]]] = [[] for _ in models]  # tree, largest miss, beta
    going = list(range(count))

    def missed(batch: Batch, m: int, tree: Tree) -> np.ndarray:
        return np.abs(batch.answers(tree, few) - batch.y[:, models[m][1]])

    def weights(batch: Batch) -> np.ndarray:
        out = batch.state.copy()
        for m, steps in enumerate(recent):
            for tree, worst, beta in steps:
                out[:, m] *= beta ** (1 - np.minimum(missed(batch, m, tree) / worst, 1.0))
        return out

    for i in range(rounds):
        if not going:
            break

        def sampler(batch: Batch):
            now = weights(batch)
            return lambda k: (_learns(batch, models[going[k]][0]) * now[:, going[k]], batch.y[:, models[going[k]][1]])

        trees = grow(frame, sampler, len(going), depth)

        def losses(batch: Batch) -> np.ndarray:
            now, out = weights(batch), np.zeros((len(going), 3))
            for k, m in enumerate(going):
                learns, miss = _learns(batch, models[m][0]), missed(batch, m, trees[k])
                weight = now[learns, m]
                out[k] = (miss[learns].max(initial=0.0), (weight * miss[learns]).sum(), weight.sum())
            return out

        facts = _sums(frame.data, losses, len(going), largest=True)
        kept = _voted(going, trees, facts, made, votes)
        for k, (worst, beta) in kept.items():
            recent[going[k]].append((trees[k], worst, beta))
        going = [going[k] for k in kept]
        if (i + 1) % SEGMENT == 0 and i + 1 < rounds and going:
            frame = _with_state(frame, weights, "weights")
            for steps in recent:
                steps.clear()
    return [Ensemble("median", made[m], votes[m], 0.0, frame.limits) for m in range(count)]
