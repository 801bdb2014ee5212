"""Tables of a fixed number of counts, added up over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cashtrail.llm.common import tidy

BLOCKS = 64
_KIND = "block int, counts binary"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of any width by planes of equal bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(planes: bytes, kind: str | type) -> np.ndarray:
    """The numbers that were packed, of the width they had."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(planes), dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


class Counts:
    """A table of whole numbers in four bytes each; what could outgrow them is kept aside.

    It is read by slices, as int64, the way ``added_up`` reads a table.
    """

    ROOM, SMALL = 1 << 31, 1 << 16

    def __init__(self, cells: int):
        self.table, self.most = np.zeros(cells, dtype=np.uint32), 0  # no cell holds more than ``most``
        self.places, self.aside = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _put_aside(self, places: np.ndarray, counts: np.ndarray) -> None:
        self.places, place = np.unique(np.concatenate([self.places, places]), return_inverse=True)
        sums = np.zeros(len(self.places), dtype=np.int64)
        np.add.at(sums, place, np.concatenate([self.aside, counts]))
        self.aside = sums

    def add(self, places: np.ndarray, counts: np.ndarray) -> None:
        total = int(counts.sum())
        if total >= self.ROOM:
            self._put_aside(places, counts)
            return
        if self.most + total >= 2 * self.ROOM:
            large = np.flatnonzero(self.table >= self.SMALL)
            self._put_aside(large, self.table[large].astype(np.int64))
            self.table[large], self.most = 0, self.SMALL
        np.add.at(self.table, places, counts.astype(np.uint32))
        self.most += total

    def __getitem__(self, some: slice) -> np.ndarray:
        start, stop, _ = some.indices(len(self.table))
        out = self.table[start:stop].astype(np.int64)
        a, b = np.searchsorted(self.places, (start, stop))
        out[self.places[a:b] - start] += self.aside[a:b]
        return out


def _batch(blocks: list[int], parts: Iterable[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], ["block", "counts"])


def added_up(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray | Counts], cells: int) -> np.ndarray:
    """Sum of the tables that ``fill`` makes of each task's rows, as whole numbers.

    Every task hands on one table in compressed blocks; equal blocks are added up as
    they stream by. ``cells`` is a parameter of the caller and not of the data, so
    what a task holds and what reaches the driver is bounded.
    """
    width = -(-cells // BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fill(batches)

        def parts() -> Iterator[np.ndarray]:
            for k in range(BLOCKS):
                some = table[k * width : (k + 1) * width]
                yield np.concatenate([some, np.zeros(width - len(some), dtype=some.dtype)]).astype(np.int64, copy=False)

        yield _batch(list(range(BLOCKS)), parts())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = unpacked(counts, np.int64)
                if block in sums:
                    sums[block] += found
                else:
                    sums[block] = found.copy()
        if sums:
            yield _batch(list(sums), list(sums.values()))

    table = np.zeros((BLOCKS, width), dtype=np.int64)
    for row in df.mapInArrow(tidy(count), _KIND).repartition(BLOCKS, "block").mapInArrow(tidy(add), _KIND).toLocalIterator():
        table[row["block"]] = unpacked(row["counts"], np.int64)
    return table.reshape(-1)[:cells]
