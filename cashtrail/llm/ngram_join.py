"""Similarity join of documents on word n-grams (Jaccard), and the groups it links.

1. Equal sets fall into one class, represented by its smallest id.
2. A pair that is similar enough shares one of the first few n-grams of both sets in
   any common order. N-grams of much-repeated passages come last in the order, so
   the first ones are rare; a fixed-size table of counts over all documents finds them.
3. Representatives with such an n-gram in common form tiles by size band: neighbours
   in size only, at most ``BLOCK`` by ``BLOCK``. N-grams with equal representatives
   count once (told by the sum of 64-bit hashes). In a tile the parity bitmaps of two
   sets bound their overlap from above: each bit that differs is an element only one
   of them has. Pairs beyond the bound are dropped.
4. Sets of the connected candidates are cut into the same kind of tiles and
   intersected exactly as sorted arrays. A tile visits what it has not reached yet
   from what it has, so it gives a spanning forest of its links and never all pairs.

No link between different texts is lost: two sets that link lie in one tile of step 3
and in one of step 4, and end in one component.

A text without words, empty or null has no n-grams, links with nothing and is its
own component. A row with a null id takes no part in links and has no component. Rows
that share an id count as one document. Further columns are not carried through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm.common import documents, small_batches, small_side, stored, tidy
from cashtrail.llm.graph import components
from cashtrail.llm.hashed import classes, sequences, word_hashes
from cashtrail.llm.tables import added_up

TABLE_SHARE = 256  # characters of the corpus for each cell of the table of counts
TABLE_SIZES = (16, 24)  # bits of the smallest and the largest table
FREQUENT = (32, 2)  # at least so many, and so many times the mean cell
BITMAP = (512, 65536)  # bits of the smallest and the largest bitmap
BLOCK = 512  # members of a tile side


def ngrams(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams; fewer words are one n-gram."""
    for words, counts in word_hashes(texts, classes(symbols_apart=False), lower=True):
        at = 0
        for n in counts.tolist():
            yield np.unique(sequences(words[at : at + n], min(n, size) or 1))
            at += n


def _cell(hashes: np.ndarray, table_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - table_bits)).astype(np.int64)


def _bitmap(hashes: np.ndarray) -> bytes:
    """For each cell, is the number of elements in it odd? About as many bits as elements."""
    bits = min(max(1 << (max(len(hashes), 1) - 1).bit_length(), BITMAP[0]), BITMAP[1])
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps (rows) of the same sets with fewer bits."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


class _Bitmaps:
    """Bitmaps of several lengths; two are compared at the shorter length."""

    def __init__(self, bitmaps: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bitmaps])
        self.place, self.of = np.zeros(len(bitmaps), dtype=np.int64), {}
        for words in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == words)
            self.place[rows] = np.arange(len(rows))
            self.of[words] = np.frombuffer(b"".join([bitmaps[i] for i in rows]), dtype=np.uint64).reshape(len(rows), words)

    def differing(self, x: int, others: np.ndarray) -> np.ndarray:
        own, out = int(self.words[x]), np.zeros(len(others), dtype=np.int64)
        for words in np.unique(self.words[others]).tolist():
            same, least = self.words[others] == words, min(words, own)
            one = _folded(self.of[own][self.place[x]][None, :], least)
            many = _folded(self.of[words][self.place[others[same]]], least)
            out[same] = np.bitwise_count(one ^ many).sum(axis=1, dtype=np.int64)
        return out


def frequent_cells(docs: DataFrame, text: str, size: int) -> bytes:
    """One bit per cell of the table: does it hold far more documents than the others?

    Each task counts its documents' n-grams; the tables are added up cell by cell.
    The table grows with the corpus up to a bound, so a cell means the same at any size.
    """
    characters = docs.agg(F.sum(F.length(text))).first()[0] or 0
    least, most = TABLE_SIZES
    table_bits = min(max((characters // TABLE_SHARE).bit_length(), least), most)
    cells = 1 << table_bits

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            waiting, n = [], 0
            for grams in ngrams(batch.column(0).to_pylist(), size):
                waiting.append(grams)
                n += len(grams)
                if n > cells // 4:
                    table += np.bincount(_cell(np.concatenate(waiting), table_bits), minlength=cells)
                    waiting, n = [], 0
            if n:
                np.add.at(table, _cell(np.concatenate(waiting), table_bits), 1)
        return table

    table = added_up(docs.select(text), fill, cells)
    least, times = FREQUENT
    return np.packbits(table > max(least, times * table.mean())).tobytes()


def first_count(n: int, percent: int) -> int:
    """How many of the first n-grams must be looked at: one more than may be missing."""
    return n + (-percent * n) // 100 + 1


def profiles(docs: DataFrame, id_column: str, text: str, size: int, percent: int) -> DataFrame:
    """(doc_id, n, digest of the set, bitmap, first n-grams) of every document, stored."""
    frequent = frequent_cells(docs, text, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(np.frombuffer(frequent, dtype=np.uint8)).astype(bool)
        table_bits = len(late).bit_length() - 1
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for found in ngrams(batch.column(1).to_pylist(), size):
                n = len(found)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                last = late[_cell(found, table_bits)]
                ordered = np.concatenate([found[~last], found[last]])[: first_count(n, percent) if n else 0]
                for column, value in zip(out, (n, digest[:8], digest[8:], _bitmap(found), ordered.view(np.int64))):
                    column.append(value)
            d1, d2 = (pa.array(np.frombuffer(b"".join(x), dtype=np.int64)) for x in (out[1], out[2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), d1, d2, pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))],
                ["doc_id", "n", "d1", "d2", "bits", "first"],
            )

    kind = "doc_id long, n long, d1 long, d2 long, bits binary, first array<long>"
    return stored(docs.select(F.col(id_column).cast("long").alias("doc_id"), text).mapInArrow(tidy(run), kind), "ngram-profiles")


def _reached(sizes: np.ndarray, bits: _Bitmaps, sets: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over the members, sorted by size.

    With sets a pair is an edge if it links; without, if the bitmaps don't rule it out.
    """
    left = np.arange(len(sizes))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            low = np.searchsorted(sizes[left], -(-percent * sizes[x] // 100))
            high = np.searchsorted(sizes[left], sizes[x] * 100 // percent, side="right")
            near = left[low:high]
            if not len(near):
                continue
            both = sizes[near] + sizes[x]
            overlap = (both - bits.differing(x, near)) // 2
            near = near[100 * overlap >= percent * (both - overlap)]
            if sets is not None and len(near):
                own, ends = sets[x], np.cumsum([len(sets[c]) for c in near])
                other = np.concatenate([sets[c] for c in near])
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                shared = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], ends[:-1]]))
                near = near[100 * shared >= percent * (sizes[near] + sizes[x] - shared)]
            for c in near.tolist():
                yield x, c
            frontier += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)] if len(near) else left


def _forest_of_tiles(tiles: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) of all tiles; rows are (tile, node, n, bits[, grams])."""

    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[2], r[1]))
        sizes = np.array([r[2] for r in rows], dtype=np.int64)
        bits = _Bitmaps([r[3] for r in rows])
        sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows] if exact else None
        return [(rows[x][1], rows[c][1]) for x, c in _reached(sizes, bits, sets, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        out: list[tuple[int, int]] = []

        def batch_of(found):
            a, b = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if waiting and waiting[0][0] != row[0]:
                    out += edges(waiting) if len(waiting) > 1 else []
                    waiting = []
                waiting.append(row)
            if out:
                yield batch_of(out)
                out = []
        out += edges(waiting) if len(waiting) > 1 else []
        if out:
            yield batch_of(out)

    columns = ["tile", "node", "n", "bits"] + (["grams"] if exact else [])
    dealt = tiles.select(*columns).repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(tidy(run), "a long, b long").filter("a != b").distinct()


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [batch.column(k).to_numpy() for k in (2, 4)]
            differ = [int(_Bitmaps([x, y]).differing(0, np.array([1]))[0]) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            both = sizes[0] + sizes[1]
            overlap = (both - np.array(differ)) // 2
            overlap = np.minimum(overlap, np.minimum(*sizes))
            fits = pa.array(100 * overlap >= percent * (both - overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fits), batch.column(1).filter(fits)], ["a", "b"])

    sides = reps.select("doc_id", "n", "bits").dropDuplicates(["doc_id"])
    left = sides.toDF("a", "n_a", "bits_a")
    right = sides.toDF("b", "n_b", "bits_b")
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return found.mapInArrow(run, "a long, b long")


def _tiles(rows: DataFrame, key: Column, members: Column, percent: int) -> DataFrame:
    """Deal the rows of each key to tiles: two neighbouring bands, two blocks.

    A key with few members is one tile; its sizes are told apart there.
    """
    step = math.log(100 / percent) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / step)
    blocks = F.ceil(members / BLOCK)
    bands = F.when(blocks > 1, F.array(band, band - 1)).otherwise(F.array(F.lit(-1).cast("long")))
    rows = rows.withColumn("_band", F.explode(bands)).withColumn("_blocks", blocks)
    own = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return rows.withColumn("tile", F.xxhash64(key, "_band", F.least("_own", "_other"), F.greatest("_own", "_other")))


def linked(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every row."""
    small_batches(docs.sparkSession)
    found = profiles(docs, id_column, text, size, percent)
    usable = found.filter("doc_id is not null and n > 0")
    classes = usable.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = stored(classes, "ngram-classes")
    reps = usable.join(classes.withColumnRenamed("class_id", "doc_id"), ["d1", "d2", "n", "doc_id"], "left_semi")

    # Representatives that share one of their first n-grams.
    grams = reps.select(F.col("doc_id").alias("node"), F.explode("first").alias("gram"))
    # N-grams held by the same representatives make the same tile: one of them is enough.
    same = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("print")]
    shared = grams.groupBy("gram").agg(*same).filter("lo < hi")
    shared = stored(shared.groupBy("lo", "hi", "members", "print").agg(F.min("gram").alias("gram")), "ngram-shared")
    pairs = _possible(shared.filter("members = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), reps, percent)
    many = small_side(shared.filter("members > 2").select("gram", "members"))
    groups = grams.join(many, "gram").join(reps.select(F.col("doc_id").alias("node"), "n", "bits"), "node")
    candidates = pairs.unionByName(_forest_of_tiles(_tiles(groups, F.col("gram"), F.col("members"), percent), percent, exact=False))

    # The sets of connected candidates, intersected exactly.
    clusters = components(candidates)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    clusters = small_side(clusters.join(sizes, "component"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(ngrams(batch.column(3).to_pylist(), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([_bitmap(f) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())],
                ["node", "component", "members", "n", "bits", "grams"],
            )

    texts = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text).alias("text")).join(clusters, "node")
    texts = texts.select("node", "component", "members", "text").mapInArrow(
        tidy(sets), "node long, component long, members long, n long, bits binary, grams binary"
    )
    tiles = _tiles(texts.filter("n > 0"), F.col("component"), F.col("members"), percent)
    groups = components(_forest_of_tiles(tiles, percent, exact=True))

    rows = found.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    rows = rows.join(groups.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    known = F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), size=3, percent=90)
