"""Language-model scores by logistic context mixing, beside exact word counts.

The model spells the words of a text, lower-cased, each with a blank behind it, and a
single blank at the end of the text. A symbol is a path of bits in a code tree made
from the corpus' byte counts. Each bit has one predictor per context (the last one to
four symbols of the word, the word so far, and this with the kind of the word before):
counts of zeros and ones in a hashed table, filled from all training documents. The
predictions are stretched, weighted and added; the gate picks the weights by how often
the longer contexts were seen. The sum is refined by what really followed such sums (an
adaptive probability map). Weights and map are learnt online, bit by bit in small
batches, in every task from all its training words; each occurrence is taken out of the
counts it is predicted from, and averaged over all tasks.

Contexts reach back to the kind of the word before and no further, so a word behind a
kind is spelled, learnt from and scored once, however often it occurs. Spark adds up
these pairs over the corpus and joins their scores back:

1. every task cuts its texts into blocks, and writes for each document the places of its
   pairs in the block's list (some documents to a row), and the list itself in parts by
   range of word hashes;
2. the parts of a range are added up by pair and by word;
3. code tree, tables, weights and map are fitted on the pairs;
4. the parts of a range meet again, each pair is scored once, and every part goes back to
   its block as counts and scores.

Texts are read once and never shuffled; lists travel in packed parts of sorted words. A
frequent word has one entry per block and kind. A range holds about what a block lists.
The tables' cells follow the number of different pairs, from 2^-8 to twice ``SIZES``,
which bounds what a worker holds to 70 MB; whatever is written, shuffled or broadcast
travels by planes of equal bytes, compressed.

A null text counts as empty: no words, one end. A row with a null id is never learnt
from and counts as not held out. Repeated rows are learnt and scored one by one.
Without training documents all counts are zero. Further columns are not carried through.
Case and runs of blanks are not coded; ``bits_per_byte`` counts the coded bytes only.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.llm.common import documents, remainder, small_batches, stored, tidy
from cashtrail.llm.hashed import classes, mixed, range_hashes, word_places
from cashtrail.llm.tables import Counts, added_up, packed, unpacked

FOLDS, HELD_OUT = 7, 2
RUN = 1_000_000  # characters worked on at once
BLOCK = 24_000_000  # characters of a block of documents
TOGETHER = 1 << 15  # words of the documents whose places are packed together
PAIRS = 100_000  # pairs of a word and a kind spelled at once
OFTEN = (16, 256)  # pairs found so often in a block get the low places, which pack well
BLANK = 0x20
# Bits of the hashed table of each context at 2^23 pairs: 1 to 4 symbols, the word so far (from the
# place DEEP on the last six symbols), and the word so far with the kind of the word
# before, by its last letters (from the place EARLY on the last five symbols).
SIZES = (16, 18, 20, 20, 22, 21)
LASTS, EARLY, DEEP = 6, 3, 8
KINDS = 32
SIGNS = np.frombuffer(b".,;:!?", dtype=np.uint8)
END = np.uint64(0xE4D)  # the hash of a text's end
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SOFT = 0.1  # added to both counts of a predictor
# gates: upper ends of the count classes of three contexts
SEEN_BEHIND, SEEN_WORD, SEEN_FOUR = (0, 2, 8, 40), (0, 1, 4, 20), (0, 15)
GATES = (len(SEEN_BEHIND) + 1) * (len(SEEN_WORD) + 1) * (len(SEEN_FOUR) + 1)
MAP = 33  # classes of the refining map
MIX_BATCH = 8192
FIXED = 1 << 20  # weights travel as whole numbers
_LISTED = (
    "block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_bytes array<long>, places binary, "
    "range long, start long, words binary, marks binary, n binary"
)
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, n_bytes long"


def table_sizes(pairs: int) -> tuple[int, ...]:
    """Bits of the tables for so many different pairs."""
    more = math.ceil(math.log2(max(pairs, 1) / (1 << 23)))
    return tuple(s + min(max(more, -8), 1) for s in SIZES)


def code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (from the top bit of 64) and their lengths for all bytes, by Huffman's rule."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children, fresh = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    codes, lengths = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
    todo = [(heap[0][2], 0, 0)]
    while todo:
        node, code, depth = todo.pop()
        if node < 256:
            codes[node], lengths[node] = np.uint64(code << (64 - depth)), depth
        else:
            todo += [(child, code * 2 + bit, depth + 1) for bit, child in enumerate(children[node])]
    return codes, lengths


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's key, and the first row of each key."""
    number, values = pd.factorize(keys)
    first = np.zeros(len(values), dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, first


class Pairs:
    """The distinct pairs (word, kind of the word before) of a run of texts.

    A text ends with the empty word. ``number`` is the pair of each word, ``words_of``
    the words of each text with its end.
    """

    def __init__(self, texts: list[str | None]):
        whole, starts, ends, hashes, words_of = word_places(texts)
        after = np.cumsum(words_of)
        starts, ends = np.insert(starts, after, 0), np.insert(ends, after, 0)
        hashes, self.words_of = np.insert(hashes, after, END), words_of + 1
        last = ends - 1 - np.isin(whole[ends - 1], SIGNS)
        second = np.where(last > starts, whole[np.maximum(last - 1, 0)], BLANK).astype(np.uint64)
        kind = (whole[last].astype(np.uint64) << np.uint64(8)) | second
        kind = mixed(kind) % np.uint64(KINDS) + np.uint64(1)
        before = np.concatenate([[0], kind[:-1]]).astype(np.uint64)
        before[np.cumsum(self.words_of) - self.words_of] = 0  # nothing before a text's first word
        with np.errstate(over="ignore"):
            keys = hashes ^ mixed(before + np.uint64(31))
        self.number, first = _distinct(keys)
        self.keys, self.hashes, self.before = keys[first], hashes[first], before[first].astype(np.uint8)
        self.bytes_of = np.add.reduceat(ends - starts + 1, np.cumsum(self.words_of) - self.words_of)
        data = whole.tobytes()
        self.words = pa.array([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary())


class Spelling:
    """The distinct steps that spell pairs of a word and the kind before it."""

    def __init__(self, words: pa.Array, before: np.ndarray):
        limits = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        whole = np.frombuffer((words.buffers()[2] or b"") or b" ", dtype=np.uint8)
        starts, sizes, before = limits[:-1], np.diff(limits), before.astype(np.uint64)
        offsets = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(int(sizes.sum()) + len(sizes)) - np.repeat(offsets, sizes + 1)
        symbol = whole[np.minimum(np.repeat(starts, sizes + 1) + place, len(whole) - 1)].astype(np.int64)
        symbol[offsets + sizes] = BLANK
        with np.errstate(over="ignore"):
            weights = (mixed(np.arange(int(sizes.max()) + 1, dtype=np.uint64) + np.uint64(1)) | np.uint64(1))[place]
            parts = mixed(np.arange(256, dtype=np.uint64) + np.uint64(999))[symbol] * weights
            earlier = np.cumsum(parts) - parts
            spelt = earlier - np.repeat(earlier[offsets], sizes + 1)
            prefix = mixed(spelt + place.astype(np.uint64) * SPREAD)
            # the last symbols as bytes of one number, blanks before a word's start
            coded, lasts = symbol.astype(np.uint64), np.zeros(len(symbol), dtype=np.uint64)
            for k in range(1, LASTS + 1):
                earlier = coded[:-k] if k < len(coded) else coded[:0]
                inside = place[k:] >= k
                lasts[k:] |= np.where(inside, earlier, np.uint64(BLANK)) << np.uint64(8 * (k - 1))
                lasts[:k] |= np.uint64(BLANK << (8 * (k - 1)))
            prefix = np.where(place < DEEP, prefix, mixed(lasts + SPREAD))
            behind = np.where(place < EARLY, prefix + np.repeat(before, sizes + 1) * SPREAD, lasts & np.uint64((1 << 40) - 1))
            behind = mixed(behind + np.uint64(5))
            step = np.where(place < EARLY, behind, prefix) ^ mixed(np.arange(256, dtype=np.uint64) + np.uint64(7))[symbol]
        self.step_of, at = _distinct(step)
        self.offsets = offsets
        self.symbol = symbol[at]
        self.contexts = [mixed((lasts[at] & np.uint64((1 << (8 * k)) - 1)) + np.uint64(k << 40)) for k in range(1, 5)]
        self.contexts += [prefix[at], behind[at]]

    def step_count(self, times: np.ndarray) -> np.ndarray:
        """How often each step is taken if the pairs occur so often."""
        sizes = np.diff(np.append(self.offsets, len(self.step_of)))
        return np.bincount(self.step_of, weights=np.repeat(times, sizes), minlength=len(self.symbol))

    def bits(self, codes: np.ndarray, lengths: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each depth of the code tree: steps, their bit, and a cell for each context."""
        code, length, table_starts = codes[self.symbol], lengths[self.symbol], starts_of(sizes)
        for depth in range(int(length.max())):
            rows = np.flatnonzero(length > depth)
            own = code[rows]
            node = (np.uint64(1 << depth) | (own >> np.uint64(64 - depth))) if depth else np.ones(len(rows), dtype=np.uint64)
            bit = ((own >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)
            with np.errstate(over="ignore"):
                salt = node * SPREAD
                cells = [
                    (((c[rows] ^ salt) * SPREAD) >> np.uint64(64 - s)).astype(np.int64) + start
                    for c, s, start in zip(self.contexts, sizes, table_starts)
                ]
            yield rows, bit, cells

    def per_pair(self, per_step: np.ndarray) -> np.ndarray:
        """Sums of the pairs' steps."""
        return np.add.reduceat(per_step[self.step_of], self.offsets)


def starts_of(sizes: tuple[int, ...]) -> np.ndarray:
    """First cell of each context's table, and the number of all cells."""
    return np.concatenate([[0], np.cumsum([1 << s for s in sizes])]).astype(np.int64)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Spelling, pa.Table]]:
    """Pairs of a task in runs, bounded by their number and by their bytes."""
    waiting, rows, size = [], 0, 0
    for batch in batches:
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PAIRS or size >= 16 * RUN:
            yield _spelling(waiting)
            waiting, rows, size = [], 0, 0
    if rows:
        yield _spelling(waiting)


def _spelling(batches: list[pa.RecordBatch]) -> tuple[Spelling, pa.Table]:
    pairs = pa.Table.from_batches(batches).combine_chunks()
    return Spelling(pairs.column("word").chunk(0), pairs.column("before").to_numpy()), pairs


def _gate(behind: np.ndarray, word: np.ndarray, four: np.ndarray) -> np.ndarray:
    """One number for the count classes of the three contexts."""
    return (behind * (len(SEEN_WORD) + 1) + word) * (len(SEEN_FOUR) + 1) + four


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def _map_class(mix: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(mix, -8, 8) + 8) * ((MAP - 1) / 16)).astype(np.int64)


class Model:
    """Code tree, counts, weights and refining map."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray, sizes: tuple[int, ...]):
        self.codes, self.lengths, self.counts, self.sizes = codes, lengths, counts, sizes
        self.weights, self.batches = np.full((GATES, len(SIZES)), 0.25), 0
        self.map = _squash(np.tile(np.linspace(-8, 8, MAP), (GATES, 1)))
        self._cells: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        """Counts travel packed, in slices that are opened one by one."""
        flat, step = self.counts.ravel(), 1 << 20
        return self.__dict__ | {"counts": [packed(flat[a : a + step]) for a in range(0, len(flat), step)], "kind": self.counts.dtype.str, "_cells": None}

    def __setstate__(self, state: dict) -> None:
        slices, kind = state.pop("counts"), state.pop("kind")
        self.__dict__.update(state)
        self.counts, at = np.empty((int(starts_of(self.sizes)[-1]), 2), dtype=kind), 0
        for planes in slices:
            some = unpacked(planes, kind)
            self.counts.reshape(-1)[at : at + len(some)] = some
            at += len(some)

    def log10(self, spelling: Spelling) -> np.ndarray:
        """log10 of the probability of each step."""
        out = np.zeros(len(spelling.symbol))
        if self._cells is None:  # once per worker
            soft, seen = np.float32(SOFT), np.zeros(len(self.counts), dtype=np.uint8)
            starts = starts_of(self.sizes)
            for i, ends in ((3, SEEN_FOUR), (4, SEEN_WORD), (5, SEEN_BEHIND)):
                part = slice(starts[i], starts[i + 1])
                seen[part] = np.searchsorted(ends, self.counts[part].sum(axis=1, dtype=np.int64))
            self._cells = np.log((self.counts[:, 1] + soft) / (self.counts[:, 0] + soft)), seen
        stretch, seen = self._cells
        for rows, bit, cells in spelling.bits(self.codes, self.lengths, self.sizes):
            gate = _gate(*[seen[c].astype(np.int64) for c in (cells[5], cells[4], cells[3])])
            mix = np.zeros(len(rows))
            for i, c in enumerate(cells):
                mix += self.weights[gate, i] * stretch[c]
            p = (_squash(mix) + self.map[gate, _map_class(mix)]) / 2
            out[rows] += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def learn(self, spelling: Spelling, times: np.ndarray, hits: np.ndarray) -> None:
        """One online pass over the steps; ``times`` says how often each is taken.

        ``hits`` (gate, class of the map, bit) collects what followed.
        """
        for rows, bit, cells in spelling.bits(self.codes, self.lengths, self.sizes):
            used = np.flatnonzero(times[rows])
            for at in range(0, len(used), MIX_BATCH):
                some = used[at : at + MIX_BATCH]
                own, m = bit[some], times[rows[some]]
                inputs = np.empty((len(some), len(SIZES)))
                totals = []
                for i, c in enumerate(cells):
                    n = self.counts[c[some]].astype(np.float64)
                    n[np.arange(len(some)), own] = np.maximum(n[np.arange(len(some)), own] - 1, 0)  # without itself
                    inputs[:, i] = np.log((n[:, 1] + SOFT) / (n[:, 0] + SOFT))
                    totals.append(n.sum(axis=1))
                gate = _gate(*[np.searchsorted(e, totals[i]) for i, e in ((5, SEEN_BEHIND), (4, SEEN_WORD), (3, SEEN_FOUR))])
                mix = (self.weights[gate] * inputs).sum(axis=1)
                place = (gate * MAP + _map_class(mix)) * 2 + own
                hits += np.rint(np.bincount(place, weights=m, minlength=hits.size)).astype(np.int64).reshape(hits.shape)
                error = (own - _squash(mix)) * m
                slope = np.stack([np.bincount(gate, weights=error * inputs[:, i], minlength=GATES) for i in range(len(SIZES))], axis=1)
                size = 1 + np.bincount(gate, weights=m * (1 + (inputs * inputs).sum(axis=1) / 4), minlength=GATES)
                self.weights += (0.2 + 0.7 / (1 + self.batches / 8)) * slope / size[:, None]
                self.batches += 1


def fitted(pairs: DataFrame) -> Model:
    """The model of all pairs; ``pairs`` has (word, before, n) and each pair once."""
    learnt = pairs.filter("n > 0").select("word", "before", "n")
    spark = pairs.sparkSession
    sizes = table_sizes(learnt.count())
    cells = int(starts_of(sizes)[-1])

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(256, dtype=np.int64)
        for spelling, some in _spelled(batches):
            times = spelling.step_count(some.column("n").to_numpy())
            table += np.rint(np.bincount(spelling.symbol, weights=times, minlength=256)).astype(np.int64)
        return table

    codes, lengths = code_tree(added_up(learnt, count_bytes, 256))

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Counts:
        table = Counts(2 * cells)
        for spelling, some in _spelled(batches):
            times = np.rint(spelling.step_count(some.column("n").to_numpy())).astype(np.int64)
            for rows, bit, contexts in spelling.bits(codes, lengths, sizes):
                for c in contexts:
                    table.add(2 * c + bit, times[rows])
        return table

    counts = added_up(learnt, count_bits, 2 * cells).reshape(cells, 2)
    large = np.flatnonzero((counts[:, 0] > 65535) | (counts[:, 1] > 65535))
    excess = np.ceil(np.log2((counts[large].max(axis=1) + 1) / 65536)).astype(np.int64)
    counts[large] >>= excess[:, None]
    counts = counts.astype(np.uint16)
    shared = spark.sparkContext.broadcast(Model(codes, lengths, counts, sizes))  # 4 bytes for each cell in a worker, see table_sizes

    def learn_weights(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        model, hits, n = Model(codes, lengths, shared.value.counts, sizes), np.zeros((GATES, MAP, 2), dtype=np.int64), 0
        for spelling, some in _spelled(batches):
            times = spelling.step_count(some.column("n").to_numpy())
            model.learn(spelling, times, hits)
            n += some.num_rows
        # weights count by the pairs they were learnt from
        return np.concatenate([np.rint(model.weights.ravel() * n * FIXED).astype(np.int64), hits.ravel(), [n]])

    size = GATES * len(SIZES)
    found = added_up(learnt, learn_weights, size + GATES * MAP * 2 + 1)
    shared.destroy()
    model = Model(codes, lengths, counts, sizes)
    if found[-1]:
        model.weights = (found[:size] / FIXED / found[-1]).reshape(GATES, len(SIZES))
    hits = found[size:-1].reshape(GATES, MAP, 2)
    # the map starts as the identity, as if seen 50 times
    model.map = np.clip((hits[:, :, 1] + 50 * model.map) / (hits.sum(axis=2) + 50), 1e-5, 1 - 1e-5)
    return model


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of equal bytes, packed."""
    return packed(numbers.astype("<u4"))


def _numbers(planes: bytes) -> np.ndarray:
    return unpacked(planes, "<u4")


def _rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the listing; columns that are not named are null."""
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
         ("n_bytes", pa.list_(pa.int64())), ("places", pa.binary()), ("range", pa.int64()), ("start", pa.int64()), ("words", pa.binary()),
         ("marks", pa.binary()), ("n", pa.binary())]
    )
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)


Run = tuple[Pairs, list[tuple]]  # the pairs of a run of rows (doc_id, text, held_out, learnt)


def _block(block: int, runs: list[Run], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of the documents and of the parts of the list of one block."""
    number, first = _distinct(np.concatenate([pairs.keys for pairs, _ in runs]))
    hashes = np.concatenate([pairs.hashes for pairs, _ in runs])[first]
    before = np.concatenate([pairs.before for pairs, _ in runs])[first]
    within = (hashes >> np.uint64(20)) % np.uint64(ranges)
    number_of = np.split(number, np.cumsum([len(pairs.keys) for pairs, _ in runs])[:-1])
    seen = np.zeros(len(first), dtype=np.int64)
    for (pairs, _), numbers in zip(runs, number_of):
        seen += np.bincount(numbers[pairs.number], minlength=len(seen))
    rare = len(OFTEN) - np.searchsorted(OFTEN, seen, side="right")
    order = np.lexsort((before, hashes, within, rare))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    n = np.zeros(len(first), dtype=np.int64)
    for (pairs, docs), numbers in zip(runs, number_of):
        at = rank[numbers][pairs.number]
        n += np.bincount(at[np.repeat(np.array([d[3] for d in docs], dtype=bool), pairs.words_of)], minlength=len(n))
        after = np.cumsum(pairs.words_of)
        cuts = np.flatnonzero(np.diff(after // TOGETHER)) + 1  # documents that begin a row
        limits = np.concatenate([[0], cuts, [len(docs)]]).astype(np.int32)
        rows = lambda values, kind: pa.ListArray.from_arrays(pa.array(limits), pa.array(values, kind))
        yield _rows(
            len(limits) - 1, block=pa.array(np.full(len(limits) - 1, block)), doc_id=rows([d[0] for d in docs], pa.int64()),
            held_out=rows([d[2] for d in docs], pa.bool_()), n_tokens=rows(pairs.words_of, pa.int64()), n_bytes=rows(pairs.bytes_of, pa.int64()),
            places=pa.array([_planes(t) for t in np.split(at, after[cuts - 1])], pa.binary()),
        )
    hashes, before, within, rare = hashes[order], before[order], within[order].astype(np.int64), rare[order]
    turns = np.concatenate([[True], (within[1:] != within[:-1]) | (rare[1:] != rare[:-1])])
    fresh = turns | np.concatenate([[True], hashes[1:] != hashes[:-1]])
    words = pa.concat_arrays([pairs.words for pairs, _ in runs])
    starts = np.flatnonzero(turns)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(within)]):
        own = words.take(pa.array(first[order[a:b]][fresh[a:b]]))
        yield _rows(
            1, block=pa.array([block]), range=pa.array([int(within[a])]), start=pa.array([a]),
            words=pa.array([zlib.compress(b"".join(w + b"\n" for w in own.to_pylist()), 1)], pa.binary()),
            marks=pa.array([packed(before[a:b] * np.uint8(2) + fresh[a:b])], pa.binary()), n=pa.array([_planes(n[a:b])], pa.binary()),
        )


def lister(ranges: int):
    """Cuts a task's rows (doc_id, text, held_out, learnt) into blocks and lists them."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, runs, run, size, in_block = TaskContext.get().partitionId() << 31, [], [], 0, 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                run.append(row)
                size += len(row[1] or "")
                if size >= RUN:
                    runs.append((Pairs([r[1] for r in run]), [(r[0], None, r[2], r[3]) for r in run]))
                    in_block, run, size = in_block + size, [], 0
                if in_block >= BLOCK:
                    yield from _block(block, runs, ranges)
                    block, runs, in_block = block + 1, [], 0
        if run:
            runs.append((Pairs([r[1] for r in run]), [(r[0], None, r[2], r[3]) for r in run]))
        if runs:
            yield from _block(block, runs, ranges)

    return listed


class Merged:
    """The pairs of all parts of one range.

    ``pair`` is the pair of each entry, part by part; ``n`` and ``c`` count the training
    occurrences of each pair and of its word, ``leads`` marks one pair of each word.
    """

    def __init__(self, parts: pa.Table):
        data = b"".join(zlib.decompress(x) for x in parts.column("words").to_pylist())
        whole = np.frombuffer(data, dtype=np.uint8)
        ends = np.flatnonzero(whole == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        word, _ = _distinct(range_hashes(whole, starts, classes(False)))
        marks = [unpacked(x, np.uint8) for x in parts.column("marks").to_pylist()]
        self.sizes, marks = [len(x) for x in marks], np.concatenate(marks)
        fresh, before = marks & np.uint8(1), marks >> np.uint8(1)
        n = np.concatenate([_numbers(x) for x in parts.column("n").to_pylist()])
        at = np.cumsum(fresh, dtype=np.int64) - 1
        self.pair, first = _distinct(word[at] * (KINDS + 1) + before)
        self.n = np.rint(np.bincount(self.pair, weights=n, minlength=len(first))).astype(np.int64)
        own = word[at[first]]
        self.c = np.rint(np.bincount(own, weights=self.n)).astype(np.int64)[own]
        self.leads = np.zeros(len(first), dtype=np.int64)
        self.leads[_distinct(own)[1]] = 1
        self.before = before[first].astype(np.int32)
        self.words = pa.array([data[a:b] for a, b in zip(starts[at[first]].tolist(), ends[at[first]].tolist())], pa.binary())


def added(parts: pa.Table) -> pa.Table:
    """(word, before, n, known) of a range; ``known`` is 1 for one pair of each word with a count."""
    merged = Merged(parts)
    known = merged.leads * (merged.c > 0)
    return pa.table({"word": merged.words, "before": pa.array(merged.before), "n": pa.array(merged.n), "known": pa.array(known)})


def scored(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, base score and model score."""
    spark = docs.sparkSession
    small_batches(spark)
    fold = remainder(F.col(id_column), FOLDS)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
                       F.coalesce(fold != HELD_OUT, F.lit(False)).alias("learnt"))
    characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    found = stored(rows.mapInArrow(tidy(lister(max(1, -(-characters // BLOCK)))), _LISTED), "model-lists")
    parts = found.filter("range is not null").select("block", "range", "start", "words", "marks", "n")
    pairs = parts.groupBy("range").applyInArrow(added, "word binary, before int, n long, known long")
    pairs = stored(pairs, "model-pairs", compression="zstd")
    tokens, distinct = (x or 0 for x in pairs.agg(F.sum("n"), F.sum("known")).first())
    each = math.log10(tokens + distinct + 1)
    model = spark.sparkContext.broadcast(fitted(pairs))

    def price(some: pa.Table) -> pa.Table:
        merged = Merged(some)
        log = np.zeros(len(merged.words), dtype=np.float32)
        for at in range(0, len(log), PAIRS):
            spelling = Spelling(merged.words[at : at + PAIRS], merged.before[at : at + PAIRS])
            log[at : at + PAIRS] = spelling.per_pair(model.value.log10(spelling))
        entries = np.split(merged.pair, np.cumsum(merged.sizes)[:-1])
        return pa.table(
            {
                "home": some.column("block"), "start": some.column("start"),
                "c": pa.array([packed(merged.c[e]) for e in entries], pa.binary()),
                "log": pa.array([packed(log[e]) for e in entries], pa.binary()),
            }
        )

    prices = parts.groupBy("range").applyInArrow(price, "home long, start long, c binary, log binary")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        # a block's parts follow one another from place 0
        by_start = np.argsort(right.column("start").to_numpy())
        c, log = (
            np.concatenate([unpacked(x, kind) for x in right.column(name).take(pa.array(by_start)).to_pylist()]).astype(np.float64)
            for name, kind in (("c", np.int64), ("log", np.float32))
        )
        base, n_known, known_log, score = np.log10(c + 1), [], [], []
        for planes, words in zip(left.column("places"), left.column("n_tokens")):
            for at in np.split(_numbers(planes.as_py()), np.cumsum(words.values.to_numpy())[:-1]):
                n_known.append(int(np.count_nonzero(c[at])))
                known_log.append(float(base[at].sum()))
                score.append(float(log[at].sum()))
        columns = {name: pc.list_flatten(left.column(name)) for name in ("doc_id", "held_out", "n_tokens", "n_bytes")}
        columns |= {"n_known": pa.array(n_known, pa.int64()), "known_log": pa.array(known_log, pa.float64()), "score": pa.array(score, pa.float64())}
        return pa.table({name: columns[name] for name in ("doc_id", "held_out", "n_tokens", "n_known", "known_log", "score", "n_bytes")})

    texts = found.filter("places is not null").select("block", "doc_id", "held_out", "n_tokens", "n_bytes", "places")
    sums = texts.groupBy("block").cogroup(prices.groupBy("home")).applyInArrow(add, _RESULT)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * each).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 1, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op8_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
