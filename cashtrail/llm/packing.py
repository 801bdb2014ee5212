"""Packing of token streams into sequences, in document order.

The documents of an input partition, in their order, form one stream of tokens. It
may be cut after a document, after a sentence, and inside a sentence only where the
sentence is longer than a sequence. Dynamic programming over these places finds the
cuts with the least sum of padding and penalties: with p the position of a place,

    best[j] = penalty[j] + min over i of best[i] + OPENING + padding(p[j] - p[i])

Padding is the rest of the sequence, so the minimum over all i within one sequence
length is the least best[i] + p[i] in a sliding window, which a monotone queue
holds. Lengths that are a power of two need no padding; these few predecessors are
looked up beside the queue. The stream is worked off in stretches, and the last
sequences of a stretch are packed again with the next one, so memory is bounded by
the stretch and one document. Nothing is shuffled; a lost task reads its split again.

A null text counts as empty and gives the end id alone. Repeated rows and ids and
null ids are pieces of their own; further columns are not carried through.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cashtrail.llm.common import documents, small_batches, tidy
from cashtrail.llm.hashed import classes, joined, range_hashes, word_ranges

LENGTH = 2048
END_ID = 1
STRETCH = 1 << 19  # tokens that are planned together
OPENING = 24  # price of a sequence beside its padding, in tokens
SENTENCE_CUT, FORCED_CUT = 12, 400  # price of a cut inside a document
FORCED_STEP = 64
KEPT_STEMS = 1_000_000
PER_CALL = 500  # stems the tokenizer gets as one text
RUN = 2_000_000  # characters whose equal words are looked up once
MARKS = (",", ".")
PROBE = "Ab, cD.\tef  GH\nThe end of 12 x's"
MARK_BYTES = np.frombuffer("".join(MARKS).encode(), dtype=np.uint8)  # in order
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of a tokenizer that lower-cases and never looks across a space or line end.

    Every word is a stem and perhaps a mark behind it: a mark behind a letter, at the
    end of a word, is a token of its own. Equal stems of a run of texts are looked up
    once, by their 64-bit hash; the ids of at most about ``KEPT_STEMS`` stems are
    remembered, in arrays of some 40 bytes a stem, for all tasks of a worker.
    """

    _loaded: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = (".", "!", "?", "…", "。", "！", "？")
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for word in ends:
            for ids in self._encode([word, f'{word}"', f"{word})", word * 2, word * 3]):
                if len(ids) == 1:
                    self.sentence_ends[ids[0]] = True
        marks = self._encode(list(MARKS))
        if any(len(ids) != 1 for ids in marks):
            raise ValueError("a mark must be one token")
        self.marks = np.array([0, *[ids[0] for ids in marks]], dtype=np.uint32)
        whole, apart = self._encode([PROBE])[0], self._encode(PROBE.lower().split())
        if whole != list(chain.from_iterable(apart)):
            raise ValueError("the tokenizer keeps case or looks across blanks")
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # hashes of the stems, ascending
        self.rows = np.zeros(0, dtype=np.int64)  # their places in the tables
        self.starts = np.zeros(0, dtype=np.int64)  # of each stem, in the ids
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_many(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stems and how many each has; the stems hold no comma, which stands between them."""
        ids, sizes = [], []
        runs = [stems[at : at + PER_CALL] for at in range(0, len(stems), PER_CALL)]
        for run, found in zip(runs, self._encode([f" {MARKS[0]} ".join(run) for run in runs])):
            all_ids = np.array(found, dtype=np.uint32)
            between = np.flatnonzero(all_ids == self.marks[1])
            if len(between) != len(run) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            sizes.append(np.diff(np.concatenate([[-1], between, [len(all_ids)]])) - 1)
            ids.append(np.delete(all_ids, between))
        return np.concatenate(ids or [self.ids[:0]]), np.concatenate(sizes or [self.sizes[:0]])

    def _learn(self, hashes: np.ndarray, stems: list[str]) -> None:
        """Take new stems into the tables."""
        # ASCII and Latin letters keep to themselves ("\u0130" is no single letter in lower case)
        many = [
            MARKS[0] not in s and "<|" not in s if s.isascii() else s.isalpha() and max(s) < "\u0250" and "\u0130" not in s
            for s in stems
        ]
        ids, sizes = self._encode_many([s for s, m in zip(stems, many) if m])
        one_by_one = self._encode([s for s, m in zip(stems, many) if not m])
        sizes = np.concatenate([sizes, np.fromiter(map(len, one_by_one), dtype=np.int64, count=len(one_by_one))])
        ids = np.concatenate([ids, np.array(list(chain.from_iterable(one_by_one)), dtype=np.uint32)])
        many = np.array(many, dtype=bool)
        hashes = np.concatenate([hashes[many], hashes[~many]])
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.rows = np.insert(self.rows, at, len(self.rows) + order)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or would stand among the known ones, and if it does."""
        at = np.searchsorted(self.known, hashes)
        there = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.known)
        there[inside] = self.known[at[inside]] == hashes[inside]
        return at, there

    def batch(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        group, size = [], 0
        for text in chain(texts, [None]):
            if text is not None:
                group.append(text)
                size += len(text)
            if (text is None and group) or size > RUN:
                yield from self._ids_of(group)
                group, size = [], 0

    def _ids_of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT_STEMS:
            self.forget()
        special = any("<|" in t for t in texts)  # names of special tokens are not lower-cased
        whole, text_ends = joined(texts, lower=not special)
        starts, ends = word_ranges(whole)
        words_of = np.diff(np.searchsorted(starts, text_ends), prepend=0)
        last = np.maximum(ends - 1, 1)
        before, further = whole[last - 1], whole[np.maximum(last - 2, 0)]
        letter = (before >= 97) & (before <= 122) | (further == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        marks = np.searchsorted(MARK_BYTES, whole[last]) + 1
        marks = np.where(letter & (ends - starts > 1) & np.isin(whole[last], MARK_BYTES) & (not special), marks, 0)
        marked = np.flatnonzero(marks)
        stems = whole.copy()
        stems[ends[marked] - 1] = 32
        word, distinct = pd.factorize(range_hashes(stems, starts, classes(False)))
        at, there = self._places(distinct)
        fresh = np.flatnonzero(~there)
        if len(fresh):
            first = np.zeros(len(distinct), dtype=np.int64)
            first[word[::-1]] = np.arange(len(word))[::-1]
            first = first[fresh]
            data = stems.tobytes()
            stops = (ends - (marks > 0))[first].tolist()
            self._learn(distinct[fresh], [data[a:b].decode() for a, b in zip(starts[first].tolist(), stops)])
            at, _ = self._places(distinct)
        rows = self.rows[at]
        rows = rows[word]
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes + (marks > 0))
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[ends[marked] - 1] = False
        before = np.cumsum(sizes) - sizes
        out[inside] = self.ids[np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - before, sizes)]
        out[ends[marked] - 1] = self.marks[marks[marked]]
        return np.split(out, np.append(0, ends)[np.cumsum(words_of)][:-1])


def cut_places(lengths: np.ndarray, inner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut and the price of each, from 0 to the end.

    ``lengths`` are the tokens of each document, ``inner`` the positions after sentences.
    """
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    places = np.unique(np.concatenate([[0], inner[(inner > 0) & (inner < total)], ends]).astype(np.int64))
    cost = np.full(len(places), SENTENCE_CUT, dtype=np.int64)
    cost[np.searchsorted(places, ends)] = 0
    cost[0] = 0
    gaps = np.flatnonzero(np.diff(places) > length)
    if len(gaps):
        extra = [np.arange(places[g] + FORCED_STEP, places[g + 1], FORCED_STEP) for g in gaps]
        # a whole sequence can also be cut from either side of the gap
        extra += [np.arange(places[g] + length, places[g + 1], length) for g in gaps]
        forced = np.setdiff1d(np.concatenate(extra), places)
        order = np.argsort(np.concatenate([places, forced]), kind="stable")
        cost = np.concatenate([cost, np.full(len(forced), FORCED_CUT, dtype=np.int64)])[order]
        places = np.concatenate([places, forced])[order]
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indexes of the chosen places, first and last included."""
    p, c = places.tolist(), cost.tolist()
    n = len(p)
    best, back = [0] * n, [0] * n
    # (j, i) where the length from i to j is a power of two, by j
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    pairs = []
    for power in powers:
        at = np.minimum(np.searchsorted(places, places - power), n - 1)
        fits = np.flatnonzero(places[at] == places - power)
        pairs.append(np.stack([fits, at[fits]], axis=1))
    exact = np.concatenate(pairs)
    exact = exact[np.argsort(exact[:, 0], kind="stable")]
    firsts = np.searchsorted(exact[:, 0], np.arange(n + 1)).tolist()
    exact_from = exact[:, 1].tolist()
    keys = [0] * n  # best[i] + p[i]
    queue: deque[int] = deque([0])
    keys[0] = p[0]
    for j in range(1, n):
        here = p[j]
        least = here - length
        while p[queue[0]] < least:
            queue.popleft()
        came = queue[0]
        value = keys[came] + length - here
        for i in exact_from[firsts[j] : firsts[j + 1]]:
            if best[i] < value:
                value, came = best[i], i
        value += OPENING + c[j]
        best[j], back[j] = value, came
        key = keys[j] = value + here
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class _Stream:
    """Documents waiting for their sequences."""

    def __init__(self, first_sequence: int, length: int):
        self.docs: list[list] = []  # doc_id, all ids, start of what waits
        self.waiting = 0
        self.sequence = first_sequence
        self.length = length

    def add(self, doc_id, ids: np.ndarray, inner: np.ndarray) -> None:
        self.docs.append([doc_id, ids, 0, inner])
        self.waiting += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the sequences that are settled."""
        lengths = np.array([len(d[1]) - d[2] for d in self.docs], dtype=np.int64)
        if not len(lengths):
            return []
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        inner = np.concatenate([d[3][d[3] > d[2]] - d[2] + s for d, s in zip(self.docs, starts)])
        places, cost = cut_places(lengths, inner, self.length)
        cuts = places[best_cuts(places, cost, self.length)]
        if not last and len(cuts) > 8:
            cuts = cuts[:-4]  # the end of the stretch is no end of the stream
        out, d, used = [], 0, 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            offset, left = 0, b - a
            while left:
                doc_id, ids, start, _ = self.docs[d]
                take = min(left, len(ids) - start)
                piece = ids[start : start + take]
                out.append((doc_id, start, take, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.sequence, offset, piece))
                offset, left = offset + take, left - take
                self.docs[d][2] += take
                if self.docs[d][2] == len(ids):
                    d += 1
            self.sequence += 1
            used = b
        self.docs = self.docs[d:]
        self.waiting -= used
        return out


def packed(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", length: int = LENGTH,
           with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence; ``with_ids`` adds the ids.

    ``sequence_id`` holds the number of the input partition in its upper bits.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(path)
        stream = _Stream(TaskContext.get().partitionId() << 40, length)

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            found = stream.flush(last)
            if found:
                columns = list(zip(*found))
                arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in columns[7]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            texts = (t or "" for t in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.batch(texts)):
                inner = np.flatnonzero(tokens.sentence_ends[ids]) + 1
                stream.add(doc_id, np.append(ids, np.uint32(END_ID)), inner)
                if stream.waiting >= STRETCH:
                    yield from rows(last=False)
        yield from rows(last=True)

    return docs.select(id_column, text).mapInArrow(tidy(run), RESULT + (", ids array<int>" if with_ids else ""))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
