"""Encoding and decoding with a merge-type SentencePiece vocabulary.

A text becomes symbols (its characters, spaces as the vocabulary's space mark, one
mark put in front). An agenda holds the adjacent pairs whose union is a piece, best
score first and leftmost on ties; the best pair is merged and its new neighbours
join the agenda, until none is left. Symbols without a piece become their bytes.

Two neighbouring characters that no piece holds side by side can never be merged,
so a text is cut where the vocabulary proves that, and equal parts are encoded once
per worker. Every part that is new in an Arrow batch is checked against the
sentencepiece library; a difference is an error. The vocabulary must keep texts as
they are (identity normalisation, no user-defined pieces), which is checked too.

A null text counts as empty and gives no ids. Rows are handled one by one, so
repeated rows, null ids and further columns are safe; the query returns its own
columns only. Memory is bounded by the batch and by ``KEPT_PARTS`` parts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cashtrail.llm.common import documents, small_batches, tidy

MARK = "▁"  # stands for a space in pieces
KEPT_PARTS = 500_000  # parts that a worker remembers
LONG_PART = 40  # longer parts are merged one by one
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Pieces, scores and cuts of a model file; one per worker and path."""

    _loaded: dict[str, Vocabulary] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.texts = [str(i) for i in range(n)]
        if not all(sp.is_byte(i) for i in self.bytes) or sp.decode(sp.encode(" a  b")) != " a  b":
            raise ValueError("the vocabulary needs byte pieces and must keep texts as they are")
        self.splitter = re.compile(self._cuts())
        self.known: dict[str, tuple[int, ...]] = {}
        self.lists: dict[str, str] = {}  # the same ids as text
        self._pair_table()

    def _pair_table(self) -> None:
        """All pairs of symbols whose union is a piece, with its number and score."""
        symbols = list(self.ids)
        symbols += sorted({c for p in symbols for c in p}.difference(self.ids))
        number = {s: i for i, s in enumerate(symbols)}
        self.symbol_count = len(symbols)
        self.symbol_ids = np.array([self.ids.get(s, -1) for s in symbols])
        self.symbols = symbols
        self.character = {c: i for c, i in number.items() if len(c) == 1}
        pairs = [
            (number[p[:k]] * self.symbol_count + number[p[k:]], number[p], self.scores[p])
            for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number
        ]
        keys = np.array([x[0] for x in pairs])
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_merged = np.array([x[1] for x in pairs])[order]
        self.pair_scores = np.array([x[2] for x in pairs])[order]

    def _cuts(self) -> str:
        """Pattern of the parts of a text (with marks for spaces) that are encoded by themselves.

        Cuts lie before a mark that follows another character, around signs that stand
        in no longer piece, and between a letter and a sign that no piece holds so.
        """
        longer = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("the vocabulary has pieces across spaces")
        used = {c for p in longer for c in p}
        signs = [chr(c) for c in range(128) if not chr(c).isalnum()]
        lone = "".join(re.escape(c) for c in signs if c not in used)
        behind = {b for p in longer for a, b in zip(p, p[1:]) if a.isalpha()}
        apart = "".join(re.escape(c) for c in signs if c in used and c not in behind)
        plain = f"[^{MARK}{lone}{apart}]"
        body = f"{plain}*(?:(?<![^\\W\\d_])[{apart}]{plain}*)*"
        return f"[{lone}]|{MARK}+{body}|{plain}{body}|[{apart}]{body}"

    def merged(self, part: str) -> tuple[int, ...]:
        """The ids of one part, by the agenda."""
        symbols: list[str] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores, agenda = self.scores, []

        def add(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            score = scores.get(pair)
            if score is not None:
                heapq.heappush(agenda, (-score, left, pair))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left] if symbols[left] else n
            # stale unless both sides still are what they were when the pair was added
            if right >= n or len(symbols[left]) + len(symbols[right]) != len(pair) or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                add(left, following)
            if before[left] >= 0:
                add(before[left], left)
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                i = self.ids.get(symbol)
                out.extend([i] if i is not None else [self.bytes[b] for b in symbol.encode()])
        return tuple(out)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and score of the union of neighbours; the score is -inf without one."""
        keys = left * self.symbol_count + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        fits = (self.pair_keys[at] == keys) & (left < self.symbol_count) & (right < self.symbol_count)
        return self.pair_merged[at], np.where(fits, self.pair_scores[at], -np.inf)

    def merged_together(self, parts: list[str]) -> list[tuple[int, ...]]:
        """``merged`` for parts of one length: each keeps its agenda as a row of pair scores.

        A step merges the best pair of every row, leftmost on ties, so all rows
        that go on stay equally long.
        """
        n, length = len(parts), len(parts[0])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        # an unknown character merges with nothing and is named by its code point
        named = np.array([self.character.get(chr(p), self.symbol_count + int(p)) for p in kinds.tolist()])
        rows, line = named[inverse].reshape(n, length), np.arange(n)
        merged, scores = self._pairs(rows[:, :-1], rows[:, 1:])
        out: list[tuple[int, ...]] = [()] * n
        while True:
            best = scores.argmax(axis=1) if length > 1 else np.zeros(len(rows), dtype=np.int64)
            goes_on = scores[np.arange(len(rows)), best] > -np.inf if length > 1 else np.zeros(len(rows), dtype=bool)
            done = np.flatnonzero(~goes_on)
            ended = rows[done]
            ids = np.where(ended < self.symbol_count, self.symbol_ids[np.minimum(ended, self.symbol_count - 1)], -1)
            for i, found, row, plain in zip(line[done].tolist(), ids.tolist(), ended, (ids >= 0).all(axis=1).tolist()):
                out[i] = tuple(found) if plain else self._written(row.tolist())
            if len(done) == len(rows):
                return out
            if len(done):
                rows, line, merged, scores, best = (x[goes_on] for x in (rows, line, merged, scores, best))
            each = np.arange(len(rows))
            new = merged[each, best]
            length -= 1
            place = np.arange(length)
            rows = np.take_along_axis(rows, place + (place > best[:, None]), axis=1)
            rows[each, best] = new
            place = place[: length - 1]
            kept = np.minimum(place + (place >= best[:, None]), length - 1)
            merged, scores = np.take_along_axis(merged, kept, axis=1), np.take_along_axis(scores, kept, axis=1)
            for left in (best - 1, best):
                some = np.flatnonzero((left >= 0) & (left + 1 < length))
                at = left[some]
                merged[some, at], scores[some, at] = self._pairs(rows[some, at], rows[some, at + 1])

    def _written(self, row: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        for s in row:
            i = int(self.symbol_ids[s]) if s < self.symbol_count else -1
            text = self.symbols[s] if s < self.symbol_count else chr(s - self.symbol_count)
            out.extend([i] if i >= 0 else [self.bytes[b] for b in text.encode()])
        return tuple(out)

    def parts(self, text: str) -> list[str]:
        return self.splitter.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, parts: set[str]) -> None:
        """Encode the parts not yet known and check them against the library."""
        if len(self.known) > KEPT_PARTS:
            self.known, self.lists = {}, {}
        new = sorted(parts.difference(self.known), key=len)
        if not new:
            return
        own: list[tuple[int, ...]] = []
        for length, same in groupby(new, key=len):
            same = list(same)
            own += [self.merged(p) for p in same] if length > LONG_PART else self.merged_together(same)
        # The library puts a mark in front of every text: parts that start with one go
        # without it, the others behind a character that merges with nothing.
        fence = self._fence_ids()
        asked = [p[1:].replace(MARK, " ") if p[0] == MARK else "\n" + p for p in new]
        for part, ids, said in zip(new, own, self.library.encode(asked, num_threads=1)):
            if list(ids) != (said if part[0] == MARK else said[fence:]) and part != MARK:
                raise ValueError(f"the library encodes {part[:80]!r} otherwise")
        self.known.update(zip(new, own))
        self.lists.update(zip(new, [",".join([self.texts[i] for i in ids]) for ids in own]))

    def _fence_ids(self) -> int:
        return len(self.library.encode("\n"))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of the texts of one Arrow batch, as numbers and as a list in a text.

        Runs of texts are learnt together.
        """
        group, size = [], 0
        for text in chain(texts, [None]):
            if text is not None:
                group.append(self.parts(text))
                size += len(group[-1])
            if text is None or size > 200_000:
                self.learn(set(chain.from_iterable(group)))
                ids, lists = self.known.__getitem__, self.lists.__getitem__
                for parts in group:
                    yield list(chain.from_iterable(map(ids, parts))), ",".join(map(lists, parts))
                group, size = [], 0


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded text) of every document."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [i for i, _ in vocabulary.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([vocabulary.library.decode(i) for i in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select(id_column, text).mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of ids and the digests of ids and decoded text, without handing the ids on."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        decode = vocabulary.library.decode
        for batch in batches:
            counts, hashes, decoded = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for ids, listed in vocabulary.encode_batch(texts):
                counts.append(len(ids))
                hashes.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_column, text).mapInArrow(tidy(run), RESULT)


def op1_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
