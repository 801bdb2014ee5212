"""64-bit hashes of the words of many texts at once, in NumPy.

A word's hash is a polynomial of random numbers for its bytes, mixed at the end.
The constants are fixed, so every worker gets the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP = 1 << 18  # bytes hashed together; a longer text is a group by itself

_draw = np.random.default_rng(64)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(_draw.integers(1, 1 << 62) * 4 + 3)
_PLACE = [np.uint64(x) | np.uint64(1) for x in _draw.integers(1, 1 << 63, 64, dtype=np.uint64)]


def classes(symbols_apart: bool) -> np.ndarray:
    """0 for the blanks, 1 for other bytes, and 2 for ASCII symbols if they stand apart."""
    out = np.ones(256, dtype=np.uint8)
    if symbols_apart:
        for b in range(33, 127):
            if not chr(b).isalnum() and chr(b) != "_":
                out[b] = 2
    out[[32, 9, 10, 11, 12, 13]] = 0
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], kinds: np.ndarray, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of all words, words of each text) for runs of texts; a word is a run of one class."""
    group, size = [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        group.append(data.lower() if lower else data)
        size += len(data)
        if size >= GROUP or i == len(texts) - 1:
            yield _hash_group(group, kinds)
            group, size = [], 0


def joined(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, a line end behind each, A-Z lower-cased or not; where each text ends."""
    group = [(t or "").encode() for t in texts]
    whole = b"\n".join(group) + b"\n"
    ends = np.cumsum([len(g) + 1 for g in group])
    return np.frombuffer(whole.lower() if lower else whole, dtype=np.uint8), ends


def word_ranges(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word."""
    full = classes(False)[whole] > 0
    starts = np.flatnonzero(full & np.concatenate([[True], ~full[:-1]]))
    return starts, np.flatnonzero(full & np.concatenate([~full[1:], [True]])) + 1


def range_hashes(whole: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Hashes of the words that start there and reach to the next blank or start."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    spans = np.diff(np.append(starts, len(whole)))
    place = np.arange(starts[0], len(whole)) - np.repeat(starts, spans)
    powers = np.full(int(place.max()) + 1, _BASE)
    powers[0] = 1
    values = np.where(kinds == 0, np.uint64(0), _BYTE)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        terms = values[whole[starts[0] :]] * powers[place]
        return mixed(np.add.reduceat(terms, starts - starts[0]))


def word_places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, lower-cased, and of each word start, end and hash; the words of each text."""
    whole, text_ends = joined(texts)
    starts, ends = word_ranges(whole)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return whole, starts, ends, range_hashes(whole, starts, classes(False)), counts


def _hash_group(group: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
    kind = kinds[whole]
    first = kind != 0
    first[1:] &= kind[1:] != kind[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(g) + 1 for g in group])
    return range_hashes(whole, starts, kinds), np.diff(np.searchsorted(starts, ends), prepend=0)


def sequences(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if n > 0 else 0):
            out += words[k : k + n] * _PLACE[k % 64] + np.uint64(k // 64)
        return mixed(out)
