"""Words of whole Arrow columns of text as numpy arrays: spans and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(11)
#: A random odd number for each byte, A-Z like a-z; white space (space, tab to carriage return) is 0 and parts words.
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE[SPACE] = 0
#: The same with cases apart, and with white space that parts nothing as ordinary characters.
CASED = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LINE_SPACE = np.zeros(256, dtype=bool)
LINE_SPACE[[10, 32]] = True
CASED[LINE_SPACE] = 0
_BASE = np.uint64(0x5851F42D4C957F2D)
_POWERS = np.multiply.accumulate(np.full(1024, _BASE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(column: pa.Array, size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of whole texts of about ``size`` bytes, which keep the arrays made from them in the cache."""
    raw, offsets = column_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't in ``space``, none across texts; words of each text."""
    full = ~space[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.empty_like(full), np.empty_like(full)
    if len(raw):
        before[0], before[1:] = False, full[:-1]
        after[-1], after[:-1] = False, full[1:]
    starts = np.flatnonzero(full & (~before | cut[:-1]))
    ends = np.flatnonzero(full & (~after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, value_of: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each word (with A-Z lowered, by BYTE): a polynomial in random byte values, mixed with the length."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else np.multiply.accumulate(np.full(longest, _BASE, dtype=np.uint64))
    if starts[0]:
        raw, starts = raw[starts[0] :], starts - starts[0]
    # white space has value 0, so places between words add nothing whatever their power
    local = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    values = value_of[raw] * powers[np.minimum(local, longest - 1)]
    return mix(np.add.reduceat(values, starts) ^ (lengths.astype(np.uint64) << np.uint64(56)))


@dataclass
class Words:
    """All words of a column: hashes, places in ``raw``, words of each text, and the texts' places."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sum of the words' values for each text."""
        total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
        return np.diff(total[np.concatenate(([0], np.cumsum(self.sizes)))])


def column_words(column: pa.Array, space: np.ndarray = SPACE, value_of: np.ndarray = BYTE) -> Words:
    raw, offsets = column_bytes(column)
    hashes, first, last, counts, base = [np.empty(0, dtype=np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for part, places in pieces(column):
        starts, ends, sizes = word_spans(part, places, space)
        hashes.append(word_hashes(part, starts, ends, value_of))
        first.append(starts + base)
        last.append(ends + base)
        counts.append(sizes)
        base += len(part)
    return Words(*map(np.concatenate, (hashes, first, last, counts)), raw, offsets)


class HashMemo:
    """A bounded memory of numbers by 64-bit hash in two sorted arrays, a large and a recent one.

    Compact, so that random lookups stay in few memory pages; it starts anew when it is full.
    """

    RECENT = 65_536

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.empty(0, np.uint64), np.empty(0, np.int64)), (np.empty(0, np.uint64), np.empty(0, np.int64))]

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of sorted keys."""
        values, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), dtype=bool)
        for have, numbers in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                values[hit] = numbers[at[hit]]
                found |= hit
        return values, found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New sorted keys."""
        if len(self) + len(keys) > self.capacity:
            self.clear()

        def merged(part: tuple[np.ndarray, np.ndarray], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(part[0], keys)
            return np.insert(part[0], at, keys), np.insert(part[1], at, values)

        self.parts[1] = merged(self.parts[1], keys, values)
        if len(self.parts[1][0]) > self.RECENT:
            self.parts = [merged(self.parts[0], *self.parts[1]), (np.empty(0, np.uint64), np.empty(0, np.int64))]


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text)."""
    hashes, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for raw, offsets in pieces(column):
        starts, ends, sizes = word_spans(raw, offsets)
        hashes.append(word_hashes(raw, starts, ends))
        counts.append(sizes)
    return np.concatenate(hashes), np.concatenate(counts)
