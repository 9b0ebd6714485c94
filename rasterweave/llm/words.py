"""Words of a text column as numpy arrays, a quarter of a megabyte of text at a time.

Word breaks are ASCII bytes in every operator, so words are found and hashed on
the UTF-8 bytes without decoding. Hashes are 64 bits of a polynomial over the
bytes (or over word hashes), mixed at the end; equal words always hash equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
#: Rows whose offsets and missing values are worked out together.
_ROWS = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def classes(breaks: str) -> np.ndarray:
    """A table over bytes: True for bytes of words, False for the given break characters."""
    keep = np.ones(256, bool)
    keep[[ord(c) for c in breaks]] = False
    return keep


#: Runs of anything but ASCII white space.
NON_SPACE = classes(" \t\n\v\f\r")
#: a-z, digits and everything beyond ASCII; for text whose A-Z are lower-cased.
ALNUM = classes("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept by each process."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, independent of the place."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_STEP, n), out=total[1:])
    h = (total[end] - total[start]) * powers(_BACK, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * _BASE)


class Words:
    """Words of some texts. ``start`` and ``end`` are byte positions in ``data``;
    the words of text r are numbers ``first[r]`` to ``first[r + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        mask = keep[data]
        before = np.zeros(len(mask), bool)
        before[1:] = mask[:-1]
        before[offsets[:-1][offsets[:-1] < len(mask)]] = False
        after = np.zeros(len(mask), bool)
        after[:-1] = mask[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return sums(_BYTE[self.data], self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``size`` words within one text."""
        last = np.repeat(self.first[1:], self.counts) - size
        at = np.flatnonzero(np.arange(len(self)) <= last)
        return at, sums(hashes, at, at + size)

    def bytes(self, word: int, until: int) -> bytes:
        """Words ``word`` to ``until`` joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[word:until], self.end[word:until]))


def chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) over a string array; NULL counts as empty.

    A chunk holds at most ``limit`` bytes, or a single longer text.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    for base in range(0, len(text), _ROWS):
        part = pc.fill_null(text.slice(base, _ROWS).cast(pa.large_string()), "")
        n = len(part)
        _, ends, data = part.buffers()
        offsets = np.frombuffer(ends, np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(data or b"", np.uint8)
        row = 0
        while row < n:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            to = min(to, n)
            yield base + row, base + to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            row = to


def list_array(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """One list for each count, from values in order."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def covered(n: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any of the ranges [start, start + size)."""
    steps = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def ranges(marked: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal marked ranges [start, end) that do not cross the bounds in ``first``."""
    if not len(marked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(marked) + 1, bool)
    edge[first] = True
    before = np.concatenate(([False], marked[:-1])) & ~edge[:-1]
    after = np.concatenate((marked[1:], [False])) & ~edge[1:]
    return np.flatnonzero(marked & ~before), np.flatnonzero(marked & ~after) + 1
