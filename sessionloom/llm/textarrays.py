"""Words of many texts at once as numpy arrays: boundaries, hashes, shingles. Used inside Arrow tasks only.

Texts are UTF-8 bytes laid end to end. Lower-casing touches A-Z only, and word separators are ASCII, so bytes are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is cut at word ends. Each 64-bit temporary is eight times that.
BLOCK = 1 << 18
_RANDOM = np.random.default_rng(20240117)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}

#: White space separates these words.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
#: Letters, digits and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    kept = BLOCK + 4096
    if n > kept:  # a word of more than a block
        return _powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = _powers(base, kept)
    return _POWERS[base][:n]


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; the last entry is the end. A null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most BLOCK bytes together, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """The words of some texts: ``start`` and ``end`` of each in ``data``, and ``first``, the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED):
        self.data, self.offsets = data, offsets
        inside = kind[data]
        before, after = inside.copy(), inside.copy()
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        before[1:] &= ~inside[:-1]
        before[cuts] = inside[cuts]
        after[:-1] &= ~inside[1:]
        after[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(before), np.flatnonzero(after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def running_hash(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[_LOWER[self.data]] * powers(_BASE, len(self.data)), out=out[1:])
        return out

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """64-bit hashes of the words (0) or of their first so many bytes."""
        sums, unshift = self.running_hash(), powers(pow(_BASE, -1, 1 << 64), len(self.data) + 1)
        ends = (self.end if not k else np.minimum(self.end, self.start + k) for k in prefixes or (0,))
        return [mixed((sums[e] - sums[self.start]) * unshift[self.start]) for e in ends]


def pieces(data: np.ndarray, kind: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """One text in parts of about BLOCK bytes that end outside words."""
    at = 0
    while len(data) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(data) and kind[data[cut]]:
            ahead = np.flatnonzero(~kind[data[cut : cut + BLOCK]])
            cut = cut + int(ahead[0]) if len(ahead) else min(cut + BLOCK, len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words and the first word of each text."""
    if len(offsets) == 2 and len(data) > BLOCK:
        found = np.concatenate([Words(p, np.array([0, len(p)]), kind).hashes()[0] for p in pieces(data, kind)])
        return found, np.array([0, len(found)])
    words = Words(data, offsets, kind)
    return words.hashes()[0], words.first


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the distinct hashes of its runs of ``size`` words, or of its whole sequence if that is shorter."""
    factors = powers(0xD1342543DE82EF95, size + 1)[1:]
    grams = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for j in range(size):
        grams += hashes[j : j + len(grams)] * factors[j]
    grams = mixed(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
