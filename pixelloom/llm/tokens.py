"""Words of whole Arrow batches as numpy hashes.

`batch_words` splits all texts of a batch at ASCII white space and hashes every word in a few vectorised passes: a word's hash is a
polynomial over its bytes, read off prefix sums, then mixed and salted with the length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII bytes that are neither letters nor digits.
_MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, bit for bit reversible."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, order counts."""
    out = mix(parts[0])
    with np.errstate(over="ignore"):
        for part in parts[1:]:
            out = mix(out * np.uint64(31) + np.asarray(part, np.uint64))
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 2 * n)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """`hashes` of all words in order; text i has those from `offsets[i]` to `offsets[i + 1]`. `starts`, `ends`: places in `data`."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the first `n` code points of each word, 0 for words that are no longer than that."""
        letters = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        at = np.searchsorted(letters, self.starts) + n
        stop = letters[np.minimum(at, len(letters) - 1)]
        longer = stop < self.ends
        start, stop = self.starts[longer], stop[longer]
        out = np.zeros(len(self.starts), np.uint64)
        with np.errstate(over="ignore"):
            out[longer] = mix((self.sums[stop] - self.sums[start]) * _tables(len(self.data))[1][start] + np.uint64(n))
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8), offsets - offsets[0]


def batch_words(column: pa.Array, fold: bool = True, marks: bool = True) -> Words:
    """The words of each text, with A-Z as a-z if `fold`; without `marks`, all ASCII but letters and digits separates words."""
    data, text_at = text_bytes(column)
    if fold:
        data = _FOLD[data]
    gap = (_SPACE if marks else _MARKS)[data]
    edge = np.ones(len(data) + 1, bool)  # whether a word may not run on from the byte before
    edge[1:-1] = gap[:-1]
    edge[text_at[:-1]] = True
    edge[-1] = True
    starts = np.flatnonzero(edge[:-1] & ~gap)
    stop = np.concatenate([gap, [True]])
    stop[text_at[1:]] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    up, down = _tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return Words(mix(hashes), np.searchsorted(starts, text_at), starts, ends, data, sums)
