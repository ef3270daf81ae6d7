"""Whole texts as flat byte arrays: words, lines and their hashes without a Python object per word.

All helpers work on one Arrow column of a batch. Null texts count as empty,
and nothing ever reaches across the end of a text. Hashes are 64 bits wide,
equal for equal bytes in any batch, task or run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
NULL_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
OPAQUE = np.ones(256, dtype=bool)  # what stands between words of digits, a-z and non-ASCII characters
OPAQUE[48:58] = OPAQUE[97:123] = OPAQUE[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of murmur3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=4)
def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(factor: int, n: int) -> np.ndarray:
    return _powers(factor, max(CHUNK_BYTES + (1 << 20), 1 << max(1, n - 1).bit_length()))


class Texts:
    """Texts end to end: ``buf`` holds the bytes, text i is ``buf[at[i]:at[i + 1]]``."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.buf, self.at = buf, at

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset: column.offset + len(column) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(buf[at[0]: at[-1]], at - at[0])

    def __len__(self) -> int:
        return len(self.at) - 1

    def chunks(self, size: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
        """Whole texts of about ``size`` bytes together, with the number of the first."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + size, side="right")) - 1)
            yield i, Texts(self.buf[self.at[i]: self.at[j]], self.at[i: j + 1] - self.at[i])
            i = j

    def folded(self) -> Texts:
        """A-Z in lower case."""
        return Texts(_FOLD[self.buf], self.at)

    def folded_latin(self) -> Texts:
        """A-Z and the accented capitals of Latin-1 in lower case."""
        buf = _FOLD[self.buf]
        capital = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
        buf[capital] += 0x20
        return Texts(buf, self.at)

    def slice(self, i: int) -> bytes:
        return self.buf[self.at[i]: self.at[i + 1]].tobytes()

    def tokens(self, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs without ``gap`` bytes, and the first word of each text (one more at the end)."""
        inner = ~gap[self.buf]
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        last = inner.copy()
        last[:-1] &= ~inner[1:]
        cut = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[cut] |= inner[cut]
        last[cut[1:] - 1] |= inner[cut[1:] - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.at)

    def prefix(self) -> np.ndarray:
        """Prefix sums from which ``span_hash`` takes the hash of any span."""
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(self.buf) + 1)[: len(self.buf)], out=out[1:])
        return out

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text of each position."""
        return np.searchsorted(self.at, positions, side="right") - 1


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each word that begins such a run in the array."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + words[i: len(words) - n + 1 + i]
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each word that begins a run of n words inside its text; ``first`` as given by ``tokens``."""
    ok = np.zeros(max(0, total - n + 1), bool)
    edge = np.zeros(total + 1, np.int64)
    lo, hi = first[:-1], np.maximum(first[:-1], first[1:] - n + 1)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    ok[:] = np.cumsum(edge)[: len(ok)] > 0
    return ok


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive entries of ``first``."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def window_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(a) < width:
        return a[:0]
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done:]) if width > done else a


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; null becomes the largest."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_array(values: np.ndarray) -> pa.Array:
    """The inverse of ``ids``."""
    return pa.array(values, pa.int64(), mask=values == NULL_ID)
