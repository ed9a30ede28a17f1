"""Words, shingles and lines of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  All of these are ASCII, so
the rule is the same on UTF-8 bytes and on characters.  Texts are looked at in slices of about
``SLICE_BYTES``, or of one text where a text is longer, so the arrays of a task stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        ones = np.ones(size, dtype=np.uint64)
        up, down = ones.copy(), ones
        up[1:], down[1:] = _BASE, _INVERSE
        tables = [np.cumprod(up), np.cumprod(down)]
        if size > 8 * SLICE_BYTES:  # one very long text: not worth keeping
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


class TextSlice:
    """Some consecutive texts of a column; a null is an empty text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.n_docs, self.size = len(bounds) - 1, len(data)
        filled = bounds[:-1] < bounds[1:]
        word = ~_SPACE[data]
        before = np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        before[bounds[:-1][filled]] = False
        after = np.empty_like(word)
        after[-1:], after[:-1] = False, word[1:]
        after[bounds[1:][filled] - 1] = False
        self.is_word = word
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.word_ptr = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.word_ptr)
        self.word_doc = np.repeat(np.arange(self.n_docs), self.n_words)
        self._prefix: np.ndarray | None = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of byte spans; equal spans have equal hashes wherever they lie."""
        up, down = _power_tables(self.size)
        if self._prefix is None:
            self._prefix = np.zeros(self.size + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * up[: self.size], out=self._prefix[1:])
        raw = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def shingles(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words inside a text, and the first word of each."""
        words = self.words()
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = np.flatnonzero(self.word_doc[:n] == self.word_doc[width - 1 :])
        return run_hash(words, width)[inside], inside

    def per_doc(self, flags: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sum of byte flags (or of flags at positions) for every text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        cut = self.bounds if at is None else at
        return total[cut[1:]] - total[cut[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of all lines that hold a word."""
        breaks = np.concatenate([self.bounds, np.flatnonzero(self.data == 10) + 1])
        breaks = np.unique(breaks)
        starts, ends = breaks[:-1], breaks[1:].copy()
        ends[self.data[ends - 1] == 10] -= 1
        held = np.diff(np.searchsorted(self.starts, breaks)) > 0
        starts, ends = starts[held], ends[held]
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1


def run_hash(items: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring items."""
    n = len(items) - width + 1
    value = items[:n].copy()
    for k in range(1, width):
        value = value * _BASE + items[k : n + k]
    return mix(value)


class RunHashes:
    """Hashes of runs of neighbouring items at chosen places, from one running sum."""

    def __init__(self, items: np.ndarray):
        up, self.down = _power_tables(len(items))
        self.total = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * up[: len(items)], out=self.total[1:])

    def of(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Hash of ``width`` items from every start; runs that end past the last item are cut."""
        ends = np.minimum(starts + width, len(self.total) - 1)
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, TextSlice]]:
    """First row, row after the last, and texts of every slice of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        part = bounds[first : last + 1]
        yield first, last, TextSlice(raw[part[0] : part[-1]], part - part[0])
        first = last


def keys_by_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, to look for repeats inside each text."""
    return mix(hashes + docs.astype(np.uint64) * _BASE)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
