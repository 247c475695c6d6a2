"""Vectorised views of a batch of texts.

A :class:`TextBatch` lays the UTF-8 bytes of its texts end to end and answers
questions about words, lines and characters for all of them at once with
numpy.  Words are maximal runs of anything but space and U+0009-U+000D.
Spans are compared by a 64-bit hash (random byte values in a polynomial,
finalised); two different spans of one batch agree with odds of about 2**-64.
A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text makes a batch of its own.
CHUNK_BYTES = 512 << 10

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: The same for a second hash, where 64 bits are too few.
_OTHER_BASE = 0xD1342543DE82EF95
_OTHER_INVERSE = pow(_OTHER_BASE, -1, 1 << 64)
_OTHER_VALUE = np.random.default_rng(20250211).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_ASCII = np.arange(256)
_IS_SPACE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
_IS_LEAD = (_ASCII & 0xC0) != 0x80
_LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept and enlarged as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 2)
        have = np.full(size, base & ((1 << 64) - 1), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (xor-shift and multiply)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


class TextBatch:
    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """data: uint8 of all texts; bounds: n + 1 offsets."""
        self.data, self.bounds = data, bounds.astype(np.int64)
        self.n = len(bounds) - 1

    @classmethod
    def of(cls, texts) -> TextBatch:
        """From Python strings (None: empty)."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]))

    # ---- characters -------------------------------------------------------
    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        return self.per_text(table[self.data])

    @cached_property
    def n_chars(self) -> np.ndarray:
        return self.count_bytes(_IS_LEAD)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.count_bytes(_IS_LEAD & ~_IS_SPACE)

    # ---- words ------------------------------------------------------------
    @cached_property
    def _word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        solid = ~_IS_SPACE[self.data]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.bounds] = True
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return starts, ends

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """For each text, the place of its first word; n + 1 of them."""
        return np.searchsorted(self._word_spans[0], self.bounds)

    @cached_property
    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def _prefix(self, lower: bool) -> np.ndarray:
        values = _BYTE_VALUE[_LOWER[self.data] if lower else self.data]
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _power_table(_BASE, len(values)), out=out[1:])
        return out

    @cached_property
    def _prefix_exact(self) -> np.ndarray:
        return self._prefix(False)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of data[start:end] for each span."""
        prefix = self._prefix(True) if lower else self._prefix_exact
        return mix((prefix[ends] - prefix[starts]) * _power_table(_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))

    def other_hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A second 64-bit hash of data[start:end], independent of the first."""
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_OTHER_VALUE[self.data] * _power_table(_OTHER_BASE, len(self.data)), out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * _power_table(_OTHER_INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.hash_spans(*self._word_spans, lower=lower)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all windows of `size` words within a text, and the windows' hashes."""
        left = np.repeat(self.word_bounds[1:], self.n_words) - np.arange(len(hashes))
        starts = np.flatnonzero(left >= size)
        total = np.zeros(len(starts), np.uint64)
        for k in range(size):
            total = total * _U(_BASE) + hashes[starts + k]
        return starts, mix(total + _U(size))

    # ---- lines ------------------------------------------------------------
    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.bounds, breaks, side="right") - 1])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
        ends = np.where(last, self.bounds[1:][owner], np.concatenate([starts[1:] - 1, [0]]) if len(starts) else starts)
        return starts, ends, owner

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each line (split at U+000A): start, end, text, number of words that begin in it."""
        starts, ends, owner = self._lines
        first = self._word_spans[0]
        return starts, ends, owner, np.searchsorted(first, ends) - np.searchsorted(first, starts)


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


def release() -> None:
    """Gives memory that large arrays have left in the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True at every key that occurs twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[place] > 1


def later_copy(keys: np.ndarray) -> np.ndarray:
    """True at every key that is equal to an earlier one."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def salted(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one owner."""
    return mix(hashes ^ (owner.astype(np.uint64) * _U(_BASE) + _U(1)))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, TextBatch]]:
    """The batch in runs of at most `rows` rows with at most `limit` bytes of text together (or one row)."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + rows, len(texts))
        yield batch.slice(at, to - at), TextBatch(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    release()  # Python workers live on between tasks


def take(batch: TextBatch, rows: np.ndarray) -> TextBatch:
    """The batch of these rows only."""
    if len(rows) == batch.n:
        return batch
    sizes = (batch.bounds[1:] - batch.bounds[:-1])[rows]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(bounds[-1]) + np.repeat(batch.bounds[rows] - bounds[:-1], sizes)
    return TextBatch(batch.data[place], bounds)
