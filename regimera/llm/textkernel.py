"""Vectorised word and shingle hashing over the byte buffers of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (one document may be longer).
CHUNK_BYTES = 1 << 19
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(seed: int, fold: bool) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    return table


_FOLDED, _EXACT = _table(20240229, True), _table(20240229, False)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        step = np.full(size, _BASE if name == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[name] = np.multiply.accumulate(step)
    return have[:n]


def lean(run):
    """Wraps a batch function so that its worker gives free memory back to the system when a task ends; workers outlive tasks."""

    def wrapped(*args):
        try:
            out = run(*args)
            if isinstance(out, Iterator):
                yield from out
            else:
                yield out
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most `limit` bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of documents: start and end byte, document index, 64-bit hash, and each document's first word."""

    __slots__ = ("doc", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        n = len(data)
        solid = NOT_SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = offsets[(offsets < n)]
        begins[inner] = solid[inner]
        last = offsets[offsets > 0] - 1
        ends[last] = solid[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if n:
            sums = np.cumsum((_FOLDED if fold else _EXACT)[data] * _power("up", n))
            low = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
            h = (sums[self.end - 1] - low) * _power("down", n)[self.start]
            self.hash = mix64(h + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


_K = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every window of `size` words; a shorter document with words gives its whole sequence once."""
    h, n = words.hash, len(words.hash)
    if n >= size:
        acc = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            acc = (acc ^ h[i : n - size + 1 + i]) * _K
            acc ^= acc >> np.uint64(29)
        doc = words.doc[: n - size + 1]
        same = doc == words.doc[size - 1 :]
        out, owner = mix64(acc[same]), doc[same]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short):
            acc = int(words.counts[d])
            for x in h[words.first[d] : words.first[d + 1]].tolist():
                acc = ((acc ^ x) * int(_K)) & _M64
                acc ^= acc >> 29
            extra[j] = acc
        out, owner = np.concatenate([out, mix64(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def shingle_sets(words: Words, size: int = 5, weight: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingle hashes of each document in turn, and the offsets of each document's run.

    With a weight for each word, also each shingle's sum of weights (0 for a document shorter than a shingle).
    """
    h, doc = shingles(words, size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    if len(h):
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[fresh], doc[fresh]
    offsets = np.searchsorted(doc, np.arange(len(words.first)))
    if weight is None:
        return h, offsets
    n = len(words.hash)
    sums = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
    total, first = sums[size:] - sums[: n - size + 1] if n >= size else np.zeros(0, np.int64), words.doc[: max(0, n - size + 1)]
    total = total[first == words.doc[size - 1 :]] if n >= size else total
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        owner = np.concatenate([first[first == words.doc[size - 1 :]] if n >= size else np.zeros(0, np.int64), short])
        total = np.concatenate([total, np.zeros(len(short), np.int64)])[np.argsort(owner, kind="stable")]
    return h, offsets, total[order][fresh]
