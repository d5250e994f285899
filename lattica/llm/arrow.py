"""Small helpers for Arrow-batched map functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a map function works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


#: White space between words, by byte; bytes that are hashed at once.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
WINDOW = 1 << 19


def release() -> None:
    """Give memory that is free in this process back to the system, as a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets (n + 1) of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[lo:hi], offsets - lo


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds much more than ``budget`` bytes of ``text``."""
    for b in batches:
        size = np.frombuffer(b.column(text).fill_null("").cast(pa.large_string()).buffers()[1], np.int64)[: b.num_rows + 1] if b.num_rows else np.zeros(1, np.int64)
        part = (size[1:] - 1 - size[0]) // budget if b.num_rows else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.diff(part)) + 1 if len(part) else np.zeros(0, np.int64)
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces of ``data`` that begin at ``starts`` (ascending, first 0) as one binary array, without copying."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of 64-bit values; public constants of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches sorted by ``keys``. Holds one run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the links ``a``-``b``, in one task."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the true cells, as rows and columns, that join all that the true cells join."""
    rows, columns, a, b = hit.any(axis=1), hit.any(axis=0), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while rows.any():
        new = np.array([rows.argmax()])
        rows[new] = False
        while len(new):
            part = hit[new] & columns
            got = np.flatnonzero(part.any(axis=0))
            a, b = [*a, new[part[:, got].argmax(axis=0)]], [*b, got]
            columns[got] = False
            part = hit[:, got] & rows[:, None]
            new = np.flatnonzero(part.any(axis=1))
            if len(new):
                a, b = [*a, new], [*b, got[part[new].argmax(axis=1)]]
            rows[new] = False
    return np.concatenate(a), np.concatenate(b)


def odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64), seed) | np.uint64(1)


class Words:
    """64-bit hashes of words (runs of bytes that are not white space), in windows of WINDOW bytes. A word's hash is a
    polynomial in its bytes; one that reaches over the end of a window is carried into the next."""

    def __init__(self):
        self.letters = odd(256, 11)
        self.base = int(odd(1, 13)[0]) & ~2 | 4  # odd, not 1 mod 4 only
        grow = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(WINDOW, x, np.uint64)]))
        self.power, self.inverse = grow(self.base), grow(pow(self.base, -1, 1 << 64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text begins among them (n + 1)."""
        starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        held: tuple[int, int, int] | None = None  # start, sum and length of the word that reaches the end of the window before
        for lo in range(0, len(data), WINDOW):
            d = data[lo : lo + WINDOW]
            size = len(d)
            word, edge = ~SPACE[d], np.zeros(size, bool)
            edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + size)] - lo] = True
            begins, ends = word.copy(), word.copy()
            begins[1:] &= ~word[:-1] | edge[1:]
            ends[:-1] &= ~word[1:] | edge[1:]
            s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.letters[d] * self.power[:size])])
            h, at, length = (sums[e] - sums[s]) * self.inverse[s], s + lo, e - s
            if held is not None:
                if word[0] and not edge[0]:
                    h[0] = np.uint64((held[1] + int(h[0]) * pow(self.base, held[2], 1 << 64)) % (1 << 64))
                    at[0], length[0] = held[0], length[0] + held[2]
                else:
                    starts.append(np.array([held[0]]))
                    hashes.append(np.array([held[1]], np.uint64))
                held = None
            if word[-1] and lo + size < len(data):
                held = int(at[-1]), int(h[-1]), int(length[-1])
                at, h = at[:-1], h[:-1]
            starts.append(at)
            hashes.append(h)
        return mix(np.concatenate(hashes), 14), np.searchsorted(np.concatenate(starts), offsets)
