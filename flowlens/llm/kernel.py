"""Vectorised word kernels over the UTF-8 bytes of Arrow string arrays.

A batch is cut into blocks of whole documents (about ``BLOCK`` bytes, or one
longer document), so memory follows the longest document, not the batch.

Words are byte ranges. A range's 64-bit hash takes eight bytes at a time through
the finaliser of splitmix64, which is one-to-one: ranges of up to eight bytes
and equal length never share one, and no family of longer texts does by
construction, as they do under sums of powers. A run of words is hashed
by doubling: runs of 2, 4, 8 words, then two that overlap to the length wanted.
Where a result rests on equal hashes alone, ranges are compared by their bytes
(``Words.distinct``, ``Memo``).
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
#: Longer ranges are hashed one by one.
LONG = 512
_LENGTH, _JOIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes of words: everything but the ASCII white space 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of normalised words: digits, a-z and all of the bytes above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def store() -> dict:
    """A worker's own cache; functions sent by value don't share module globals."""
    return sys.__dict__.setdefault("_flowlens_llm", {})


def only(name: str | None = None) -> dict:
    """The cache, without what operators but the named one have left in it: workers live for many stages."""
    held = store()
    for k in [k for k in held if (k if isinstance(k, str) else k[0]) != name]:
        del held[k]
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * _JOIN + b)


class Bytes:
    """Bytes that are read eight at a time, from any place."""

    def __init__(self, data: np.ndarray):
        self.words = np.zeros((len(data) >> 3) + 2, "<u8")
        self.words.view(np.uint8)[: len(data)] = data

    def load(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """As numbers: the bytes from each place on, eight or as many as are left."""
        k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        raw = (self.words[k] >> shift) | ((self.words[k + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return raw & _KEEP[np.minimum(left, 8)]


def same(x: Bytes, a: np.ndarray, y: Bytes, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes from a in x are those from b in y."""
    out, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        left = size[live] - k
        out[live] &= x.load(a[live] + k, left) == y.load(b[live] + k, left)
        live = live[(left > 8) & out[live]]
        k += 8
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * kind.itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK):
    """(first row, row after the last, bytes, offsets) of blocks of whole documents."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    tidy()


def tidy() -> None:
    """Gives back memory that Arrow and the C library hold on to: workers live for many tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


class Words:
    """The words of a block: byte ranges, hashes, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        self.mask = m = table[data]
        n, inner = len(data), offsets[(offsets > 0) & (offsets < len(data))]
        edge = np.zeros(n + 1, bool)
        edge[0], edge[n], edge[inner] = True, True, True
        begin, end = m.copy(), m.copy()
        if n:
            begin[1:] &= ~m[:-1] | edge[1:n]
            end[:-1] &= ~m[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._bytes: Bytes | None = None
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def bytes(self) -> Bytes:
        if self._bytes is None:
            self._bytes = Bytes(self.data)
        return self._bytes

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        size = ends - starts
        h = mix(size.astype(np.uint64) * _LENGTH)
        far = size > LONG
        live, k = np.flatnonzero((size > 0) & ~far), 0
        while len(live):
            left = size[live] - k
            h[live] = mix(h[live] ^ self.bytes.load(starts[live] + k, left))
            live = live[left > 8]
            k += 8
        for r in np.flatnonzero(far).tolist():
            h[r] = int.from_bytes(hashlib.blake2b(self.data[starts[r] : ends[r]], digest_size=8).digest(), "little")
        return h

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.ranges(self.starts, self.ends)
        return self._hash

    def distinct(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys, one range of each, each range's key) of ranges of different bytes.

        Keys are hashes. Where bytes show that different ranges share one, all but one get another.
        """
        h = self.hash if starts is self.starts and ends is self.ends else self.ranges(starts, ends)
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        one, size = at[inverse], ends - starts
        if (size == size[one]).all() and same(self.bytes, starts, self.bytes, starts[one], size).all():
            return keys, at, inverse
        names: dict[bytes, int] = {}
        own = np.array([names.setdefault(self.data[a:b].tobytes(), len(names)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        at = np.unique(own, return_index=True)[1]
        keys = h[at]
        while len(again := np.setdiff1d(np.arange(len(keys)), np.unique(keys, return_index=True)[1])):
            keys[again] = mix(keys[again] + again.astype(np.uint64) + _LENGTH)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return keys[order], at[order], place[own]

    def text(self, k: int, length: int) -> bytes:
        """Words k to k + length, one space between."""
        raw = self.data
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.starts[k : k + length], self.ends[k : k + length], strict=True))


def grams(h: np.ndarray, first: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of all runs of length words inside one document."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    size, g = 1, h
    while 2 * size <= length:
        g, size = join(g[:-size], g[size:]), 2 * size
    at = np.arange(n) if len(first) == 2 else np.flatnonzero(np.arange(length, len(h) + 1) <= first[1:][doc[:n]])
    return at, g[at] if size == length else join(g[at], g[at + (length - size)])


def runs(g: np.ndarray, n: int, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs of words of any lengths from n on; g: the hash of the n words from each word on."""
    out = (last - first + seed).astype(np.uint64)
    live, k = np.arange(len(first)), 0
    while len(live):
        out[live] = join(out[live], g[np.minimum(first[live] + k, last[live] - n)])
        k += n
        live = live[first[live] + k < last[live]]
    return out


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in any of the runs that begin at starts."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags in each of the ranges between bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def different(x: np.ndarray) -> np.ndarray:
    """Sorted values, each once. Sorting is far faster here than the hash table that numpy's own takes to."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Memo:
    """A worker's map from texts to numbers, of about limit texts.

    Found by hash in a large and a small run of sorted keys (the small one is merged into the large one when it has an
    eighth of it), then compared by length and bytes. A full map takes no more texts, as the frequent ones come early, and
    forgets all when it knows few of those asked for.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.large, self.small, self.n, self.pooled = none, none, 0, 0
        self.value, self.begin, self.size = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool = Bytes(np.zeros(1 << 16, np.uint8))

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def _put(self, w: Words, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> None:
        size, n = ends - starts, self.n + len(keys)
        if n > len(self.value):
            self.value, self.begin, self.size = (np.concatenate([x[: self.n], np.zeros(n, np.int64)]) for x in (self.value, self.begin, self.size))
        stops = np.cumsum(size)
        total = self.pooled + int(stops[-1])
        if total > 8 * (len(self.pool.words) - 2):
            old, self.pool = self.pool, Bytes(np.zeros(2 * total, np.uint8))
            self.pool.words[: len(old.words)] = old.words
        flat_ = w.data[np.repeat(starts - stops + size, size) + np.arange(int(stops[-1]))]
        self.pool.words.view(np.uint8)[self.pooled : total] = flat_
        self.value[self.n : n], self.size[self.n : n], self.begin[self.n : n] = values, size, self.pooled + stops - size
        self.small = self._merge(self.small, (keys, np.arange(self.n, n)))
        self.n, self.pooled = n, total
        if 8 * len(self.small[0]) > len(self.large[0]):
            self.large, self.small = self._merge(self.large, self.small), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def get(self, w: Words, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, fresh) -> np.ndarray:
        """Values of ranges of w with sorted distinct keys (Words.distinct); fresh(indexes) gives those of texts not yet known."""
        out, left, foreign = np.zeros(len(keys), np.int64), np.arange(len(keys)), np.zeros(len(keys), bool)
        for held, entry in (self.large, self.small):
            if len(held) and len(left):
                at = np.minimum(np.searchsorted(held, keys[left]), len(held) - 1)
                hit = held[at] == keys[left]
                mine, e = left[hit], entry[at[hit]]
                size = (ends - starts)[mine]
                true = size == self.size[e]
                true[true] = same(w.bytes, starts[mine][true], self.pool, self.begin[e][true], size[true])
                out[mine[true]] = self.value[e[true]]
                foreign[mine[~true]] = True
                left = left[~hit | foreign[left]]
        if len(left):
            out[left] = fresh(left)
            if len(self) >= self.limit:
                if 5 * len(left) > 4 * len(keys):
                    self.clear()
                return out
            if len(new := left[~foreign[left]]):  # of texts that share a hash, the first is kept
                self._put(w, keys[new], starts[new], ends[new], out[new])
        return out
