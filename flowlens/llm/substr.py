"""Substring dedup with a compressed FM-index for each shard.

A window is ``width`` words in a row of one document; each word of a window
whose words also start anywhere else, in the same or another document, goes.

1. Cutting. Every window has an anchor: its run of ``ANCHOR`` words with the
   least hash, the leftmost of equals. Windows in a row with the same anchor
   make a segment. Equal windows have equal anchors, so dealing segments out by
   their anchors' hash brings all occurrences of a window to one shard. Anchors
   of very many segments (``hot_anchors``) are no key alone: their windows have a
   second anchor, the least of the runs that aren't hot by another hash, and are
   cut and dealt by both. A task sends a segment's words once, with their number of
   occurrences (one, or more), however many copies it met; segments travel
   compressed.
2. Index. A shard keeps the segments whose anchor occurs twice or more, once
   each, and builds an FM-index over their words: a wavelet matrix of the
   Burrows-Wheeler transform, and a bit for each suffix that marks where
   ``width - 1`` words differ from the suffix before.
3. Search. All of the shard's segments are streamed against it, each from its
   last word to its first, many at once. A backward step extends the match by a
   word; to slide the window, the match is cut to its first width - 1 words by
   widening it to the marks. That is the matching statistic as far as the
   threshold needs it: a window whose match is found at two places repeats.
4. Removing. Documents are cut again; their segments' hashes join the shards'
   findings (a skewed hash is split by AQE, as the findings are distinct), and
   the intervals join the texts by a 128-bit key of id and text.

A shard holds about ``SHARD_BYTES`` of segments; a task takes one shard after
another, so there are ``TASKS`` tasks at most, however many shards.

Words are runs of anything but ASCII white space, compared unchanged. Null and
wordless texts have no words. Equal rows repeat each other. Null ids stay null;
ids may be texts. Memory of a task follows ``SHARD_BYTES`` and the longest document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Shared, cut, id_type, texts

#: Words of an anchor; bytes of segments of a shard, about, and of those that a task holds before it sends them; how hard they are compressed.
ANCHOR, SHARD_BYTES, HELD, LEVEL = 6, 8 << 20, 32 << 20, 9
#: Tasks of the search at most; segments of an anchor, and its share of all, above which it is hot.
TASKS, HOT_SEGMENTS, HOT_SHARE = 20_000, 32_768, 1e-6
#: Words whose windows' anchors are found at once.
PIECE = 1 << 22
NONE = np.zeros(0, np.uint64)


def _least(v: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """For each window that begins at whole, the place of the least of span values from there on, the leftmost of equals.

    The upper 40 bits are compared; words are taken in pieces, so a place within one needs 24.
    """
    out = np.empty(len(whole), np.int64)
    for low in range(0, len(v), PIECE):
        a, b = np.searchsorted(whole, [low, low + PIECE])
        if a == b:
            continue
        part = v[low : low + PIECE + span]
        part = part >> np.uint64(24) << np.uint64(24) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size < span:
            step = min(size, span - size)
            part[:-step] = np.minimum(part[:-step], part[step:])
            size += step
        out[a:b] = (part[whole[a:b] - low] & np.uint64((1 << 24) - 1)).astype(np.int64) + low
    return out


class Segments:
    """The segments of a block: words first to last - 1, windows' number, key they are dealt by and own hash (key, more).

    hot: sorted hashes of anchors that are no key alone.
    """

    def __init__(self, w: K.Words, width: int, hot: np.ndarray = NONE):
        n, h = len(w), w.hash
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.windows = empty
        self.anchor = self.key = self.more = NONE
        span = width - ANCHOR + 1
        at, g = K.grams(h, w.first, w.doc, ANCHOR)
        whole = np.flatnonzero(np.arange(width, n + 1) <= w.first[1:][w.doc[: max(0, n - width + 1)]]) if n >= width else empty
        if not len(whole):
            return
        most = np.iinfo(np.uint64).max
        full = np.full(n, most, np.uint64)
        full[at] = g
        place = _least(full, whole, span)
        new = np.ones(len(whole), bool)
        new[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1)
        anchor = full[place]
        if len(hot) and (warm := np.isin(anchor, hot)).any():
            other = K.mix(full ^ np.uint64(0x452821E638D01377))
            other[np.isin(full, hot) | (full == most)] = most
            second = _least(other, whole, span)
            least = other[second]
            second[least == most] = -1  # all of the window's runs are hot
            new[1:] |= warm[1:] & (second[1:] != second[:-1])
            anchor = np.where(warm, K.join(anchor, least), anchor)
        begin = np.flatnonzero(new)
        self.windows = np.diff(np.append(begin, len(whole)))
        self.first = whole[begin]
        self.last = self.first + self.windows - 1 + width
        self.anchor = anchor[begin]
        self.key, self.more = _names(full, self.first, self.last)

    def __len__(self) -> int:
        return len(self.first)


def _names(full: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that name the words of each run: 64, and 32 more. full: the hash of the ANCHOR words from each word on."""
    return K.runs(full, ANCHOR, first, last), K.runs(full, ANCHOR, first, last, 1 << 32) >> np.uint64(32)


# --- anchors ---------------------------------------------------------------------


def _survey(width: int):
    """anchor, n: of segments different within a block, those of anchors that a task meets twice or more; and all under a null anchor."""

    def run(batches):
        held, total, size = [], 0, 0

        def flush():
            anchor, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array(anchor[many].view(np.int64)), pa.array(n[many])], ["anchor", "n"])

        for batch in batches:
            data, offsets = K.flat(batch.column(0))
            for _, _, raw, offs in K.blocks(data, offsets):
                s = Segments(K.Words(raw, offs, K.SPACED), width)
                if len(s):
                    one = np.unique(s.key, return_index=True)[1]
                    held.append(s.anchor[one])
                    total += len(s)
                    size += len(one)
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["anchor", "n"])

    return run


def hot_anchors(read: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of anchors of over HOT_SEGMENTS segments and over HOT_SHARE of all, so 1 / HOT_SHARE of them at most.

    What is counted only decides how segments are dealt out, so occurrences that are alone in a task may be left out.
    """
    counts = cut(read.mapInArrow(_survey(width), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(f"n > {HOT_SEGMENTS} OR anchor IS NULL"))
    total = (counts.where("anchor IS NULL").first() or (0, 0))[1]
    rows = counts.where(F.col("anchor").isNotNull() & (F.col("n") > HOT_SHARE * total)).select("anchor").toPandas()
    return np.sort(rows["anchor"].to_numpy(np.int64).view(np.uint64))


# --- messages ------------------------------------------------------------------


def pack(anchors: np.ndarray, many: np.ndarray, pieces: list[bytes]) -> bytes:
    """Segments as bytes: number, 32 bits of each anchor, whether there are several, length, text; compressed."""
    raw = b"".join([np.int64(len(pieces)).tobytes(), (anchors >> np.uint64(32)).astype("<u4").tobytes(), many.astype(np.uint8).tobytes(), np.array([len(p) for p in pieces], "<u4").tobytes(), *pieces])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], "<i8")[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    return np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n).astype(bool), np.frombuffer(raw[8 + 5 * n : 8 + 9 * n], "<u4"), raw[8 + 9 * n :]


def _send(width: int, shards: int, hot=None):
    def run(batches):
        held: dict[int, list] = {}  # name -> [anchor, several, text]
        size, warm = 0, NONE if hot is None else hot.value

        def flush():
            rows = list(held.values())
            anchors = np.array([r[0] for r in rows], np.uint64)
            many = np.array([r[1] for r in rows], bool)
            shard = (anchors % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            names, blobs = [], []
            for part in np.split(order, cuts):
                names.append(int(shard[part[0]]))
                blobs.append(pack(anchors[part], many[part], [rows[k][2] for k in part.tolist()]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])

        for batch in batches:
            data, offsets = K.flat(batch.column(0))
            for _, _, raw, offs in K.blocks(data, offsets):
                w = K.Words(raw, offs, K.SPACED)
                s = Segments(w, width, warm)
                if not len(s):
                    continue
                text = raw.tobytes()
                for key, more, anchor, a, b in zip(s.key.tolist(), s.more.tolist(), s.anchor.tolist(), w.starts[s.first].tolist(), w.ends[s.last - 1].tolist(), strict=True):
                    name = key << 32 | more
                    if (got := held.get(name)) is None:
                        held[name] = [anchor, False, text[a:b]]
                        size += b - a + 150
                    else:
                        got[1] = True
                if size > HELD:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


# --- the index -----------------------------------------------------------------


class Wavelet:
    """A wavelet matrix: bit planes with running counts of ones. Takes ceil(log2(sigma)) bits a symbol and an eighth more."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.planes, self.ranks, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            plane = np.packbits(padded, bitorder="little").view("<u8")
            self.planes.append(plane)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane[:-1]), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Each place's image in the run of symbol, at the bottom of the matrix."""
        out = [p.copy() for p in places]
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            plane, rank, zeros = self.planes[k], self.ranks[k], self.zeros[k]
            for i, p in enumerate(out):
                word = p >> 6
                below = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
                ones = rank[word] + np.bitwise_count(plane[word] & below)
                out[i] = np.where(one, zeros + ones, p - ones)
        return out


class Marks:
    """Bits that begin groups, the first of all included. Takes a bit a place and two more for the nearest words that have any."""

    def __init__(self, edge: np.ndarray):
        self.n = len(edge)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = edge
        self.plane = np.packbits(padded, bitorder="little").view("<u8")
        some, each = self.plane > 0, np.arange(len(self.plane), dtype=np.int32)
        self.before = np.maximum.accumulate(np.where(some, each, -1)).astype(np.int32)
        after = np.where(some, each, len(each)).astype(np.int32)
        self.after = np.append(np.minimum.accumulate(after[::-1])[::-1], np.int32(len(each)))

    @staticmethod
    def _highest(word: np.ndarray) -> np.ndarray:
        for k in (1, 2, 4, 8, 16, 32):
            word = word | (word >> np.uint64(k))
        return np.bitwise_count(word).astype(np.int64) - 1

    @staticmethod
    def _lowest(word: np.ndarray) -> np.ndarray:
        return np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)

    def around(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, one past the last) place of each place's group."""
        k, bit = place >> 6, (place & 63).astype(np.uint64)
        upto = (np.uint64(2) << bit) - np.uint64(1)  # 2 << 63 is 0, and 0 - 1 is all ones
        here, rest = self.plane[k] & upto, self.plane[k] & ~upto
        k1 = np.where(here > 0, k, self.before[np.maximum(k - 1, 0)])
        first = (k1 << 6) + self._highest(np.where(here > 0, here, self.plane[k1]))
        k2 = np.where(rest > 0, k, self.after[k + 1])
        inside = k2 < len(self.plane)
        found = self.plane[np.where(inside, k2, 0)]
        last = np.where(inside, (k2 << 6) + self._lowest(np.where(rest > 0, rest, found)), self.n)
        return first, np.minimum(last, self.n)


class FMIndex:
    """Of a sequence of symbols (0 separates), for backward search of up to about twice depth symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        sigma = int(symbols.max(initial=0)) + 1
        bits = max(1, int(sigma).bit_length())
        packed = max(1, 63 // bits)
        padded = np.concatenate([symbols, np.zeros(2 * depth + packed, np.int64)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(packed):
            key = key << np.uint64(bits) | padded[k : k + n]
        size, marked, same = packed, None, None
        if size > depth - 1:  # few symbols: less is packed at first
            key, size = symbols.astype(np.uint64), 1
        while True:
            order = np.argsort(key)
            put = key[order]
            step = np.ones(n, np.int64)
            step[1:] = put[1:] != put[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            if size <= depth - 1:
                marked = size, rank
            if size >= depth or rank.max(initial=0) == n:
                break
            far = np.zeros(n, np.int64)
            far[: max(0, n - size)] = rank[size:]
            key = rank.astype(np.uint64) << np.uint64(32) | far.astype(np.uint64)
            size *= 2
        # Neighbours that share depth - 1 symbols: by ranks of runs that overlap.
        size, rank = marked
        if size * 2 < depth - 1:
            size, rank = self._grow(rank, size, depth - 1)
        shift = depth - 1 - size
        far = np.zeros(n, np.int64)
        far[: max(0, n - shift)] = rank[shift:]
        same = (rank[order][1:] == rank[order][:-1]) & (far[order][1:] == far[order][:-1])
        self.marks = Marks(np.concatenate([[True], ~same]))
        self.wavelet = Wavelet(symbols[order - 1], sigma)
        before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])[:-1]
        every = np.arange(sigma)
        self.shift = before - self.wavelet.descend(every, np.zeros(sigma, np.int64))[0]
        self.n = n

    @staticmethod
    def _grow(rank: np.ndarray, size: int, depth: int) -> tuple[int, np.ndarray]:
        """Ranks of longer runs, for sequences whose suffixes differ early."""
        n = len(rank)
        while size * 2 <= depth:
            far = np.zeros(n, np.int64)
            far[: max(0, n - size)] = rank[size:]
            rank = np.unique(rank << 32 | far, return_inverse=True)[1] + 1
            size *= 2
        return size, rank

    def back(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that have symbol before those from low to high - 1."""
        a, b = self.wavelet.descend(symbol, low, high)
        return a + self.shift[symbol], b + self.shift[symbol]

    def cut(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that share depth - 1 symbols with number low."""
        return self.marks.around(low)


def repeats(index: FMIndex, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """For each segment, symbols[first:last], bits of its windows (the first lowest) that match at two places."""
    out = np.zeros(len(first), np.uint64)
    order = np.argsort(first - last, kind="stable")  # the longest first: those that go on are a prefix
    first, last = first[order], last[order]
    low, high = np.zeros(len(first), np.int64), np.full(len(first), index.n)
    found = np.zeros(len(first), np.uint64)
    at, live = last - 1, len(first)
    for step in range(int((last - first).max(initial=0))):
        live = int(np.searchsorted(first - last, -step, "left"))  # longer than step
        if not live:
            break
        low, high = low[:live], high[:live]
        if step >= width:
            low, high = index.cut(low)
        low, high = index.back(low, high, symbols[at[:live] - step])
        if step >= width - 1:
            window = (at[:live] - step - first[:live]).astype(np.uint64)
            found[:live] |= (high - low >= 2).astype(np.uint64) << window
    out[order] = found
    return out


def search_shard(messages: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, more, bits of repeated windows) of a shard's segments that have any."""
    anchors = np.concatenate([m[0] for m in messages])
    many = np.concatenate([m[1] for m in messages])
    sizes = np.concatenate([m[2] for m in messages]).astype(np.int64)
    data = np.frombuffer(b"".join(m[3] for m in messages), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # Only anchors that occur twice can hold repeated windows.
    keep = K.repeated(anchors) | np.isin(anchors, anchors[many])
    if not keep.any():
        return NONE, NONE, NONE
    if not keep.all():
        data = data[np.repeat(keep, sizes)]
        many, sizes = many[keep], sizes[keep]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
    w = K.Words(data, bounds, K.SPACED)
    one, where = w.distinct(bounds[:-1], bounds[1:])[1:]
    several = np.bincount(where, minlength=len(one)) > 1
    several |= np.bincount(where, many, len(one)) > 0
    lengths = w.counts[one]
    # The sequence: each different segment's words, and a separator.
    place = np.cumsum(lengths + 1) - lengths - 1
    words = np.repeat(w.first[one] - place, lengths)
    inside = np.ones(int((lengths + 1).sum()), bool)
    inside[place + lengths] = False
    target = np.flatnonzero(inside)
    sequence = np.zeros(len(inside), np.int64)
    sequence[target] = w.distinct(w.starts, w.ends)[2][words + target] + 1
    bits = ((np.uint64(1) << (lengths - width + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
    once = np.flatnonzero(~several)
    if len(once):
        bits[once] = repeats(FMIndex(sequence, width), sequence, place[once], place[once] + lengths[once], width)
    some = np.flatnonzero(bits)
    at, g = K.grams(w.hash, w.first, w.doc, ANCHOR)
    full = np.zeros(len(w), np.uint64)
    full[at] = g
    key, more = _names(full, w.first[one[some]], w.first[one[some] + 1])
    return key, more, bits[some]


def merged(messages: list[tuple]) -> tuple:
    """One message of several, each different segment once."""
    held: dict[bytes, list] = {}
    for anchors, many, sizes, data in messages:
        at = 0
        for anchor, several, size in zip(anchors.tolist(), many.tolist(), sizes.tolist(), strict=True):
            text = bytes(data[at : at + size])
            at += size
            if (got := held.get(text)) is None:
                held[text] = [anchor, several]
            else:
                got[1] = True
    rows = list(held.values())
    return np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows], bool), np.array([len(t) for t in held], np.uint32), b"".join(held)


def _search(width: int):
    def run(batches):
        shard, messages, size, least = None, [], 0, 4 * SHARD_BYTES

        def done():
            key, more, bits = search_shard(messages, width)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(more.astype(np.uint32).view(np.int32)), pa.array(bits.view(np.int64))], ["key", "more", "bits"])

        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != shard and messages:
                    yield done()
                    messages, size, least = [], 0, 4 * SHARD_BYTES
                shard = name
                messages.append(unpack(blob.as_py()))
                size += len(messages[-1][3])
                if size > least:  # copies that many tasks sent
                    messages = [merged(messages)]
                    size = len(messages[0][3])
                    least = max(least, 2 * size)
        if messages:
            yield done()

    return run


# --- the operator --------------------------------------------------------------


def _cut(width: int, hot):
    def run(batches):
        for batch in batches:
            data, offsets = K.flat(batch.column(2))
            for i, _, raw, offs in K.blocks(data, offsets):
                w = K.Words(raw, offs, K.SPACED)
                s = Segments(w, width, hot.value)
                if not len(s):
                    continue
                doc = w.doc[s.first]
                row = pa.array(i + doc)
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(s.key.view(np.int64)), pa.array(s.more.astype(np.uint32).view(np.int32)), pa.array((s.first - w.first[doc]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "more", "first"])

    return run


def _pack_texts(batches):
    """Texts as zstd: a third of the shuffle that plain ones would take."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        blobs = [np.int64(b - a).tobytes() + codec.compress(data[a:b].tobytes(), asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), *batch.columns[2:]], ["doc_id", "blob", "a", "b"])


def _unpack_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of packed texts."""
    texts_ = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in column.to_pylist()]
    return np.frombuffer(b"".join(texts_), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts_], dtype=np.int64)])


def _remove(width: int, keep_text: bool):
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                yield one(whole.slice(k, 1000))

    def one(batch):
        n = batch.num_rows
        data, offsets = _unpack_texts(batch.column(1))
        hits = batch.column(2)
        counts, gone, texts_, spans = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for i, j, raw, offs in K.blocks(data, offsets):
            w = K.Words(raw, offs, K.SPACED)
            counts[i:j] = w.counts
            blob = raw.tobytes()
            for d in range(j - i):
                a, b = int(w.first[d]), int(w.first[d + 1])
                found = hits[i + d].as_py()
                left, span = np.ones(b - a, bool), []
                if found:
                    at = np.array([x["first"] for x in found])
                    bits = np.array([x["bits"] for x in found], np.int64).view(np.uint64)
                    which = (bits[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(bool)
                    begins = (at[:, None] + np.arange(width))[which]
                    left = ~K.covered(b - a, K.different(begins), width)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], ~left, [0]]).astype(np.int8)))
                    span = [{"first": int(p), "last": int(q)} for p, q in edge.reshape(-1, 2)]
                gone[i + d] = b - a - int(left.sum())
                kept = np.flatnonzero(left) + a
                texts_.append(b" ".join([blob[p:q] for p, q in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)]))
                spans.append(span)
        digests = [hashlib.sha256(t).hexdigest() for t in texts_]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.array(gone), pa.array(digests), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([t.decode("utf-8", "replace") for t in texts_] if keep_text else [None] * n, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"],
        )

    return run


def find_repeats(docs: DataFrame, width: int = 35, hot: Shared | None = None) -> DataFrame:
    """key, more, bits: names of segments that have repeated windows, and which."""
    read = texts(docs).select("text")
    spark = docs.sparkSession
    hot = hot or Shared(spark.sparkContext, hot_anchors(read, width))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expansion, least = 1 + 2 * width / (width - ANCHOR + 2), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, math.ceil(size * expansion / SHARD_BYTES))
    sent = read.mapInArrow(_send(width, shards, hot), "shard long, blob binary")
    dealt = sent.repartition(min(shards, max(TASKS, least)), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_search(width), "key long, more int, bits long")


def dedup(docs: DataFrame, width: int = 35, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (ranges of words) and kept_text of each row."""
    if not ANCHOR < width <= 64:
        raise ValueError("width must be 7 to 64")
    read = texts(docs)
    hot = Shared(docs.sparkSession.sparkContext, hot_anchors(read.select("text"), width))
    keyed = read.withColumns({"a": F.xxhash64("doc_id", "text"), "b": F.xxhash64(F.lit(7919), "doc_id", "text")})
    mine = keyed.select("a", "b", "text").mapInArrow(_cut(width, hot), "a long, b long, key long, more int, first int")
    hits = mine.join(find_repeats(docs, width, hot), ["key", "more"]).groupBy("a", "b").agg(F.collect_set(F.struct("first", "bits")).alias("hits"))
    kind = id_type(docs)
    packed = keyed.select("doc_id", "text", "a", "b").mapInArrow(_pack_texts, f"doc_id {kind}, blob binary, a long, b long")
    out = packed.join(hits, ["a", "b"], "left").select("doc_id", "blob", "hits")
    return out.mapInArrow(_remove(width, keep_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,last:int>>, kept_text string")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: DuckDB's form of the digest.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, k, md5_number(array_to_string(w[k : k + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(k, k + 35)) AS p FROM g JOIN rep USING (g)) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
gonep AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gonep USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
