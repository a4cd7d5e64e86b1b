"""Token ids as binary files: Simple-8b, word-aligned, in blocks that decode alone.

Encoding. Texts are dealt out by ranges of doc_id, then of a 128-bit key of the
row for equal and null ids, so each task writes shards of consecutive documents,
of about ``FILE_IDS`` ids each; the number of tasks follows the bytes of text. A
text is tokenised by the tokenizers library. A pre-token never holds white space
after another character, so a text may be cut before each run of white space and
the parts' ids put together; each different part is encoded once by a worker,
which keeps what it knows from task to task and compares it by bytes. ``END``
closes every document.

A shard file, all little-endian:

    8 bytes      MAGIC
    blocks       64-bit words of Simple-8b, BLOCK_IDS ids a block but the last
    block table  int64 word offset of each block, and one past the end
    doc table    int64 doc_id, uint8 null flag, int64 number of ids
    footer       int64 number of blocks, of documents and of ids, MAGIC

The top four bits of a word are its selector: ids as many as COUNTS says, each
of WIDTHS bits, the first lowest. Selector 0 is an escape: the next word is one
id of up to 64 bits. The last word of a block may hold fewer ids; what is
missing is zero and the number of ids tells.

Recovery. A task writes to a name of its own and returns it; only files that
the returned manifest names count, so an attempt that failed or ran twice does
no harm. The manifest has one row for a shard. Files go to
``spark.checkpoint.dir`` through pyarrow's file systems; they are the result, and
whoever asked for them removes them.

Null and empty texts have one id, END. Equal rows are each written. Null doc_ids
come first and stay null; equal ids stand in the order of their keys. Ids are
whole numbers, as the format holds them; others raise ValueError. An empty table
makes no file and no row.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import shared_dir, texts, whole_ids
from .wordpiece import byte_alphabet

#: The file's marks, the end id, and the selectors of Simple-8b.
MAGIC, END = b"FLOWS8B1", 2
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
BLOCK_IDS = 1024
#: Ids that are encoded at once, and parts of texts that a worker remembers.
RUN, MEMO = 1 << 18, 400_000
#: Ids of a file, about; bytes of text of a task at most and at least, but for skewed ranges.
FILE_IDS, MOST_BYTES, LEAST_BYTES = 1 << 26, 256 << 20, 4 << 20
#: Ids that a task reads back at least, if there are tasks for all cores.
READ_IDS = 1 << 23


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    return np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), ids, "right").astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in each block) of ids, whose number is a multiple of BLOCK_IDS but for the last block."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    span = BLOCK_IDS + 60
    grid = np.zeros((blocks, span), np.uint64)
    full = np.zeros(blocks * BLOCK_IDS, np.uint64)
    full[:n] = ids
    grid[:, :BLOCK_IDS] = full.reshape(blocks, BLOCK_IDS)
    w = bit_widths(grid.ravel())

    def widest(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        """Of runs: a's at each place, b's shift places on."""
        out = a.copy()
        np.maximum(a[:-shift], b[shift:], out=out[:-shift])
        return out

    by_count = {1: w, 2: (m2 := widest(w, w, 1)), 3: widest(m2, w, 2), 4: (m4 := widest(m2, m2, 2)), 5: widest(m4, w, 4), 6: widest(m4, m2, 4)}
    by_count |= {8: (m8 := widest(m4, m4, 4)), 7: widest(m4, m4, 3), 10: widest(m8, m2, 8), 12: widest(m8, m4, 8), 15: (m15 := widest(m8, m8, 7))}
    by_count |= {20: widest(m15, m8, 12), 30: (m30 := widest(m15, m15, 15)), 60: widest(m30, m30, 30)}
    selector = np.zeros(len(w), np.uint8)
    for s in range(14, 0, -1):
        selector[by_count[int(COUNTS[s])] <= WIDTHS[s]] = s
    # All blocks step from word to word at once.
    step = COUNTS[selector]
    size = np.full(blocks, BLOCK_IDS)
    size[-1] = n - (blocks - 1) * BLOCK_IDS
    at, live, found = np.arange(blocks) * span, np.arange(blocks), []
    stop = at + size
    while len(live):
        found.append(at)
        at = at + step[at]
        more = at < stop
        at, live, stop = at[more], live[more], stop[more]
    begins = np.sort(np.concatenate(found))
    chosen, flat = selector[begins], grid.ravel()
    escape = chosen == 0
    where = np.arange(len(begins)) + np.cumsum(escape) - escape
    out = np.zeros(len(begins) + int(escape.sum()), np.uint64)
    for s in np.unique(chosen):
        pick = np.flatnonzero(chosen == s)
        if s == 0:
            out[where[pick] + 1] = flat[begins[pick]]
            continue
        word = np.full(len(pick), np.uint64(int(s) << 60))
        for k in range(COUNTS[s]):
            word |= flat[begins[pick] + k] << np.uint64(k * int(WIDTHS[s]))
        out[where[pick]] = word
    return out, np.bincount(begins // span, minlength=blocks) + np.bincount(begins[escape] // span, minlength=blocks)


def decode(words: np.ndarray, offsets: np.ndarray, total: int) -> np.ndarray:
    """The ids of whole blocks; offsets: word offset of each, and one past the end; total: number of ids, BLOCK_IDS a block but the last."""
    if not total:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that follow an escape
    skip = -1
    for k in np.flatnonzero(selector == 0).tolist():
        if k != skip:
            raw[k + 1], skip = True, k + 1
    counts = np.where(raw, 0, COUNTS[selector])
    ends = np.cumsum(counts)
    # The last word of a block holds what is left of it.
    first = np.concatenate([[0], ends])[offsets[:-1]]
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.concatenate([[0], ends[:-1]]) - first[block] + block * BLOCK_IDS
    limit = np.minimum((block + 1) * BLOCK_IDS, total)
    out = np.zeros(total, np.uint64)
    for s in np.unique(selector[~raw]):
        pick = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[place[pick]] = words[pick + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            here = pick[place[pick] + k < limit[pick]]
            out[place[here] + k] = words[here] >> np.uint64(k * int(WIDTHS[s])) & mask
    return out


class ShardWriter:
    """Writes one file. add() takes documents in order; close() returns (documents, ids)."""

    def __init__(self, sink):
        self.sink, self.pending, self.held = sink, [], 0
        self.words, self.ids, self.offsets = 0, 0, [np.zeros(1, np.int64)]
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, counts))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= RUN:
            self._flush(self.held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint64)
        for k in range(0, n, RUN):
            words, sizes = encode(ids[k : min(k + RUN, n)])
            self.sink.write(words.astype("<u8").tobytes())
            self.offsets.append(self.words + np.cumsum(sizes))
            self.words += len(words)
        self.ids += n
        self.pending, self.held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.held)
        offsets = np.concatenate(self.offsets)
        ids, nulls, counts = (np.concatenate(x) for x in zip(*self.docs, strict=True)) if self.docs else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
        for x, kind in ((offsets, "<i8"), (ids, "<i8"), (nulls, "u1"), (counts, "<i8"), (np.array([len(offsets) - 1, len(ids), self.ids]), "<i8")):
            self.sink.write(x.astype(kind).tobytes())
        self.sink.write(MAGIC)
        return len(ids), self.ids


class ShardReader:
    """Reads a file: doc_ids, nulls and counts of its documents, and ids of any of them. Blocks are read when they are asked for."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.file.size()
        if size < 40 or self._at(0, 8) != MAGIC or self._at(size - 8, 8) != MAGIC:
            raise ValueError("not a whole shard file")
        blocks, docs, self.total = np.frombuffer(self._at(size - 32, 24), "<i8").tolist()
        tables = self._at(size - 32 - 17 * docs - 8 * (blocks + 1), 17 * docs + 8 * (blocks + 1))
        at = 8 * (blocks + 1)
        self.offsets = np.frombuffer(tables, "<i8", blocks + 1)
        self.doc_ids = np.frombuffer(tables, "<i8", docs, at)
        self.nulls = np.frombuffer(tables, "u1", docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(tables[at + 9 * docs :], "<i8")
        self.ends = np.cumsum(self.counts)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number first to last - 1; only the blocks that hold them are read."""
        a, b = first // BLOCK_IDS, max(first // BLOCK_IDS, -(-last // BLOCK_IDS))
        low, high = int(self.offsets[a]), int(self.offsets[b])
        part = np.frombuffer(self._at(8 + 8 * low, 8 * (high - low)), "<u8")
        got = decode(part, self.offsets[a : b + 1] - low, min(b * BLOCK_IDS, self.total) - a * BLOCK_IDS)
        return got[first - a * BLOCK_IDS : last - a * BLOCK_IDS]


_SPACE = ~K.SPACED


class PartEncoder:
    """Ids of a block's texts, each different part encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet = byte_alphabet()
        #: Bytes of each token; only a byte-level tokenizer without normaliser may be used on parts.
        pre = told.get("pre_tokenizer") or {}
        self.by_parts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and not told["model"].get("dropout") and all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in told["added_tokens"])
        self.special = [t["content"] for t in told["added_tokens"]]
        self.by_parts = self.by_parts and not any(c.isspace() for t in self.special for c in t)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.sizes[k] = len(token) if all(c in alphabet for c in token) else len(token.encode())
        self.memo, self.pool, self.pooled = K.Memo(MEMO), np.zeros(1 << 20, np.uint32), 0

    def _plain(self, texts_: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    @staticmethod
    def _odd(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the character before each place may be white space above ASCII, or counts as such in some libraries only.

        Those above ASCII end in C2 85, C2 A0, or follow one of E1, E2, E3.
        """
        before = raw[at - 1]
        odd = (before >= 0x1C) & (before <= 0x1F)
        wide = np.flatnonzero(before >= 0x80)
        two, three, last = raw[np.maximum(at[wide] - 2, 0)], raw[np.maximum(at[wide] - 3, 0)], before[wide]
        odd[wide] = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3))
        return odd

    def parts(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where parts begin: at documents, and at ASCII white space after what surely is none."""
        space = _SPACE[raw]
        at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        return K.different(np.concatenate([offs[:-1][offs[:-1] < len(raw)], at[~self._odd(raw, at)]]))

    def _fresh(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes parts and returns their places in the pool: offset << 32 | length.

        Parts that begin with white space and don't end in it are encoded in a
        row, as their ids are the same so, and told apart by their bytes. Those
        that may hold a special token are encoded alone.
        """
        total = np.concatenate([[0], np.cumsum(np.isin(raw, [s.encode()[0] for s in self.special]))])
        doubt = total[ends] > total[begins]
        joint = _SPACE[raw[begins]] & ~_SPACE[raw[ends - 1]] & ~self._odd(raw, ends) & ~doubt
        own = np.zeros(len(begins), np.int64)
        parts: list[np.ndarray] = []
        rows = np.flatnonzero(joint)
        if len(rows):
            sizes = (ends - begins)[rows]
            stops = np.cumsum(sizes)
            data = raw[np.repeat(begins[rows] - stops + sizes, sizes) + np.arange(int(stops[-1]))].tobytes()
            cuts = [0, *stops[255::256].tolist()]
            cuts += [len(data)] * (cuts[-1] < len(data))
            got = self._plain([data[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(cuts)])
            ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, sum(map(len, got)))
            reached = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reached, stops)
            if len(reached) and reached[-1] == stops[-1] and np.array_equal(reached[last], stops):
                own[rows] = np.diff(last, prepend=-1)
                parts.append(ids)
            else:  # invalid UTF-8
                joint[:] = False
        rows_alone = np.flatnonzero(~joint)
        got = self._plain([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begins[rows_alone].tolist(), ends[rows_alone].tolist(), strict=True)])
        own[rows_alone] = [len(x) for x in got]
        parts.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, sum(map(len, got))))
        order = np.concatenate([np.flatnonzero(joint), rows_alone])
        places = np.empty(len(begins), np.int64)
        places[order] = self.pooled + np.cumsum(own[order]) - own[order]
        for ids in parts:
            if self.pooled + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.pooled], np.zeros(max(len(ids), self.pooled), np.uint32)])
            self.pool[self.pooled : self.pooled + len(ids)] = ids
            self.pooled += len(ids)
        return places << 32 | own

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a block, number of each document's)."""
        if not self.by_parts:
            got = self._plain([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(offs.tolist())])
            return np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in got)]), np.array([len(x) for x in got], np.int64)
        begins = self.parts(raw, offs) if len(raw) else np.zeros(0, np.int64)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        ends = np.append(begins[1:], len(raw))
        w, places = K.Words(raw, offs, _SPACE), np.empty(len(begins), np.int64)
        known, pooled = len(self.memo), self.pooled
        far = ends - begins > K.LONG
        if len(near := np.flatnonzero(~far)):
            keys, at, inverse = w.distinct(begins[near], ends[near])
            at = near[at]
            places[near] = self.memo.get(w, keys, begins[at], ends[at], lambda new: self._fresh(raw, begins[at[new]], ends[at[new]]))[inverse]
        if len(self.memo) > known:
            pooled = self.pooled
        if far.any():
            places[far] = self._fresh(raw, begins[far], ends[far])
        size, place = places & 0xFFFFFFFF, places >> 32
        shift = np.cumsum(size) - size
        ids = self.pool[np.repeat(place - shift, size) + np.arange(int(size.sum()))]
        self.pooled = pooled if len(self.memo) else 0  # what was encoded for this block alone goes
        doc = np.searchsorted(offs, begins, "right") - 1
        return ids, np.bincount(doc, size, len(offs) - 1).astype(np.int64)


_MANIFEST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def tasks(size: int, partitions: int) -> int:
    """Into how many ranges size bytes of text are dealt out: as many as the session's shuffles have, while they are neither tiny nor large."""
    return max(1, min(partitions, math.ceil(size / LEAST_BYTES)), math.ceil(size / MOST_BYTES))


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> list[dict]:
    """Writes docs (doc_id, text) and returns the manifest: a row for each shard, in order, with the number of ids before it."""
    if not whole_ids(docs):
        raise ValueError("doc_id must be a whole number")

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        part, number, writer, out, name = TaskContext.get().partitionId(), 0, None, None, ""
        held = K.only("parts")
        encoder = held.get(("parts", tokenizer)) or PartEncoder(tokenizer)
        held["parts", tokenizer] = encoder

        def closed():
            n_docs, n_ids = writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "name": name, "n_docs": n_docs, "n_ids": n_ids}], _MANIFEST)

        for batch in batches:
            if not batch.num_rows:
                continue
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            data, offsets = K.flat(batch.column(1))
            for i, j, raw, offs in K.blocks(data, offsets):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    name = f"{base}/{uuid.uuid4().hex}.s8b"
                    out = files.open_output_stream(name)
                    writer = ShardWriter(out)
                ids, counts = encoder.encode(raw, offs)
                closing = np.insert(ids.astype(np.uint64), np.cumsum(counts), end)
                writer.add(doc_ids[i:j], nulls[i:j], counts + 1, closing)
                if writer.ids + writer.held >= FILE_IDS:
                    yield closed()
                    number, writer = number + 1, None
        if writer is not None:
            yield closed()

    read = texts(docs).withColumns({"doc_id": F.col("doc_id").cast("long"), "a": F.xxhash64("doc_id", "text"), "b": F.xxhash64(F.lit(7919), "doc_id", "text")})
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = tasks(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = read.repartitionByRange(n, "doc_id", "a", "b").sortWithinPartitions("doc_id", "a", "b").select("doc_id", "text")
    rows = sorted(dealt.mapInArrow(run, "part int, number int, name string, n_docs long, n_ids long").collect())  # a row for each shard
    starts = [0, *itertools.accumulate(r["n_ids"] for r in rows)]
    return [{"name": r["name"], "n_docs": r["n_docs"], "n_ids": r["n_ids"], "start": s} for r, s in zip(rows, starts, strict=False)]


def readers(files: int, ids: int, cores: int) -> int:
    """Into how many tasks files are dealt out to be read back: one for each core, more if each had more than READ_IDS ids, but none without a file."""
    return max(1, min(files, max(cores, math.ceil(ids / READ_IDS))))


def _read(folder: str, schema: pa.Schema):
    """For mapInArrow: the documents of the files (name, start), with their ids if schema has these."""

    def run(batches):
        K.only()  # what the encoder remembers isn't needed any more
        K.tidy()
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(name) as f:
                    shard, a = ShardReader(f), 0
                    while a < len(shard.counts):
                        first = int(shard.ends[a - 1]) if a else 0
                        b = max(a + 1, int(np.searchsorted(shard.ends, first + RUN, "right")))
                        ids = shard.ids(first, int(shard.ends[b - 1]))
                        at = np.concatenate([[0], shard.ends[a:b] - first]).tolist()
                        low = ids.astype("<u4")
                        columns = [
                            pa.array(shard.doc_ids[a:b], mask=shard.nulls[a:b]),
                            pa.array(start + shard.ends[a:b] - shard.counts[a:b]),
                            pa.array(shard.counts[a:b]),
                            pa.array([zlib.crc32(low[p:q]) for p, q in itertools.pairwise(at)], pa.int64()),
                        ]
                        if "ids" in schema.names:
                            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)
                        a = b

    return run


def read(spark: SparkSession, manifest: list[dict], folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files, a task for some whole files."""
    shards = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = readers(len(manifest), sum(m["n_ids"] for m in manifest), spark.sparkContext.defaultParallelism)
    return shards.repartition(n).mapInArrow(_read(folder, pa.schema(kinds)), schema)


def encode_corpus(docs: DataFrame, tokenizer: str, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Writes docs to a new folder below spark.checkpoint.dir (or to folder) and reads the files back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    return read(spark, write(docs, tokenizer, folder), folder, with_ids)


def digest(read_back: DataFrame) -> DataFrame:
    return read_back.select("doc_id", F.col("start"), "n_tokens", "ids_crc32")
