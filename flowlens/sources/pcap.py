"""The capture file format as a Spark data source, to read, write and stream.

    spark.dataSource.register(PcapSource)
    spark.read.format("pcap").load("/captures")            # a file or a folder
    df.write.format("pcap").mode("append").save("/out")    # a file for each partition
    spark.readStream.format("pcap").load("/captures")      # files as they come

Files begin with a 24-byte header (microseconds, either byte order). A record
that claims more than ``maxIncl`` bytes, or that is cut off, ends its file. A
file is read by one task: captures scale by their number. Paths go through
pyarrow's file systems, so they may be URIs.

``seq_num`` is one order over all files: the file's rank times 2 ** FILE_BITS, and
the record's number in it, from 1. A batch ranks files by the time of their first record,
then by name, or with the option ``order`` = ``name`` by name alone, for files that are numbered and whose
clock may go back; a stream by name, as it can't know what is still to come. So rotated
captures are one sequence, as one file would be. The writer takes a partition's
rows as they come, into files that are numbered by partition; ``save`` sorts them by seq_num before.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, seq_num bigint, ts timestamp, ts_sec bigint, ts_usec int, incl_len int, orig_len int, frame binary"
#: Magic numbers, version, link type of Ethernet, limits.
MAGIC, VERSION, ETHERNET, SNAPLEN, MAX_INCL = 0xA1B2C3D4, (2, 4), 1, 65535, 65535
BATCH = 4096
#: Bits of a record's number in its file; ranks are above them.
FILE_BITS = 36

_KINDS = pa.schema([("file", pa.string()), ("seq_num", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("ts_sec", pa.int64()), ("ts_usec", pa.int32()), ("incl_len", pa.int32()), ("orig_len", pa.int32()), ("frame", pa.binary())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[str]:
    """A file, or a folder's files by name; hidden ones are left out."""
    files, name = _open(path)
    info = files.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = files.get_file_info(pafs.FileSelector(name))
    head = path[: len(path) - len(name)] if "://" in path else ""
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def records(path: str, max_incl: int = MAX_INCL) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(seconds, microseconds, captured, original length, frame) of each record."""
    files, name = _open(path)
    with files.open_input_stream(name) as f:
        head = f.read(24)
        if len(head) < 24:
            raise ValueError(f"{path}: not a capture file")
        order = {MAGIC.to_bytes(4, "little"): "<", MAGIC.to_bytes(4, "big"): ">"}.get(bytes(head[:4]))
        if order is None:
            raise ValueError(f"{path}: not a capture file")
        while len(row := f.read(16)) == 16:
            sec, usec, incl, orig = struct.unpack(order + "IIII", row)
            if incl > max_incl:
                return
            frame = f.read(incl)
            if len(frame) < incl:
                return
            yield sec, usec, incl, orig, frame


def _started(path: str) -> tuple[int, int, str]:
    """Time of a file's first record, and its name: files without one come first."""
    for sec, usec, *_ in records(path, 1 << 32):
        return sec, usec, path
    return -1, 0, path


def in_order(paths: list[str]) -> list[str]:
    """Files by the time of their first record, then by name; a header and a record of each are read."""
    if len(paths) < 2:
        return paths
    with ThreadPoolExecutor(32) as pool:
        return [path for *_, path in sorted(pool.map(_started, paths))]


def batches(path: str, max_incl: int = MAX_INCL, rank: int = 0) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for seq, (sec, usec, incl, orig, frame) in enumerate(records(path, max_incl), (rank << FILE_BITS) + 1):
        rows.append((path, seq, sec * 1_000_000 + usec, sec, usec, incl, orig, frame))
        if len(rows) == BATCH:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, _KINDS, strict=True)], schema=_KINDS)


def file_header(snaplen: int = SNAPLEN, linktype: int = ETHERNET) -> bytes:
    return struct.pack("<IHHIIII", MAGIC, *VERSION, 0, 0, snaplen, linktype)


def record(sec: int, usec: int, frame: bytes, orig_len: int | None = None, snaplen: int = SNAPLEN) -> bytes:
    """A frame cut to snaplen, with its header."""
    held = frame[:snaplen]
    return struct.pack("<IIII", sec & 0xFFFFFFFF, usec, len(held), orig_len or len(frame)) + held


@dataclass
class File(InputPartition):
    path: str
    max_incl: int
    rank: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.max_incl = options["path"], int(options.get("maxIncl", MAX_INCL))
        self.order = options.get("order", "time")
        if self.order not in ("time", "name"):
            raise ValueError(f"order is time or name, not {self.order}")

    def partitions(self) -> list[File]:
        files = list_files(self.path)
        return [File(p, self.max_incl, k) for k, p in enumerate(in_order(files) if self.order == "time" else files)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(partition.path, partition.max_incl, partition.rank)


class _StreamReader(DataSourceStreamReader):
    """Offsets count the folder's files by name, so new captures need names that sort after the old.

    A restarted query isn't told where it stopped before its first batch, so that batch takes all files there are, whatever maxFilesPerTrigger says.
    """

    def __init__(self, options: dict):
        self.path, self.max_incl = options["path"], int(options.get("maxIncl", MAX_INCL))
        self.most = int(options.get("maxFilesPerTrigger", 0))
        self.seen: int | None = None

    def initialOffset(self) -> dict:
        self.seen = 0
        return {"files": 0}

    def latestOffset(self) -> dict:
        n = len(list_files(self.path))
        self.seen = min(n, self.seen + self.most) if self.most and self.seen is not None else n
        return {"files": self.seen}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.seen = max(self.seen or 0, end["files"])
        return [File(p, self.max_incl, k) for k, p in enumerate(list_files(self.path)) if start["files"] <= k < end["files"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(partition.path, partition.max_incl, partition.rank)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Part(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """A task writes a hidden file; commit renames those of the attempts that count."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.snaplen, self.linktype = int(options.get("snaplen", SNAPLEN)), int(options.get("linktype", ETHERNET))
        self.names = schema.names
        self.run = uuid.uuid4().hex[:8]

    def write(self, rows: Iterator[Any]) -> _Part:
        from pyspark import TaskContext

        files, base = _open(self.path)
        files.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        temporary, final = f"{base}/.{self.run}-{part:05d}-{uuid.uuid4().hex}", f"{base}/part-{part:05d}-{self.run}.pcap"
        with files.open_output_stream(temporary) as f:
            f.write(file_header(self.snaplen, self.linktype))
            for r in rows:
                orig = r["orig_len"] if "orig_len" in self.names else None
                f.write(record(r["ts_sec"], r["ts_usec"], bytes(r["frame"]), orig, self.snaplen))
        return _Part(temporary, final)

    def commit(self, messages: list[_Part | None]) -> None:
        files, base = _open(self.path)
        if self.overwrite:
            for info in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
                if info.type == pafs.FileType.File and info.base_name.endswith(".pcap"):
                    files.delete_file(info.path)
        for m in messages:
            if m is not None:
                files.move(m.temporary, m.final)

    def abort(self, messages: list[_Part | None]) -> None:
        files, _ = _open(self.path)
        for m in messages:
            if m is not None and files.get_file_info(m.temporary).type == pafs.FileType.File:
                files.delete_file(m.temporary)


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)


def save(packets: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes packets (seq_num, ts_sec, ts_usec, orig_len, frame) as capture files, the records of each in order of seq_num."""
    rows = packets.select("seq_num", "ts_sec", "ts_usec", "orig_len", "frame").sortWithinPartitions("seq_num")
    rows.write.format("pcap").mode(mode).options(**options).save(path)


def interfaces() -> list[tuple[str, str]]:
    """(name, description) of this machine's network devices."""
    import socket

    return [(name, "Unknown") for _, name in socket.if_nameindex()]
