"""Frames decoded by numpy over Arrow batches: all packets of a batch at once.

The same fields as the expressions of decode.py, from which a test tells them
apart on no frame. A header field costs a few array operations for thousands of
packets, where an expression makes a text of each to read a number. The functions
travel inside the task: workers need numpy and pyarrow, but no copy of this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: EtherTypes and protocols.
IPV4, IPV6, ARP, VLAN, QINQ = 0x0800, 0x86DD, 0x0806, 0x8100, 0x88A8
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58

#: Columns and their types, in order.
KINDS = {
    "dst_mac_raw": pa.binary(), "src_mac_raw": pa.binary(), "eth_type": pa.int64(), "vlan_depth": pa.int32(), "ip_version": pa.int32(), "ip_total_len": pa.int64(), "ip_id": pa.int64(), "ttl": pa.int64(), "is_fragment": pa.bool_(),
    "ip_proto": pa.int32(), "src_ip": pa.binary(), "dst_ip": pa.binary(), "src_ip4": pa.int64(), "dst_ip4": pa.int64(), "has_tcp": pa.bool_(), "has_udp": pa.bool_(), "has_icmp": pa.bool_(), "src_port": pa.int32(), "dst_port": pa.int32(),
    "tcp_seq": pa.int64(), "tcp_ack": pa.int64(), "tcp_flags": pa.int32(), "window_size": pa.int32(), "payload_off": pa.int32(), "payload": pa.binary(), "pkt_app": pa.string(), "payload_len": pa.int32(), "parse_status": pa.string(),
}


class Frames:
    """A batch's frames: their bytes, where each begins, and its length."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null(b"")
        rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32, rows + 1, 4 * column.offset).astype(np.int64) if rows else np.zeros(1, np.int64)
        held = column.buffers()[2]
        raw = np.frombuffer(held, np.uint8)[: offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        self.data = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.base, self.n = offsets[:-1], np.diff(offsets)

    def uint(self, at: np.ndarray | int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, whether all their bytes are there) of big-endian fields."""
        at = np.broadcast_to(np.asarray(at, np.int64), self.n.shape)
        there = (at >= 0) & (at + size <= self.n)
        place = np.where(there, self.base + at, 0)
        out = np.zeros(len(place), np.int64)
        for k in range(size):
            out = out << 8 | self.data[place + k]
        return np.where(there, out, 0), there

    def part(self, at: np.ndarray | int, size: np.ndarray | int, valid: np.ndarray) -> pa.Array:
        """size bytes from at, fewer at the end; null where not valid."""
        at = np.broadcast_to(np.asarray(at, np.int64), self.n.shape)
        left = np.clip(np.minimum(np.broadcast_to(size, self.n.shape), self.n - at), 0, None)
        left = np.where(valid, left, 0)
        ends = np.cumsum(left)
        places = np.repeat(self.base + at - (ends - left), left) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        mask = pa.array(valid).buffers()[1] if not valid.all() else None
        return pa.Array.from_buffers(pa.binary(), len(valid), [mask, pa.py_buffer(offsets), pa.py_buffer(self.data[places])], int((~valid).sum()))


def _tags(f: Frames, strict: bool) -> np.ndarray:
    tags, live = np.zeros(len(f.n), np.int64), np.ones(len(f.n), bool)
    while live.any():
        kind, there = f.uint(12 + 4 * tags, 2)
        live &= there & ((kind == VLAN) | (strict & (kind == QINQ)))
        tags += live
        if not strict:
            break
    return tags


def _extensions(f: Frames, off: np.ndarray, following: np.ndarray, live: np.ndarray, through_icmpv6: bool) -> tuple[np.ndarray, np.ndarray]:
    """(off, next) after the extension headers from off, of the frames that are live."""
    ends = (TCP, UDP, ICMP) if through_icmpv6 else (TCP, UDP, ICMP, ICMPV6)
    off, following, live = off.copy(), following.copy(), live.copy()
    while True:
        units, there = f.uint(off + 1, 1)
        size = (units + 1) * 8
        live &= there & ~np.isin(following, ends) & (off + 8 <= f.n) & (off + size <= f.n)
        if not live.any():
            return off, following
        after, _ = f.uint(off, 1)
        off, following = np.where(live, off + size, off), np.where(live, after, following)


def fields(column: pa.Array, strict: bool = False, trim_padding: bool = False, through_icmpv6: bool = False, wanted: tuple[str, ...] | None = None) -> list[pa.Array]:
    """KINDS, or those wanted, of a column of frames."""
    f = Frames(column)
    n, yes = f.n, np.ones(len(f.n), bool)
    want = set(KINDS if wanted is None else wanted)
    tags = _tags(f, strict)
    kind, has_kind = f.uint(12 + 4 * tags, 2)
    l3 = 14 + 4 * tags
    four, six = has_kind & (kind == IPV4), has_kind & (kind == IPV6)
    ihl = (f.uint(l3, 1)[0] & 15) * 4
    ok4 = (n >= l3 + 20) & ((n >= l3 + ihl) if strict else (ihl >= 20))
    ok = (n >= 14) & np.where(four, ok4, np.where(six, n >= l3 + 40, n >= l3))
    v4, v6 = ok & four, ok & six
    ip = v4 | v6
    total = np.where(v6, f.uint(l3 + 4, 2)[0], f.uint(l3 + 2, 2)[0])
    fragment = v4 & (f.uint(l3 + 6, 2)[0] & 0x3FFF != 0)
    l4, proto = l3 + np.where(v6, 40, ihl), np.where(v6, f.uint(l3 + 6, 1)[0], f.uint(l3 + 9, 1)[0])
    if v6.any() and not strict:
        l4, proto = _extensions(f, l4, proto, v6, through_icmpv6)
    tcp = ip & (proto == TCP) & ~fragment & (n >= l4 + 20)
    udp = ip & (proto == UDP) & (n >= l4 + 8)
    icmp = ip & (proto == ICMP)
    doff = (f.uint(l4 + 12, 1)[0] >> 4) * 4
    deep = (tcp & (doff >= 20)) | udp
    off = l4 + np.where(udp, 8, doff)
    end = np.minimum(n, l3 + total + np.where(v6, 40, 0)) if trim_padding else n
    carried = deep & (off <= n)
    size = np.where(carried, np.clip(end - off, 0, None), 0)
    whole = np.where(ip & (proto == TCP), tcp, np.where(ip & (proto == UDP), udp, True)) if strict else yes
    app = np.where(has_kind & (kind == ARP), 1, np.where(icmp & (n >= l4 + 4), 2, 0))

    def number(value: np.ndarray | tuple, valid: np.ndarray, name: str) -> pa.Array:
        if isinstance(value, tuple):
            value, there = value
            valid = valid & there
        return pa.array(value, KINDS[name], mask=~valid)

    made = {
        "dst_mac_raw": lambda _: f.part(0, 6, yes), "src_mac_raw": lambda _: f.part(6, 6, yes), "eth_type": lambda c: number(kind, has_kind, c), "vlan_depth": lambda c: number(tags, yes, c),
        "ip_version": lambda c: number(np.where(v4, 4, 6), ip, c), "ip_total_len": lambda c: number(total, ip, c), "ip_id": lambda c: number(f.uint(l3 + 4, 2), v4, c),
        "ttl": lambda c: number(np.where(v6, f.uint(l3 + 7, 1)[0], f.uint(l3 + 8, 1)[0]), ip, c), "is_fragment": lambda _: pa.array(fragment), "ip_proto": lambda c: number(proto, ip, c),
        "src_ip": lambda _: f.part(l3 + np.where(v6, 8, 12), np.where(v6, 16, 4), ip), "dst_ip": lambda _: f.part(l3 + np.where(v6, 24, 16), np.where(v6, 16, 4), ip),
        "src_ip4": lambda c: number(f.uint(l3 + 12, 4), v4, c), "dst_ip4": lambda c: number(f.uint(l3 + 16, 4), v4, c), "has_tcp": lambda _: pa.array(tcp), "has_udp": lambda _: pa.array(udp), "has_icmp": lambda _: pa.array(icmp),
        "src_port": lambda c: number(f.uint(l4, 2), tcp | udp, c), "dst_port": lambda c: number(f.uint(l4 + 2, 2), tcp | udp, c), "tcp_seq": lambda c: number(f.uint(l4 + 4, 4), tcp, c), "tcp_ack": lambda c: number(f.uint(l4 + 8, 4), tcp, c),
        "tcp_flags": lambda c: number(f.uint(l4 + 13, 1), tcp, c), "window_size": lambda c: number(f.uint(l4 + 14, 2), tcp, c), "payload_off": lambda c: number(off, deep, c), "payload": lambda _: f.part(off, size, carried),
        "pkt_app": lambda _: pa.array(["Unknown", "ARP", "ICMP"]).take(pa.array(app)), "payload_len": lambda c: number(size, yes, c), "parse_status": lambda _: pa.array(["malformed", "ok"]).take(pa.array((ok & whole).astype(np.int64))),
    }
    return [made[c](c) for c in KINDS if c in want]


def decoder(at: int, names: tuple[str, ...], **options):
    """For mapInArrow: batches with the columns names of KINDS added, from the frames in column at."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fields(batch.column(at), wanted=names, **options)], [*batch.schema.names, *names])

    return run
