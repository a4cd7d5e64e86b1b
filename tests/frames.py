"""Frames and a capture for tests, with fixed values."""

from __future__ import annotations

import struct

from flowlens.sources.pcap import file_header, record


def ip(text: str) -> bytes:
    return bytes(map(int, text.split(".")))


def ethernet(payload: bytes, kind: int = 0x0800, tags: tuple[tuple[int, int], ...] = ()) -> bytes:
    head = bytes.fromhex("02005e10000202005e100001")
    return head + b"".join(struct.pack(">HH", t, v) for t, v in tags) + struct.pack(">H", kind) + payload


def ipv4(src: str, dst: str, proto: int, payload: bytes, frag: int = 0x4000, ihl: int = 5) -> bytes:
    options = b"\x01" * (ihl * 4 - 20)
    return struct.pack(">BBHHHBBH", 0x40 | ihl, 0, ihl * 4 + len(payload), 7, frag, 64, proto, 0) + ip(src) + ip(dst) + options + payload


def tcp(sport: int, dport: int, payload: bytes = b"", seq: int = 1, flags: int = 0x10, doff: int = 5) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, doff << 4, flags, 8192, 0, 0) + payload


def udp(sport: int, dport: int, payload: bytes = b"") -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def hello(host: str, session: bytes = b"", before: bytes = b"") -> bytes:
    name = host.encode()
    sni = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    body = b"\x03\x03" + b"\xab" * 32 + bytes([len(session)]) + session + b"\x00\x02\xc0\x2f\x01\x00" + struct.pack(">H", len(before + sni)) + before + sni
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


#: (server, name): a blocked application, none, a blocked name, a blocked network, none, none.
SITES = [
    ("192.0.2.10", "v3.ytimg.example"), ("192.0.2.77", "fonts.gstatic.example"), ("198.51.100.99", "s1.nflxvideo.example"),
    ("203.0.113.70", "pbs.twimg.example"), ("203.0.113.200", "raw.github.example"), ("198.51.100.5", "plain.example"),
]
#: What capture() holds, and what the rules of the verdict queries make of it: 2 by application, 4 by name, 9 by network, 1 by port.
PACKETS, TCP, UDP, ICMP, MALFORMED, BLOCKED, FLOWS = 59, 50, 5, 2, 1, 16, 12
APPS = ["YouTube", "Google", "Netflix", "Twitter", "GitHub", "TLS", "Unknown", "BitTorrent", "Unknown", "Unknown", "ICMP", "Unknown"]


def visits() -> list[tuple[int, bytes]]:
    """(second, frame): a visit to each site, whose hello is one segment or two, with one more answer from site to site."""
    out = []
    for k, (server, name) in enumerate(SITES):
        client, port, begin, first = f"10.1.0.{2 + k}", 40100 + 7 * k, 10 * k, 70_000 * (k + 1)
        up = lambda data, seq, flags, c=client, s=server, p=port: ethernet(ipv4(c, s, 6, tcp(p, 443, data, seq, flags)))
        down = lambda data, seq, flags, c=client, s=server, p=port: ethernet(ipv4(s, c, 6, tcp(443, p, data, seq, flags)))
        out += [(begin, up(b"", first, 2)), (begin, down(b"", 9, 0x12)), (begin + 1, up(b"", first + 1, 0x10))]
        said = hello(name, session=bytes(range(k)))
        at = len(said) // 2 if k % 2 else 0
        for part in filter(None, (said[:at], said[at:])):
            out.append((begin + 1, up(part, first + 1 + (at if part == said[at:] and at else 0), 0x18)))
        for j in range(k + 1):
            # The first segment of a flow sets what is expected, so answers aren't taken for it.
            out.append((begin + 2 + j, down(bytes([65 + j]) * (20 + 3 * j), 10 + 30 * j, 0x18)))
    return out


def others() -> list[tuple[int, bytes]]:
    """A request, a peer's handshake, two name queries with answers, an echo and its answer, ARP, UDP over IPv6, a frame of ten bytes."""
    ask = bytes.fromhex("0a0b0100000100000000000003") + b"www\x07example" + bytes.fromhex("0000010001")
    six = struct.pack(">IHBB", 0x60000000, 11, 17, 64) + bytes.fromhex("20010db8" + "00" * 11 + "01" + "20010db8" + "00" * 11 + "02") + udp(5, 6, b"six")
    out = [
        ethernet(ipv4("10.1.0.50", "198.51.100.7", 6, tcp(41000, 80, b"GET /a HTTP/1.1\r\nHost: plain.example\r\n\r\n"))),
        ethernet(ipv4("10.1.0.60", "10.1.0.61", 6, tcp(50000, 6999, b"\x13BitTorrent protocol" + bytes(range(48))))),
    ]
    for k in range(2):
        out += [ethernet(ipv4("10.1.0.9", "192.0.2.53", 17, udp(45000 + k, 53, ask))), ethernet(ipv4("192.0.2.53", "10.1.0.9", 17, udp(53, 45000 + k, ask + b"answer")))]
    out += [ethernet(ipv4("10.1.0.9", "192.0.2.1", 1, bytes([8, 0, 0, 0]))), ethernet(ipv4("192.0.2.1", "10.1.0.9", 1, bytes(4))), ethernet(bytes(28), 0x0806), ethernet(six, 0x86DD), bytes(10)]
    return [(100 + k, f) for k, f in enumerate(out)]


def capture() -> bytes:
    """visits(), others(), and a record that is cut off."""
    whole = b"".join(record(sec, 0, frame) for sec, frame in (*visits(), *others()))
    return file_header() + whole + struct.pack("<IIII", 200, 0, 12, 12) + b"cut off"


def exchange() -> list[bytes]:
    """Five packets to port 443 whose payloads only look like TLS, so no name is in them."""
    up = lambda seq, flags, data=b"": ethernet(ipv4("10.1.0.70", "198.51.100.8", 6, tcp(42000, 443, data, seq, flags)))
    down = lambda seq, flags, data=b"": ethernet(ipv4("198.51.100.8", "10.1.0.70", 6, tcp(443, 42000, data, seq, flags)))
    return [up(1, 2), down(1, 0x12), up(2, 0x10), up(2, 0x18, b"\x16\x03\x01 hello, not one"), down(2, 0x18, b"\x17\x03\x03 answer")]
