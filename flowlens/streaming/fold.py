"""A flow's state from packet to packet, for streams: reassembly, name, application, verdict.

It says in plain Python, for one flow's packets in order, what the batch
operators say as aggregates; tests hold one against the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.apps import GENERIC, LADDER
from ..operators.extract import PEER_PREFIX
from ..operators.flows import MAX_BUFFER

#: The state's fields as a schema; the order is Flow's.
STATE = (
    "pkt_count long, byte_count long, first_us long, last_us long, expected long, buffer binary, full boolean, found boolean, sni string, app string, first_rule int, blocked_pkts long"
)


def server_name(p: bytes) -> str | None:
    """Server name of a ClientHello, None if there is none."""
    if len(p) < 44 or p[0] != 0x16 or p[5] != 1:
        return None
    two = lambda k: int.from_bytes(p[k : k + 2], "big") if k + 2 <= len(p) else None
    at = 44 + p[43]
    ciphers = two(at)
    if ciphers is None or at + 2 + ciphers >= len(p):
        return None
    at += 2 + ciphers
    at += 1 + p[at]
    total = two(at)
    if total is None:
        return None
    at += 2
    end = min(len(p), at + total)
    while at + 4 <= end:
        kind, size, body = two(at), two(at + 2), at + 4
        if body + size > end:
            return None
        if kind == 0 and size >= 5 and p[body + 2] == 0:
            length = two(body + 3)
            if length + 5 <= size:
                return p[body + 5 : body + 5 + length].decode("latin-1")
        at = body + size
    return None


def app_of(host: str) -> str:
    """The application of a server name."""
    if not host:
        return "Unknown"
    name = host.lower()
    return next((app for app, keys in LADDER if any(k in name for k in keys)), "TLS")


@dataclass
class Flow:
    pkt_count: int = 0
    byte_count: int = 0
    first_us: int | None = None
    last_us: int | None = None
    expected: int = 0
    buffer: bytes = b""
    full: bool = False
    found: bool = False
    sni: str | None = None
    app: str | None = None
    first_rule: int | None = None
    blocked_pkts: int = 0

    def _look(self, payload: bytes) -> None:
        name = server_name(payload)
        if name is not None or payload.startswith(PEER_PREFIX):
            self.found, self.sni = True, name
            self.app = "BitTorrent" if name is None else app_of(name)
            self.buffer = b""

    def _segment(self, number: int, payload: bytes) -> None:
        if self.full:
            return
        self.expected = self.expected or number
        if number != self.expected:
            return
        if len(self.buffer) + len(payload) > MAX_BUFFER:
            self.full, self.buffer = True, b""
            return
        self.buffer += payload
        self.expected = (self.expected + len(payload)) % 4294967296
        self._look(self.buffer)

    def add(self, ts_us: int, size: int, tcp: bool, udp: bool, number: int | None, payload: bytes | None, own: str | None, static: int | None, apps: dict[str, int], domains: list[tuple[str, int]]) -> int | None:
        """Takes a packet and returns the number of the rule that blocks its flow from here on or before, None if it isn't blocked. apps, domains: numbers of rules."""
        self.pkt_count, self.byte_count, self.last_us = self.pkt_count + 1, self.byte_count + size, ts_us
        self.first_us = ts_us if self.first_us is None else self.first_us
        if payload and not self.found:
            if tcp:
                self._segment(number or 0, payload)
            elif udp:
                self._look(payload)
        if own not in (None, *GENERIC) and self.app is None:
            self.app = own
        if self.first_rule is None:
            rule = static
            if rule is None:
                rule = apps.get(self.app or "Unknown")
            if rule is None and self.sni is not None:
                rule = next((k for d, k in domains if d in self.sni.lower()), None)
            self.first_rule = rule
        self.blocked_pkts += self.first_rule is not None
        return self.first_rule
