"""What payloads tell: TLS server names, hosts, handshakes, protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import latin, let, part, u8, u16, uint
from ..functions.web import http_host

PEER_PREFIX = b"\x13BitTorrent protocol"
#: QUIC versions besides drafts.
QUIC_VERSIONS = (0x00000001, 0x6B3343CF)


def _walk(p: Column, first: Column) -> Column:
    """The name in the extensions whose total length stands at first - 2."""

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(further(s))

    def further(s: Column) -> Column:
        return let(F.struct(u16(p, s["off"]).alias("kind"), u16(p, s["off"] + 2).alias("size"), (s["off"] + 4).alias("body")), lambda x: look(s, x))

    def look(s: Column, x: Column) -> Column:
        fits = ~s["done"] & F.coalesce((x["body"] <= s["end"]) & (x["body"] + x["size"] <= s["end"]), F.lit(False))
        size = u16(p, x["body"] + 3)
        named = F.coalesce(fits & (x["kind"] == 0) & (x["size"] >= 5) & (u8(p, x["body"] + 2) == 0) & (size + 5 <= x["size"]), F.lit(False))
        name = F.when(named, part(p, (x["body"] + 5).cast("int"), size.cast("int"))).otherwise(s["name"])
        return F.struct(F.when(fits, x["body"] + x["size"]).otherwise(s["off"]).alias("off"), s["end"].alias("end"), name.alias("name"), (~fits | named).alias("done"))

    end = F.least(F.octet_length(p).cast("bigint"), first + u16(p, first - 2))
    start = F.struct(first.alias("off"), end.alias("end"), F.lit(None).cast("binary").alias("name"), first.isNull().alias("done"))
    steps = F.array_repeat(F.lit(0), F.coalesce(F.greatest(F.floor((end - first) / 4), F.lit(0)), F.lit(0)).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["name"])


def sni(payload: Column) -> Column:
    """Server name of a ClientHello, null if there is none. An empty name is found as such.

    A fold over as many extensions as there are bytes for; payloads that don't begin as a ClientHello aren't walked.
    """

    def found(p: Column) -> Column:
        hello = (F.octet_length(p) >= 44) & (u8(p, 0) == 0x16) & (u8(p, 5) == 0x01)
        ciphers = F.lit(44) + u8(p, 43)
        name = let(ciphers, lambda c: let(c + 2 + u16(p, c), lambda z: let(z + 3 + u8(p, z), lambda first: _walk(p, first))))
        return F.when(hello, latin(name))

    return let(payload, found)


def is_peer(payload: Column) -> Column:
    """Begins with a peer-to-peer handshake."""
    return F.coalesce(part(payload, 0, len(PEER_PREFIX)) == F.lit(PEER_PREFIX), F.lit(False))


def is_tls(payload: Column) -> Column:
    return F.coalesce((F.octet_length(payload) >= 5) & (u8(payload, 0) == 0x16) & (u8(payload, 1) == 3) & u8(payload, 2).isin(1, 2, 3), F.lit(False))


def is_http(payload: Column) -> Column:
    return F.coalesce(latin(part(payload, 0, 8)).rlike("^(GET |POST|PUT |HEAD|DELETE|HTTP/)"), F.lit(False))


def plain_host(payload: Column) -> Column:
    """The first Host header anywhere, its line whole; null if there is none."""
    host = F.regexp_extract(latin(payload), r"(?s)Host: (.*?)\r\n", 1)
    return F.when(host != "", host)


def dns(packets: DataFrame) -> Column:
    """A struct (txid, flags, qdcount) of name queries and answers, else null."""
    p = F.col("payload")
    fits = ((F.col("src_port") == 53) | (F.col("dst_port") == 53)) & (F.octet_length(p) >= 12) & ((u16(p, 4) > 0) | (u8(p, 2).bitwiseAND(0x80) != 0))
    return F.when(fits, F.struct(u16(p, 0).alias("txid"), u8(p, 2).alias("flags"), u16(p, 4).alias("qdcount")))


def is_quic(payload: Column, dst_port: Column) -> Column:
    version = uint(payload, 1, 4)
    draft = F.shiftright(version, 24) == 0xFF
    return F.coalesce((F.octet_length(payload) >= 5) & (u8(payload, 0).bitwiseAND(0x80) != 0) & (dst_port == 443) & (version.isin(*QUIC_VERSIONS) | draft), F.lit(False))


def protocol(packets: DataFrame) -> Column:
    """TLS, HTTP, DNS or QUIC, the first that fits; null for no payload, Unknown for others."""
    p = F.col("payload")
    found = F.when(is_tls(p), "TLS").when(is_http(p), "HTTP").when(dns(packets).isNotNull(), "DNS").when(F.col("has_udp") & is_quic(p, F.col("dst_port")), "QUIC").otherwise("Unknown")
    return F.when(F.col("payload_len") > 0, found)


__all__ = ["dns", "http_host", "is_http", "is_peer", "is_quic", "is_tls", "plain_host", "protocol", "sni"]
