"""Frames to packets: Ethernet, VLAN, IPv4, IPv6 with extension headers, TCP, UDP, ICMP.

Frames are decoded by numpy over Arrow batches (wire.py), or, where no Python
workers are wanted, by expressions (``arrow=False``). Addresses' texts are projections either way.
Two modes: ``live`` skips one 802.1Q tag and walks IPv6 extension headers;
``strict`` skips any number of 802.1Q and 802.1ad tags, walks none, and wants a whole transport
header. Walks are folds over as many steps as the frame's bytes can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.binary import let, part, u8, u16, u32, uint
from ..functions.net import ipv4_text, ipv6_text, mac_text
from . import wire

IPV4, IPV6, ARP, VLAN, QINQ = wire.IPV4, wire.IPV6, wire.ARP, wire.VLAN, wire.QINQ
ICMP, TCP, UDP, ICMPV6 = wire.ICMP, wire.TCP, wire.UDP, wire.ICMPV6
#: Flags.
FLAGS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}


def quick_tuple(raw: DataFrame) -> DataFrame:
    """raw with quick: the tuple that a reader routes by, null where the frame is rejected. Untagged IPv4 and IPv6 only."""
    n, f = F.octet_length("frame"), F.col("frame")
    kind = u16(f, 12)
    l4 = F.lit(14) + (u8(f, 14).bitwiseAND(15) * 4).cast("int")
    v4 = F.struct(part(f, 26, 4).alias("src_ip"), part(f, 30, 4).alias("dst_ip"), u16(f, l4).alias("src_port"), u16(f, l4 + 2).alias("dst_port"), u8(f, 23).alias("protocol"), F.lit(False).alias("is_ipv6"))
    v6 = F.struct(part(f, 22, 16).alias("src_ip"), part(f, 38, 16).alias("dst_ip"), u16(f, 54).alias("src_port"), u16(f, 56).alias("dst_port"), u8(f, 20).alias("protocol"), F.lit(True).alias("is_ipv6"))
    return raw.withColumn("quick", F.when((kind == IPV4) & (n >= 34) & (n >= l4 + 4), v4).when((kind == IPV6) & (n >= 58), v6))


def _steps(most: Column) -> Column:
    """As many elements as a walk has steps at most."""
    return F.array_repeat(F.lit(0), F.greatest(F.coalesce(most, F.lit(0)), F.lit(0)).cast("int"))


def _extensions(f: Column, off: Column, first: Column, n: Column, through_icmpv6: bool) -> Column:
    """(off, next) after the extension headers from off, of eight bytes at least."""
    ends = (TCP, UDP, ICMP) if through_icmpv6 else (TCP, UDP, ICMP, ICMPV6)

    def step(s: Column, _: Column) -> Column:
        size = (u8(f, s["off"] + 1) + 1) * 8
        stop = s["next"].isin(*ends) | (s["off"] + 8 > n) | (s["off"] + size > n)
        return F.when(s["done"], s).when(F.coalesce(stop, F.lit(True)), F.struct(s["off"].alias("off"), s["next"].alias("next"), F.lit(True).alias("done"))).otherwise(
            F.struct((s["off"] + size).cast("int").alias("off"), u8(f, s["off"]).alias("next"), F.lit(False).alias("done"))
        )

    steps = _steps(F.when(~first.isin(*ends), F.floor((n - off) / 8)))
    start = F.struct(off.cast("int").alias("off"), first.alias("next"), F.lit(False).alias("done"))
    return F.aggregate(steps, start, step, lambda s: F.struct(s["off"].alias("off"), s["next"].alias("next")))


def _tags(f: Column) -> Column:
    """How many tags stand before the EtherType."""
    tagged = lambda k: F.coalesce(u16(f, F.lit(12) + 4 * k).isin(VLAN, QINQ), F.lit(False))
    steps = _steps(F.when(tagged(F.lit(0)), F.floor((F.octet_length(f) - 12) / 4) + 1))
    start = F.struct(F.lit(0).alias("k"), F.lit(False).alias("done"))
    step = lambda s, _: F.when(s["done"], s).when(tagged(s["k"]), F.struct((s["k"] + 1).alias("k"), F.lit(False).alias("done"))).otherwise(F.struct(s["k"].alias("k"), F.lit(True).alias("done")))
    return F.aggregate(steps, start, step, lambda s: s["k"])


def _struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def _decoded(f: Column, mode: str, trim_padding: bool, through_icmpv6: bool) -> Column:
    """One struct of all fields. Each layer is a struct too, bound once for the next."""
    strict = mode == "strict"
    n = F.octet_length(f)
    tags = _tags(f) if strict else F.when(u16(f, 12) == VLAN, 1).otherwise(0)

    def network(e: Column) -> Column:
        l3 = e["off"]
        ihl = (u8(f, l3).bitwiseAND(15) * 4).cast("int")
        ok4 = (n >= l3 + 20) & ((n >= l3 + ihl) if strict else (ihl >= 20))
        ok = (n >= 14) & F.coalesce(F.when(e["kind"] == IPV4, ok4).when(e["kind"] == IPV6, n >= l3 + 40).otherwise(n >= l3), F.lit(False))
        walk = F.struct((l3 + 40).cast("int").alias("off"), u8(f, l3 + 6).alias("next")) if strict else _extensions(f, l3 + 40, u8(f, l3 + 6), n, through_icmpv6)
        v4 = _struct(
            ok=ok, version=F.lit(4), total=u16(f, l3 + 2), id=u16(f, l3 + 4), ttl=u8(f, l3 + 8), fragment=u16(f, l3 + 6).bitwiseAND(0x3FFF) != 0, l4=F.struct((l3 + ihl).alias("off"), u8(f, l3 + 9).alias("next")),
            src=part(f, l3 + 12, 4), dst=part(f, l3 + 16, 4), src4=u32(f, l3 + 12), dst4=u32(f, l3 + 16),
        )
        none = F.lit(None)
        v6 = _struct(
            ok=ok, version=F.lit(6), total=u16(f, l3 + 4), id=none.cast("bigint"), ttl=u8(f, l3 + 7), fragment=F.lit(False), l4=walk, src=part(f, l3 + 8, 16), dst=part(f, l3 + 24, 16), src4=none.cast("bigint"), dst4=none.cast("bigint"),
        )
        other = _struct(
            ok=ok, version=none.cast("int"), total=none.cast("bigint"), id=none.cast("bigint"), ttl=none.cast("bigint"), fragment=F.lit(False), l4=none.cast("struct<off:int,next:bigint>"),
            src=none.cast("binary"), dst=none.cast("binary"), src4=none.cast("bigint"), dst4=none.cast("bigint"),
        )
        return F.when(ok & (e["kind"] == IPV4), v4).when(ok & (e["kind"] == IPV6), v6).otherwise(other)

    def transport(e: Column, i: Column) -> Column:
        l4, proto = i["l4"]["off"], i["l4"]["next"].cast("int")
        tcp = F.coalesce((proto == TCP) & ~i["fragment"] & (n >= l4 + 20), F.lit(False))
        udp = F.coalesce((proto == UDP) & (n >= l4 + 8), F.lit(False))
        doff = F.shiftright(u8(f, l4 + 12), 4).cast("int") * 4
        return _struct(
            proto=proto, tcp=tcp, udp=udp, icmp=F.coalesce(proto == ICMP, F.lit(False)), sport=F.when(tcp | udp, u16(f, l4).cast("int")), dport=F.when(tcp | udp, u16(f, l4 + 2).cast("int")), off=F.when(tcp & (doff >= 20), l4 + doff).when(udp, l4 + 8),
        )

    def fields(e: Column, i: Column, t: Column) -> Column:
        l4 = i["l4"]["off"]
        end = F.least(n, e["off"] + F.when(i["version"] == 6, i["total"] + 40).otherwise(i["total"])) if trim_padding else n
        payload = F.when(t["off"] <= n, part(f, t["off"], F.greatest((end - t["off"]).cast("int"), F.lit(0))))
        whole = F.coalesce(F.when(t["proto"] == TCP, t["tcp"]).when(t["proto"] == UDP, t["udp"]), F.lit(True)) if strict else F.lit(True)
        text = lambda four, six: F.when(i["version"] == 4, ipv4_text(four)).when(i["version"] == 6, ipv6_text(six))
        return _struct(
            dst_mac=mac_text(part(f, 0, 6)), src_mac=mac_text(part(f, 6, 6)), eth_type=e["kind"], vlan_depth=e["tags"], ip_version=i["version"], ip_total_len=i["total"], ip_id=i["id"], ttl=i["ttl"], is_fragment=i["fragment"],
            ip_proto=t["proto"], src_ip=i["src"], dst_ip=i["dst"], src_ip4=i["src4"], dst_ip4=i["dst4"], has_tcp=t["tcp"], has_udp=t["udp"], has_icmp=t["icmp"], src_port=t["sport"], dst_port=t["dport"],
            tcp_seq=F.when(t["tcp"], u32(f, l4 + 4)), tcp_ack=F.when(t["tcp"], u32(f, l4 + 8)), tcp_flags=F.when(t["tcp"], u8(f, l4 + 13).cast("int")), window_size=F.when(t["tcp"], u16(f, l4 + 14).cast("int")), payload_off=t["off"],
            src_ip_str=text(i["src4"], i["src"]), dst_ip_str=text(i["dst4"], i["dst"]), payload=payload, pkt_app=F.when(e["kind"] == ARP, "ARP").when(t["icmp"] & (n >= l4 + 4), "ICMP").otherwise("Unknown"),
            payload_len=F.coalesce(F.octet_length(payload), F.lit(0)), parse_status=F.when(i["ok"] & whole, "ok").otherwise("malformed"),
        )

    link = let(tags, lambda k: F.struct(k.alias("tags"), (F.lit(14) + 4 * k).alias("off"), u16(f, F.lit(12) + 4 * k).alias("kind")))
    return let(link, lambda e: let(network(e), lambda i: let(transport(e, i), lambda t: fields(e, i, t))))


#: Columns of decode(), and those that are texts made of others.
_TEXTS = {
    "dst_mac": (("dst_mac_raw",), lambda: mac_text(F.col("dst_mac_raw"))),
    "src_mac": (("src_mac_raw",), lambda: mac_text(F.col("src_mac_raw"))),
    "src_ip_str": (("ip_version", "src_ip4", "src_ip"), lambda: F.when(F.col("ip_version") == 4, ipv4_text(F.col("src_ip4"))).when(F.col("ip_version") == 6, ipv6_text(F.col("src_ip")))),
    "dst_ip_str": (("ip_version", "dst_ip4", "dst_ip"), lambda: F.when(F.col("ip_version") == 4, ipv4_text(F.col("dst_ip4"))).when(F.col("ip_version") == 6, ipv6_text(F.col("dst_ip")))),
}
COLUMNS = (
    "dst_mac", "src_mac", "eth_type", "vlan_depth", "ip_version", "ip_total_len", "ip_id", "ttl", "is_fragment", "ip_proto", "src_ip", "dst_ip", "src_ip4", "dst_ip4", "has_tcp", "has_udp", "has_icmp", "src_port", "dst_port",
    "tcp_seq", "tcp_ack", "tcp_flags", "window_size", "payload_off", "src_ip_str", "dst_ip_str", "payload", "pkt_app", "payload_len", "parse_status",
)


def decode(raw: DataFrame, mode: str = "live", trim_padding: bool = False, through_icmpv6: bool = False, fields: tuple[str, ...] | None = None, arrow: bool = True) -> DataFrame:
    """raw (with frame) and its decoded columns, or those of fields. parse_status: ok or malformed.

    Fields that aren't wanted are best named here, as neither way leaves Catalyst any to drop.
    """
    wanted = COLUMNS if fields is None else tuple(c for c in COLUMNS if c in fields)
    if arrow:
        needed = {x for c in wanted for x in (_TEXTS[c][0] if c in _TEXTS else (c,))}
        names = tuple(c for c in wire.KINDS if c in needed)
        # Raw columns that are named as decoded ones give way.
        kept = [c for c in raw.columns if c not in wanted and c not in needed]
        held = raw.select(*(F.col(f"`{c}`") for c in kept))
        kind = T.StructType([*held.schema.fields, *(T.StructField(c, from_arrow_type(wire.KINDS[c])) for c in names)])
        run = wire.decoder(kept.index("frame"), names, strict=mode == "strict", trim_padding=trim_padding, through_icmpv6=through_icmpv6)
        return held.mapInArrow(run, kind).select(*kept, *(_TEXTS[c][1]().alias(c) if c in _TEXTS else F.col(c) for c in wanted))

    def picked(f: Column) -> Column:
        return let(_decoded(f, mode, trim_padding, through_icmpv6), lambda d: F.struct(*(d[c].alias(c) for c in wanted)))

    # One generator: a filter stays above it as a test of a column, while pushed through a projection it would repeat all that the column is made of.
    return raw.select(*raw.columns, F.inline(F.array(let(F.col("frame"), picked))))


def flag_names(flags: Column) -> Column:
    """Names of the bits that are set, such as syn+ack."""
    return F.concat_ws("+", *(F.when(flags.bitwiseAND(bit) != 0, name) for name, bit in FLAGS.items()))


__all__ = ["FLAGS", "decode", "flag_names", "quick_tuple", "uint"]
