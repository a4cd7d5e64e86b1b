"""Flows: keys, aggregates, reassembly, state as of a packet, sessions.

What holds from some packet on is found once for each flow, by partial
aggregates, as the seq_num it begins at, and joined back: the flow's side of the
join is distinct, so AQE splits a flow that holds a third of all packets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.apps import GENERIC, NAMES, app_name, app_of_host
from ..functions.binary import let, part
from .extract import is_peer, sni

#: Bytes that are reassembled at most: beyond, a flow isn't looked into any more.
MAX_BUFFER = 16384
KEY = ("ip_a", "port_a", "ip_b", "port_b", "ip_proto")


def _turned(ip: Column) -> Column:
    """The bytes of an IPv4 address, the last first; others as they are."""
    return F.when(F.octet_length(ip) == 4, F.concat(*(part(ip, k, 1) for k in (3, 2, 1, 0)))).otherwise(ip)


def canonical(packets: DataFrame, compat_zero_key: bool = False, compat_le: bool = False) -> DataFrame:
    """packets with the key of their flow, the same in both directions: the lesser (address, port) first.

    ICMP has ports 0. compat_zero_key: all of ICMP is one flow of no address. compat_le: IPv4 addresses are held, and compared, last byte first.
    """
    held = _turned if compat_le else lambda ip: ip
    end = lambda ip, port: F.struct(held(F.col(ip)).alias("ip"), F.coalesce(F.col(port), F.lit(0)).alias("port"))
    a, b = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    out = packets.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)})
    key = {"ip_a": F.hex("_a.ip"), "port_a": F.col("_a.port"), "ip_b": F.hex("_b.ip"), "port_b": F.col("_b.port")}
    if compat_zero_key:
        zero = {"ip_a": F.lit("00000000"), "port_a": F.lit(0), "ip_b": F.lit("00000000"), "port_b": F.lit(0)}
        key = {k: F.when(F.col("has_icmp"), zero[k]).otherwise(v) for k, v in key.items()}
    return out.withColumns(key).drop("_a", "_b")


def directional(packets: DataFrame) -> DataFrame:
    """packets with a key of their own direction."""
    return packets.withColumns({"ip_a": F.hex("src_ip"), "port_a": F.coalesce("src_port", F.lit(0)), "ip_b": F.hex("dst_ip"), "port_b": F.coalesce("dst_port", F.lit(0))})


def flow_bytes() -> Column:
    """What a packet adds to its flow: the IP length, 64 where it is 0."""
    return F.when(F.coalesce("ip_total_len", F.lit(0)) == 0, 64).otherwise(F.col("ip_total_len"))


def aggregate(packets: DataFrame, key: tuple[str, ...] = KEY, size: Column | None = None, extra: list[Column] | None = None) -> DataFrame:
    """A row for each flow: packets, bytes, first and last time in order of arrival, of packets that have one."""
    size = flow_bytes() if size is None else size
    timed = F.when(F.col("ts_us").isNotNull(), F.col("seq_num"))
    return packets.groupBy(*key).agg(
        F.count("*").alias("pkt_count"), F.sum(size).alias("byte_count"), F.min_by("ts_us", timed).alias("first_us"), F.max_by("ts_us", timed).alias("last_us"), *(extra or [])
    )


def duration(flows: DataFrame) -> DataFrame:
    """flows with duration_sec, and bits per second, 0 where there is no duration."""
    d = F.when(F.col("first_us") == 0, 0.0).otherwise((F.col("last_us") - F.col("first_us")) / 1e6)
    return flows.withColumn("duration_sec", d).withColumn("throughput_bps", F.when(F.col("duration_sec") > 0, F.col("byte_count") * 8 / F.col("duration_sec")).otherwise(0.0))


def _fold() -> Column:
    """State after a flow's payloads in order: what was found, and at which seq_num.

    A TCP segment counts if its sequence number is the one expected, which the
    first segment sets; the buffer stops at MAX_BUFFER. UDP payloads are looked into one by one.
    """
    empty = F.struct(
        F.lit(0).cast("bigint").alias("expected"), F.lit(b"").alias("buffer"), F.lit(False).alias("full"), F.lit(None).cast("bigint").alias("at"),
        F.lit(None).cast("string").alias("sni"), F.lit(False).alias("peer"),
    )

    def step(s: Column, x: Column) -> Column:
        return F.when(s["at"].isNotNull(), s).otherwise(let(taken(s, x), lambda t: let(look(s, x, t), lambda k: after(s, x, t, k))))

    def taken(s: Column, x: Column) -> Column:
        expected = F.when(s["expected"] == 0, x["tcp_seq"]).otherwise(s["expected"])
        in_order = x["tcp"] & ~s["full"] & (x["tcp_seq"] == expected)
        over = F.octet_length(s["buffer"]) + F.octet_length(x["payload"]) > MAX_BUFFER
        return F.struct((in_order & ~over).alias("yes"), (s["full"] | (in_order & over)).alias("full"), F.when(x["tcp"] & ~s["full"], expected).otherwise(s["expected"]).alias("expected"))

    def look(s: Column, x: Column, t: Column) -> Column:
        buffer = F.when(t["yes"], F.concat(s["buffer"], x["payload"])).otherwise(s["buffer"])
        seen = lambda b: F.when(t["yes"], b).when(~x["tcp"], x["payload"])
        return let(buffer, lambda b: let(seen(b), lambda z: F.struct(b.alias("buffer"), sni(z).alias("sni"), is_peer(z).alias("peer"))))

    def after(s: Column, x: Column, t: Column, k: Column) -> Column:
        peer = k["sni"].isNull() & k["peer"]
        expected = F.when(t["yes"], (t["expected"] + F.octet_length(x["payload"])) % 4294967296).otherwise(t["expected"])
        return F.struct(expected.alias("expected"), k["buffer"].alias("buffer"), t["full"].alias("full"), F.when(k["sni"].isNotNull() | peer, x["seq_num"]).alias("at"), k["sni"].alias("sni"), peer.alias("peer"))

    return F.aggregate(F.array_sort(F.col("segments")), empty, step)


def _near(packets: DataFrame, firsts: DataFrame, by: list[str]) -> DataFrame:
    """TCP segments that may be taken, of packets with a payload: what is reassembled begins at the flow's first_seq and ends within MAX_BUFFER.

    So a flow's list holds a window of MAX_BUFFER bytes, however long the flow. Next to the end of the number range all
    are kept: a number that comes out as 0 counts as none.
    """
    offset = F.pmod(F.col("tcp_seq") - F.col("first_seq"), F.lit(4294967296))
    return packets.join(firsts, by).where((offset <= MAX_BUFFER) | (F.col("first_seq") > 4294967296 - MAX_BUFFER - 65536)).drop("first_seq")


def _firsts(packets: DataFrame, by: list[str]) -> DataFrame:
    return packets.groupBy(*by).agg(F.min_by("tcp_seq", "seq_num").alias("first_seq"))


def inspect(packets: DataFrame, key: tuple[str, ...] = KEY, per_direction: bool = False) -> DataFrame:
    """A row for each flow in which something was found: found_at (seq_num), sni, dpi_app.

    UDP payloads are looked into one by one, TCP ones as they are reassembled.
    """
    by = [*key, *(["src_ip", "src_port"] if per_direction else [])]
    seen = packets.where("payload_len > 0").select(*by, "seq_num", "has_tcp", "has_udp", "tcp_seq", "payload")
    tcp = seen.where("has_tcp").withColumn("tcp_seq", F.coalesce("tcp_seq", F.lit(0)))
    segment = F.struct("seq_num", "tcp_seq", F.lit(True).alias("tcp"), "payload")
    folded = _near(tcp, _firsts(tcp, by), by).groupBy(*by).agg(F.collect_list(segment).alias("segments")).withColumn("state", _fold())
    found = folded.where("state.at IS NOT NULL").select(*by, F.col("state.at").alias("found_at"), F.col("state.sni").alias("sni"), F.col("state.peer").alias("peer"))
    alone = seen.where("has_udp").select(*by, "seq_num", sni(F.col("payload")).alias("sni"), is_peer(F.col("payload")).alias("peer")).where("sni IS NOT NULL OR peer")
    first = F.min_by(F.struct(F.col("seq_num").alias("found_at"), "sni", (F.col("sni").isNull() & F.col("peer")).alias("peer")), "seq_num").alias("s")
    found = found.unionByName(alone.groupBy(*by).agg(first).select(*by, "s.*"))
    out = found.select(*by, "found_at", "sni", F.when(F.col("peer"), "BitTorrent").otherwise(app_of_host(F.col("sni"))).alias("dpi_app"))
    if per_direction:
        first = F.min_by(F.struct("found_at", "sni", "dpi_app"), "found_at").alias("s")
        out = out.groupBy(*key).agg(first).select(*key, "s.*")
    return out


def reassembled(packets: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row for each flow with TCP payloads: bytes and segments that were reassembled in order."""
    seen = packets.where((F.col("payload_len") > 0) & F.col("has_tcp"))
    segment = F.struct("seq_num", "tcp_seq", "payload_len")
    start = F.struct(F.lit(0).cast("bigint").alias("expected"), F.lit(0).cast("bigint").alias("bytes"), F.lit(0).cast("bigint").alias("segments"), F.lit(False).alias("full"))

    def step(s: Column, x: Column) -> Column:
        expected = F.when(s["expected"] == 0, x["tcp_seq"]).otherwise(s["expected"])
        hit = ~s["full"] & (x["tcp_seq"] == expected)
        over = hit & (s["bytes"] + x["payload_len"] > MAX_BUFFER)
        taken = hit & ~over
        return F.struct(
            F.when(taken, (expected + x["payload_len"]) % 4294967296).when(s["full"], s["expected"]).otherwise(expected).alias("expected"),
            (s["bytes"] + F.when(taken, x["payload_len"]).otherwise(0)).alias("bytes"), (s["segments"] + F.when(taken, 1).otherwise(0)).alias("segments"), (s["full"] | over).alias("full"),
        )

    folded = _near(seen, _firsts(seen, list(key)), list(key)).groupBy(*key).agg(F.aggregate(F.array_sort(F.collect_list(segment)), start, step).alias("s"))
    return folded.select(*key, F.col("s.bytes").alias("buffered"), F.col("s.segments").alias("segments"), F.col("s.full").alias("gave_up"))


#: Numbers of applications that a packet tells by itself.
_OWN = {name: k for k, name in enumerate(NAMES) if name not in GENERIC}


def own_app(key: tuple[str, ...] = KEY) -> list[Column]:
    """Aggregates of a flow: own_at (seq_num) and own_app of the first packet that tells an application by itself."""
    number = F.create_map(*(F.lit(x) for pair in _OWN.items() for x in pair))[F.col("pkt_app")]
    at = F.when(number.isNotNull(), F.col("seq_num"))
    return [F.min(at).alias("own_at"), app_name(F.min_by(number, at)).alias("own_app")]


def join_flows(packets: DataFrame, facts: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """packets with their flow's facts, which have a row for each flow. Packets of no flow are spread, so their null key is no hot one."""
    spread = F.coalesce(F.col(key[0]), F.concat(F.lit("~"), F.pmod(F.xxhash64("seq_num"), F.lit(65536))))
    names = {k: f"_{k}" for k in key}
    side = facts.withColumnsRenamed(names).withColumnRenamed(names[key[0]], "_first")
    on = (spread == F.col("_first")) & F.lit(True)
    for k in key[1:]:
        on = on & (F.col(k) == F.col(names[k]))
    return packets.join(side, on, "left").drop("_first", *names.values())


def state(packets: DataFrame) -> DataFrame:
    """packets that have their flow's facts, with sni_asof and app_asof."""
    known, own = F.col("seq_num") >= F.col("found_at"), F.col("seq_num") >= F.col("own_at")
    return packets.withColumns({"sni_asof": F.when(known, F.col("sni")), "app_asof": F.coalesce(F.when(known, F.col("dpi_app")), F.when(own, F.col("own_app")), F.lit("Unknown"))})


def as_of(packets: DataFrame, found: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """packets with sni_asof and app_asof: what is known of the flow once a packet has been seen."""
    own = packets.groupBy(*key).agg(*own_app(key)).where("own_at IS NOT NULL")
    facts = found.join(own, list(key), "full")
    return state(join_flows(packets, facts, key)).drop("found_at", "sni", "dpi_app", "own_at", "own_app")


def sessions(packets: DataFrame, key: tuple[str, ...] = KEY, gap_us: int = 60_000_000) -> DataFrame:
    """packets with session, from 0: a packet whose flow has been idle for the gap or longer begins a new one."""
    order = Window.partitionBy(*key).orderBy("seq_num")
    idle = F.col("ts_us") - F.lag("ts_us").over(order) >= gap_us
    return packets.withColumn("session", F.sum(F.when(idle, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def sharded(packets: DataFrame, n: int = 32, key: tuple[str, ...] = KEY) -> DataFrame:
    """packets dealt out by flow, so that operators by key that follow need no other shuffle."""
    return packets.repartition(n, *key)


def lookup(flows: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (src_ip, src_port, dst_ip, dst_port, ip_proto, addresses as bytes) with their flow's columns, null if there is none."""
    return canonical(probes.withColumn("has_icmp", F.col("ip_proto") == 1)).join(flows, list(KEY), "left")
