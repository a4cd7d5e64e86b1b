"""Decoding, extraction, flows, rules and reports on known frames."""

from __future__ import annotations

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.functions import binary, net, web
from flowlens.operators import anomaly, extract, flows, rates, reports, rules
from flowlens.operators.decode import decode, quick_tuple
from flowlens.plans import engine
from flowlens.queries import RULES

from . import frames as T


def raw(spark, frames):
    return spark.createDataFrame([(k, bytearray(f), k, 0, len(f)) for k, f in enumerate(frames, 1)], "seq_num long, frame binary, ts_sec long, ts_usec int, incl_len int")


def one(spark, frame, **options):
    return decode(raw(spark, [frame]), **options).first()


def test_a_loopback_frame(spark):
    frame = bytes.fromhex("02005e10000202005e1000010800" + "450000281a2b40003f0600007f0000017f000001" + "1f901f91000000070000000050020fff00000000")
    r = one(spark, frame)
    assert (r.src_ip_str, r.dst_ip_str, r.src_port, r.dst_port, r.ip_proto, r.ttl, r.ip_id, r.ip_total_len) == ("127.0.0.1", "127.0.0.1", 8080, 8081, 6, 63, 0x1A2B, 40)
    assert (r.is_fragment, r.tcp_seq, r.tcp_flags, r.window_size, r.payload_len, r.parse_status) == (False, 7, 2, 4095, 0, "ok")
    assert (r.dst_mac, r.src_mac, r.vlan_depth) == ("02:00:5e:10:00:02", "02:00:5e:10:00:01", 0)


def test_a_minimal_frame_of_zeros(spark):
    frame = bytearray(54)
    frame[12:14], frame[14], frame[23], frame[26:30], frame[30:34], frame[34:38] = b"\x08\x00", 0x45, 6, T.ip("10.0.0.1"), T.ip("10.0.0.2"), struct.pack(">HH", 50123, 443)
    r = engine.packets(raw(spark, [bytes(frame)])).withColumn("bytes", flows.flow_bytes()).first()
    assert (r.parse_status, r.payload, r.payload_len, r.bytes, r.src_port, r.dst_port) == ("ok", None, 0, 64, 50123, 443)


@pytest.mark.parametrize("frame, status", [(b"", "malformed"), (b"\0" * 13, "malformed"), (T.ethernet(b"\x45" + b"\0" * 5), "malformed"), (T.ethernet(T.ipv4("1.2.3.4", "5.6.7.8", 6, b"", ihl=5)), "ok"), (T.ethernet(b"\x44" + T.ipv4("1.2.3.4", "5.6.7.8", 6, b"")[1:]), "malformed"), (T.ethernet(b"\0" * 28, 0x0806), "ok"), (T.ethernet(b"\x60" + b"\0" * 20, 0x86DD), "malformed")])
def test_frames_that_are_too_short(spark, frame, status):
    assert one(spark, frame).parse_status == status


def test_arp_icmp_fragments_options_and_offsets(spark):
    assert one(spark, T.ethernet(b"\0" * 28, 0x0806)).pkt_app == "ARP"
    icmp = one(spark, T.ethernet(T.ipv4("1.2.3.4", "5.6.7.8", 1, b"\x08\0\0\0")))
    assert (icmp.pkt_app, icmp.has_icmp, icmp.src_port) == ("ICMP", True, None)
    for frag in (0x2000, 0x0005):
        r = one(spark, T.ethernet(T.ipv4("1.2.3.4", "5.6.7.8", 6, T.tcp(1, 2, b"x"), frag=frag)))
        assert (r.is_fragment, r.has_tcp, r.parse_status) == (True, False, "ok")
    r = one(spark, T.ethernet(T.ipv4("1.2.3.4", "5.6.7.8", 6, T.tcp(1, 2, b"data"), ihl=15)))
    assert (r.src_port, bytes(r.payload)) == (1, b"data")
    r = one(spark, T.ethernet(T.ipv4("1.2.3.4", "5.6.7.8", 6, T.tcp(1, 2, b"data", doff=4))))
    assert (r.src_port, r.payload) == (1, None)


def odd_frames(rng):
    """Whole frames of all kinds, and the same with bytes cut off, added or changed."""
    out = [T.ethernet(b""), b"", *(f for _, f in T.visits()[::5]), *(f for _, f in T.others())]
    for _ in range(250):
        l4 = rng.choice([T.tcp(rng.randrange(65536), 443, b"x" * rng.randrange(9), doff=rng.randrange(16)), T.udp(53, 7, b"q" * rng.randrange(5)), b"\x08\0\0\0", b"", b"\x11\0" + b"\0" * 6 + T.udp(1, 2, b"z")])
        proto = rng.choice([1, 6, 17, 58, 0, 43, 99])
        tags = tuple((rng.choice([0x8100, 0x88A8]), rng.randrange(4096)) for _ in range(rng.choice([0, 0, 1, 2, 3])))
        if rng.random() < 0.5:
            f = T.ethernet(T.ipv4("10.0.0.1", "10.0.0.2", proto, l4, frag=rng.choice([0, 0x4000, 0x2000, 5]), ihl=rng.choice([5, 5, 6, 15])), tags=tags)
        else:
            chain = b"".join(bytes([rng.choice([0, 43, 60, 6, 17]), rng.randrange(3)]) + bytes(6 + 8 * rng.randrange(3)) for _ in range(rng.randrange(4)))
            f = T.ethernet(struct.pack(">IHBB", 0x60000000, len(chain + l4), rng.choice([proto, 0, 43, 60]), 64) + rng.randbytes(32) + chain + l4, 0x86DD, tags)
        f = bytearray(f + b"\0" * rng.choice([0, 0, 6]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            f[rng.randrange(len(f))] = rng.randrange(256)
        out.append(bytes(f[: rng.randint(0, len(f))] if rng.random() < 0.3 else f))
    return out


@pytest.mark.parametrize("options", [{}, {"mode": "strict"}, {"trim_padding": True, "through_icmpv6": True}])
def test_both_ways_of_decoding_agree(spark, options):
    table = raw(spark, odd_frames(random.Random(repr(options))))
    a, b = (decode(table, arrow=arrow, **options) for arrow in (True, False))
    assert a.dtypes == b.dtypes
    for x, y in zip(a.orderBy("seq_num").collect(), b.orderBy("seq_num").collect(), strict=True):
        assert x == y
    some = decode(table, fields=("payload", "src_ip_str"), **options)
    assert some.columns == [*table.columns, "src_ip_str", "payload"] and some.count() == table.count()


def test_tags(spark):
    inner = T.ipv4("1.2.3.4", "5.6.7.8", 17, T.udp(5, 6, b"x"))
    assert one(spark, T.ethernet(inner, tags=((0x8100, 10),))).dst_port == 6
    two = T.ethernet(inner, tags=((0x88A8, 20), (0x8100, 10)))
    assert one(spark, two).ip_version is None and (one(spark, two, mode="strict").vlan_depth, one(spark, two, mode="strict").dst_port) == (2, 6)
    assert quick_tuple(raw(spark, [two])).first().quick is None


def ipv6(first, rest):
    return T.ethernet(struct.pack(">IHBB", 0x60000000, len(rest), first, 64) + bytes.fromhex("20010db8" + "00" * 12) + bytes.fromhex("fe80" + "00" * 14) + rest, 0x86DD)


def test_ipv6_and_its_extension_headers(spark):
    u = T.udp(5, 6, b"hey")
    for first, rest in ((17, u), (0, b"\x11\0" + b"\0" * 6 + u), (0, b"\x3c\0" + b"\0" * 6 + b"\x11\x01" + b"\0" * 14 + u)):
        r = one(spark, ipv6(first, rest))
        assert (r.ip_proto, r.src_port, bytes(r.payload), r.src_ip_str) == (17, 5, b"hey", "2001:0db8" + ":0000" * 6)
    assert one(spark, ipv6(58, b"\x80\0" + b"\0" * 14)).ip_proto == 58
    assert one(spark, ipv6(0, b"\x11\xff" + b"\0" * 6)).parse_status == "ok"


def sni_of(spark, payload):
    return spark.createDataFrame([(bytearray(payload),)], "p binary").select(extract.sni(F.col("p")).alias("s")).first().s


def test_walks_end_where_the_bytes_do(spark):
    u = T.udp(5, 6, b"hey")
    chain = (b"\x3c\0" + b"\0" * 6) * 39 + b"\x11\0" + b"\0" * 6
    assert one(spark, ipv6(0, chain + u)).src_port == 5
    tags = ((0x88A8, 1),) * 30 + ((0x8100, 2),)
    r = one(spark, T.ethernet(T.ipv4("1.2.3.4", "5.6.7.8", 17, u), tags=tags), mode="strict")
    assert (r.vlan_depth, r.dst_port) == (31, 6)
    assert sni_of(spark, T.hello("late.example", before=bytes.fromhex("00170000") * 200)) == "late.example"


def test_keys_with_the_last_byte_first(spark):
    frames = [T.ethernet(T.ipv4("10.0.0.9", "20.0.0.1", 6, T.tcp(1, 2))), T.ethernet(T.ipv4("20.0.0.1", "10.0.0.9", 6, T.tcp(2, 1)))]
    keys = {tuple(r[k] for k in flows.KEY) for r in flows.canonical(decode(raw(spark, frames)), compat_le=True).collect()}
    assert keys == {("01000014", 2, "0900000A", 1, 6)}


def test_an_exchange_without_a_name(spark):
    got = engine.flows(engine.known(engine.packets(raw(spark, T.exchange())))).collect()
    assert [(r.pkt_count, r.sni, r.app) for r in got] == [(5, None, "Unknown")]


def test_server_names(spark):
    for host, options in (("www.example.com", {}), ("a.b", {"session": b"\xee" * 32, "before": bytes.fromhex("000a00040002001d" + "002b0003020304" + "00170000")}), ("x" * 200, {}), ("", {})):
        assert sni_of(spark, T.hello(host, **options)) == host
    whole = T.hello("www.example.com")
    assert [sni_of(spark, whole[:n]) for n in (0, 43, 44, 60, len(whole) - 1)] == [None] * 5
    assert sni_of(spark, b"\x17" + whole[1:]) is None and sni_of(spark, whole + b"more") == "www.example.com"


def test_hosts_and_requests(spark):
    hosts = [(b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n", "example.com"), (b"POST /a HTTP/1.1\r\nhost: a.b:80\r\n\r\n", "a.b"), (b"GET / HTTP/1.1\r\nHOST: [::1]:8080\r\n", "[::1]"), (b"GET / HTTP/1.1\r\nhOsT: no.no\r\n\r\n", None), (b"get / HTTP/1.1\r\nHost: a\r\n", None), (b"GET /\r\nHost: \r\n\r\n\r\n", None), (b"", None)]
    got = spark.createDataFrame([(k, bytearray(p)) for k, (p, _) in enumerate(hosts)], "k int, p binary").select("k", web.http_host(F.col("p")).alias("h")).collect()
    assert [r.h for r in sorted(got)] == [h for _, h in hosts]
    text = "GET http://a.b/c HTTP/1.1\r\nHost:  a.b:81 \r\nAccept: x\r\n\r\nHost: body"
    r = spark.createDataFrame([(text,)], "t string").select(web.parse_request(F.col("t")).alias("r")).first().r
    assert (r.method, r.path, r.host, r.port) == ("GET", "http://a.b/c", "a.b", 81) and r.headers == "Host:  a.b:81 \nAccept: x"


def test_urls_and_escapes(spark):
    urls = [("google.com", "https://google.com"), ("http://a.b/c:1", "http://a.b/c:1"), ("A" * 300, None), ("google.com; cat /etc/passwd", None), ("", None)]
    got = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "k int, u string").select("k", web.sanitise_url(F.col("u")).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [s for _, s in urls]


@given(st.binary(max_size=60))
@settings(max_examples=20, deadline=None)
def test_entropy(spark, data):
    import collections
    import math

    n = len(data)
    want = -sum(c / n * math.log2(c / n) for c in collections.Counter(data).values()) if n else 0.0
    got = spark.createDataFrame([(bytearray(data),)], "p binary").select(binary.entropy(F.col("p")).alias("e")).first().e
    assert math.isclose(got, want, abs_tol=1e-9)


def test_addresses(spark):
    r = spark.createDataFrame([("1.2.3.4", "256.1.1.1", "1.2.3", "01.2.3.4x")], "a string, b string, c string, d string").select(*(net.ipv4_number(F.col(c)).alias(c) for c in "abcd")).first()
    assert tuple(r) == (0x01020304, None, None, None)


# --- flows ---


def segments(rows):
    """(expected buffer, found) by a plain state machine."""
    expected, buffer, full, found = 0, b"", False, None
    for seq, number, payload in rows:
        if found is not None or not payload:
            continue
        if full:
            continue
        expected = expected or number
        if number != expected:
            continue
        if len(buffer) + len(payload) > flows.MAX_BUFFER:
            full = True
            continue
        buffer += payload
        expected = (expected + len(payload)) % 2**32
        if buffer.startswith(b"\x16") and len(buffer) >= 44 and b"www.split.com" in buffer:
            found = seq
        elif buffer.startswith(extract.PEER_PREFIX):
            found = seq
    return found


@pytest.mark.parametrize("seed", range(4))
def test_reassembly_is_that_of_a_state_machine(spark, seed):
    rng, frames, want = random.Random(seed), [], {}
    for flow in range(12):
        kind = rng.choice(["hello", "peer", "long", "junk"])
        stream = {"hello": T.hello("www.split.com"), "peer": extract.PEER_PREFIX + b"x" * 30, "long": b"\0" * 20000, "junk": b"junk" * 20}[kind]
        base, at, parts = rng.choice([1, 1000, 2**32 - 40]), 0, []
        while at < len(stream):
            n = rng.choice([10, 40, 3000])
            parts.append(((base + at) % 2**32, stream[at : at + n]))
            at += n
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(1, len(parts)), rng.choice(parts))
        rows = []
        for number, payload in parts:
            frames.append(T.ethernet(T.ipv4(f"10.0.0.{flow}", "9.9.9.9", 6, T.tcp(5000, 443, payload, seq=number))))
            rows.append((len(frames), number, payload))
        want[f"0A0000{flow:02X}"] = segments(rows)
    got = flows.inspect(engine.packets(raw(spark, frames))).collect()
    by = {(r.ip_a if r.ip_a.startswith("0A") else r.ip_b): r.found_at for r in got}
    assert by == {k: v for k, v in want.items() if v is not None}


def test_keys_are_those_of_either_direction(spark):
    rng, frames = random.Random(1), []
    for _ in range(40):
        a, b, p, q = f"10.0.{rng.randrange(3)}.1", f"10.0.{rng.randrange(3)}.1", rng.randrange(1, 4), rng.randrange(1, 4)
        frames += [T.ethernet(T.ipv4(a, b, 6, T.tcp(p, q))), T.ethernet(T.ipv4(b, a, 6, T.tcp(q, p)))]
    keys = [tuple(r[k] for k in flows.KEY) for r in engine.packets(raw(spark, frames)).orderBy("seq_num").collect()]
    assert keys[::2] == keys[1::2]


def test_sessions_begin_at_the_gap(spark):
    t = spark.createDataFrame([("a", k, s * 1_000_000) for k, s in enumerate((0, 59, 119, 178, 238))], "k string, seq_num long, ts_us long")
    assert [r.session for r in flows.sessions(t, ("k",)).orderBy("seq_num").collect()] == [0, 0, 1, 1, 2]


# --- the whole capture ---


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    from flowlens.sources.pcap import PcapSource

    path = tmp_path_factory.mktemp("capture") / "a.pcap"
    path.write_bytes(T.capture())
    spark.dataSource.register(PcapSource)
    decoded = engine.packets(spark.read.format("pcap").load(str(path)))
    return engine.judged(decoded, rules.parse(RULES)).cache()


def test_the_capture_gives_what_it_should(judged):
    s = reports.stats(judged).first()
    assert (s.packets_total, s.tcp, s.udp, s.icmp, s.blocked, s.forwarded, s.malformed) == (T.PACKETS, T.TCP, T.UDP, T.ICMP, T.BLOCKED, T.PACKETS - T.BLOCKED - T.MALFORMED, T.MALFORMED)
    f = engine.flows(judged).collect()
    assert len(f) == T.FLOWS and sorted(r.app for r in f) == sorted(T.APPS)
    assert {r.type: r.hits for r in reports.rule_matches(judged).collect()} == {"ip": 9, "domain": 4, "port": 1, "app": 2}
    hits = {(r.type, r.rule): r.hits for r in reports.rule_hits(judged, rules.parse(RULES)).collect()}
    assert hits == {("ip", "203.0.113.64/27"): 9, ("domain", "nflxvideo.example"): 4, ("port", "6999"): 1, ("app", "YouTube"): 2}
    top = reports.top(reports.domains(engine.flows(judged)), "packets", "domain", reports.TOP_DOMAINS).collect()
    assert [(r.domain, r.packets) for r in top] == [("plain.example", 11), ("pbs.twimg.example", 9), ("raw.github.example", 9), ("fonts.gstatic.example", 7), ("s1.nflxvideo.example", 7), ("v3.ytimg.example", 5)]
    assert abs(sum(r.share for r in top) - 100) < 1e-9


def test_blocks_stick(judged):
    seen: dict = {}
    for r in judged.orderBy("seq_num").collect():
        k = tuple(r[c] for c in flows.KEY)
        assert r.blocked or not seen.get(k)
        seen[k] = r.blocked
        assert r.blocked == (r.first_reason is not None)


def test_reports(judged):
    staged = reports.stages(judged)
    assert [(r.stage, r.packets) for r in staged.orderBy("pos").collect()] == [("reader", 59), ("parser", 58), ("dpi", 58), ("rules", 58), ("drop", 16), ("forward", 42)]
    assert tuple(reports.bottleneck(staged).first()) == ("forward", 16)
    text = reports.summary_text(judged, engine.flows(judged))
    assert f"Packets   {T.PACKETS}" in text and "pbs.twimg.example" in text
    assert len(reports.flow_json(engine.flows(judged)).collect()) == T.FLOWS
    views = reports.views(judged, engine.flows(judged), rules.parse(RULES))
    assert {k: v.count() for k, v in views.items() if k in ("stats", "alerts", "domains", "flows")} == {"stats": 1, "alerts": T.BLOCKED, "domains": 6, "flows": T.FLOWS}


def test_json_and_metrics(judged, tmp_path):
    import json

    out = json.loads(reports.summary_json(judged, engine.flows(judged)).first().json)
    assert out["stats"]["blocked"] == T.BLOCKED and len(out["flows"]) == T.FLOWS and {f["app"] for f in out["flows"]} >= {"YouTube", "BitTorrent"}
    reports.export_metrics(judged, str(tmp_path / "m"))
    row = json.loads(next((tmp_path / "m").glob("part-*.json")).read_text())
    assert (row["packets_total"], row["packets_blocked"], row["block_rate"]) == (T.PACKETS, T.BLOCKED, round(100 * T.BLOCKED / T.PACKETS, 2))


def test_flows_are_dealt_out_by_key(judged):
    shards = flows.sharded(judged, 4).withColumn("shard", F.spark_partition_id())
    assert shards.groupBy(*flows.KEY).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_scores(spark):
    r = spark.createDataFrame([(4.0, 10000, 15000, 99999)], "e double, a int, b int, c int").select(anomaly.entropy_score(F.col("e")), *(anomaly.burst_score(F.col(c)) for c in "abc")).first()
    assert tuple(r) == (0.5, 0.0, 0.25, 1.0)


# --- rules ---


def test_rules_that_are_none_are_left_out():
    r = rules.RuleSet()
    assert [r.add_ip(x) for x in ("10.0.0.0/8", "1.2.3.4", "::1", "10.0.0.0/33", "x", "1.2.3.4/-1")] == [True, True, True, False, False, False]
    assert [r.add_port(x) for x in (0, 65535, 70000, "abc", -1)] == [True, True, False, False, False]
    assert r.add_app("YouTube") and not r.add_app("zoom") and r.add_domain("Ads.COM") and not r.add_domain("") and not r.add_domain("x" * 257) and not r.add("what", "x")
    assert len(r) == 7 and r.domains == ["ads.com"]


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(RULES)
    got = rules.read(spark, str(tmp_path / "r.json"))
    assert got == rules.parse(RULES) and len(got) == 5 and got.ports == [6999] and (got.loaded, got.refused) == (5, 0)


def test_many_networks_are_joined_as_few_are_folded(spark):
    rng = random.Random(2)
    nets = [(rng.randrange(1 << 32) >> (32 - b) << (32 - b), b) for b in (0, 1, 8, 12, 24, 32) for _ in range(1 if b == 0 else 4)][1:]
    ips = [rng.randrange(1 << 32) for _ in range(300)] + [a for a, _ in nets]
    p = spark.createDataFrame(list(enumerate(ips)), "seq_num long, src_ip4 long")
    joined = rules.join_networks(p, spark.createDataFrame(nets, "address long, bits int"), "src_ip4")
    import ipaddress

    folded = p.where(rules.in_networks4(F.col("src_ip4"), [ipaddress.ip_network((a, b)) for a, b in nets]))
    assert sorted(joined.collect()) == sorted(folded.collect())


def test_networks_beyond_the_folded_are_looked_up_alike(spark, monkeypatch):
    rng, four, six = random.Random(4), rules.RuleSet(), rules.RuleSet()
    for _ in range(30):
        b = rng.choice([0, 1, 7, 8, 13, 24, 31, 32]) if _ else 9
        four.add_ip(f"{rng.randrange(256)}.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}/{b or 3}")
        six.add_ip(f"2001:db8:{rng.randrange(9):x}::{rng.randrange(99):x}/{rng.choice([40, 44, 45, 47, 48, 120, 126, 128])}")
    rows = [(k, rng.randrange(1 << 32), rng.randrange(1 << 32), bytearray(bytes.fromhex("20010db8") + bytes([0, rng.randrange(9)]) + bytes(9) + bytes([rng.randrange(99)])), None) for k in range(400)]
    p = spark.createDataFrame(rows, "seq_num long, src_ip4 long, dst_ip4 long, src_ip binary, dst_ip binary")
    for r in (four, six):
        few = sorted(map(tuple, rules.network_rule(p, r).select("seq_num", "net_rule").collect()))
        with monkeypatch.context() as m:
            m.setattr(rules, "FOLDED", 0)
            assert sorted(map(tuple, rules.network_rule(p, r).select("seq_num", "net_rule").collect())) == few
        assert any(n is not None for _, n in few)


def test_what_loading_comes_to(spark, tmp_path):
    into = rules.RuleSet()
    (tmp_path / "good").write_text('{"rules": [{"type": "port", "value": 80}, {"type": "port", "value": 70000}, {"type": "app", "value": "netflix"}, {"type": "ip"}, {"type": "domain", "value": "A.b"}]}')
    (tmp_path / "bad").write_text("{no json")
    (tmp_path / "other").write_text('{"what": 1}')
    assert [rules.load(spark, str(tmp_path / n), into) for n in ("good", "bad", "other", "none")] == [3, -1, -1, -1]
    assert (into.ports, into.apps, into.domains, into.loaded, into.refused) == ([80], ["Netflix"], ["a.b"], 3, 2)


def test_a_late_block_and_an_own_application(spark):
    """A port's rule before a name's, ICMP as a blocked application, and packets of no flow."""
    r = rules.RuleSet(apps=["ICMP"], domains=["split"], ports=[9])
    said = T.hello("www.split.com")
    frames = [
        T.ethernet(T.ipv4("1.1.1.1", "2.2.2.2", 6, T.tcp(5, 443, said[:30], seq=50))), T.ethernet(T.ipv4("1.1.1.1", "2.2.2.2", 6, T.tcp(5, 443, b"x" * 40, seq=7))), T.ethernet(T.ipv4("1.1.1.1", "2.2.2.2", 6, T.tcp(5, 443, said[30:], seq=80))),
        T.ethernet(T.ipv4("2.2.2.2", "1.1.1.1", 6, T.tcp(443, 5, b"y", seq=3))), T.ethernet(T.ipv4("3.3.3.3", "4.4.4.4", 1, b"")), T.ethernet(T.ipv4("4.4.4.4", "3.3.3.3", 1, b"\x08\0\0\0")), T.ethernet(T.ipv4("3.3.3.3", "4.4.4.4", 1, b"")),
        T.ethernet(b"\0" * 28, 0x0806), b"bad", T.ethernet(T.ipv4("5.5.5.5", "6.6.6.6", 17, T.udp(8, 9, said))), T.ethernet(T.ipv4("6.6.6.6", "5.5.5.5", 17, T.udp(9, 8, b"z"))),
    ]
    got = [(x.reason, x.blocked, x.first_reason) for x in engine.judged(engine.packets(raw(spark, frames)), r).orderBy("seq_num").collect()]
    free, named, app = (None, False, None), ("domain", True, "domain"), ("app", True, "app")
    assert got == [free, free, named, named, free, app, app, free, free, ("port", True, "port"), ("domain", True, "port")]


def test_frames_are_read_and_decoded_once(spark, sf):
    """Findings and verdicts look at a stored table; nothing above it decodes, crosses or windows."""
    from flowlens import queries

    text = queries.verdict_reason(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "events.parquet" not in text and "Window" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_patterns_and_wildcards(spark):
    d = spark.createDataFrame([("A.FaceBook.com",), ("x",), (None,)], "h string")
    assert [r.x for r in d.select(rules.domain_hit(F.col("h"), ["facebook.com"]).alias("x")).collect()] == [True, False, False]
    assert [r.x for r in d.select(rules.domain_hit(F.col("h"), ["facebook.com"], False).alias("x")).collect()] == [False, False, False]


# --- rates and findings ---


def test_percentiles_of_a_histogram(spark):
    hist = rates.histogram(spark.createDataFrame([(x,) for x in [0] * 49 + [5] * 50 + [99999]], "latency_us long"))
    assert tuple(rates.percentiles(hist).first()) == (5, 5)
    assert tuple(rates.percentiles(hist.limit(0)).first()) == (0, 0)


def test_bursts_literal_and_meant(spark):
    rows = spark.createDataFrame([("d", k, k * 1000) for k in range(400)], "domain string, seq_num long, ts_us long")
    assert anomaly.bursts(rows, threshold=19).agg(F.max("pps")).first()[0] == 20
    assert anomaly.bursts(rows, threshold=19, literal=False).agg(F.max("pps")).first()[0] == 80
    assert anomaly.bursts(rows).count() == 0
    slow = spark.createDataFrame([("d", k, k * 7_000_000) for k in range(40)] + [("e", 100 + k, 59_000_000 + k * 100_000) for k in range(30)], "domain string, seq_num long, ts_us long")
    got = {r.seq_num: r.pps for r in anomaly.bursts(slow, threshold=1).collect()}
    assert got == {100 + k: (k + 1) // 5 for k in range(9, 30)}


def test_a_burst_threshold_of_nothing(spark):
    assert anomaly.frequency(spark.createDataFrame([], "domain string, ts_us long")).count() == 0
