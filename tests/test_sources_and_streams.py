"""Capture files and streams of packets."""

from __future__ import annotations

import struct
import time

import pytest
from pyspark.sql import functions as F

from flowlens.operators import extract, flows, rules
from flowlens.plans import engine
from flowlens.queries import RULES
from flowlens.sources import pcap
from flowlens.streaming import fold, tracker

from . import frames as T


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(pcap.PcapSource)


def test_files_are_read_to_the_cut(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(T.capture())
    big = pcap.file_header()[:4][::-1] + struct.pack(">HHIIII", 2, 4, 0, 0, 65535, 1)
    (tmp_path / "b.pcap").write_bytes(big + struct.pack(">IIII", 5, 6, 3, 9) + b"abc" + struct.pack(">IIII", 5, 6, 70000, 70000) + b"x" * 70000 + struct.pack(">IIII", 5, 6, 1, 1) + b"z")
    (tmp_path / "_hidden").write_bytes(b"no")
    df = spark.read.format("pcap").load(str(tmp_path))
    assert df.count() == T.PACKETS + 1
    last = df.where("file like '%b.pcap'").collect()
    assert [(r.seq_num % (1 << pcap.FILE_BITS), r.ts_sec, r.ts_usec, r.incl_len, r.orig_len, bytes(r.frame)) for r in last] == [(1, 5, 6, 3, 9, b"abc")]


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"\x0a\x0d\x0d\x0a" + b"\0" * 40)
    with pytest.raises(Exception, match="not a capture file"):
        spark.read.format("pcap").load(str(tmp_path / "x")).count()


def test_what_is_written_is_read(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(T.capture())
    df = spark.read.format("pcap").load(str(tmp_path / "a.pcap"))
    out = str(tmp_path / "out")
    for mode in ("append", "append", "overwrite"):
        df.repartition(3).write.format("pcap").mode(mode).save(out)
    key = lambda d: sorted((r.ts_sec, r.ts_usec, r.orig_len, bytes(r.frame)) for r in d.collect())
    assert key(spark.read.format("pcap").load(out)) == key(df)
    df.coalesce(1).sortWithinPartitions("seq_num").write.format("pcap").mode("append").option("snaplen", 20).save(str(tmp_path / "cut"))
    cut = spark.read.format("pcap").load(str(tmp_path / "cut")).orderBy("seq_num").collect()
    assert all(r.incl_len == min(20, r.orig_len) for r in cut) and [r.seq_num for r in cut] == list(range(1, T.PACKETS + 1))


def test_interfaces():
    assert all(isinstance(n, str) for n, _ in pcap.interfaces())


def split_capture(folder, n):
    """The capture as n files, by time, which begins long after 1970: a watermark begins there."""
    records = [(sec + 1_700_000_000, *rest) for sec, *rest in pcap.records(str(folder / "whole.pcap"))]
    records.sort(key=lambda r: r[0])
    (folder / "in").mkdir()
    size = -(-len(records) // n)
    for k in range(n):
        (folder / "in" / f"{k:03}.pcap").write_bytes(pcap.file_header() + b"".join(pcap.record(s, u, f, o) for s, u, _, o, f in records[k * size : (k + 1) * size]))


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_a_streams_flows_are_those_of_a_batch(spark, tmp_path):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, 4)
    stream = spark.readStream.format("pcap").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    got = run(tracker.track(stream), spark, "tracked").where("not closed").groupBy(*flows.KEY).agg({"pkt_count": "max", "byte_count": "max"})
    batch = flows.aggregate(engine.packets(spark.read.format("pcap").load(str(tmp_path / "whole.pcap"))).where("parse_status = 'ok' AND ip_a IS NOT NULL")).select(*flows.KEY, "pkt_count", "byte_count")
    assert sorted(map(tuple, got.select(*flows.KEY, "max(pkt_count)", "max(byte_count)").collect())) == sorted(map(tuple, batch.collect()))


def by_frame(df):
    return sorted((bytes(r.frame), r.blocked, r.first_reason, r.sni_asof, r.app_asof) for r in df.collect())


@pytest.mark.parametrize("files", [2, 5])
def test_a_rotated_capture_is_judged_as_one_file(spark, tmp_path, files):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, files)
    r = rules.parse(RULES)
    load = lambda p: spark.read.format("pcap").load(str(p))
    one, many = (engine.judged(engine.packets(load(p)), r) for p in (tmp_path / "whole.pcap", tmp_path / "in"))
    assert by_frame(one) == by_frame(many) and many.where("blocked").count() == T.BLOCKED
    nets = spark.createDataFrame([(203 << 24 | 113 << 8 | 64, 27)], "address long, bits int")
    assert rules.join_networks(engine.packets(load(tmp_path / "in")), nets, "dst_ip4").count() == rules.join_networks(engine.packets(load(tmp_path / "whole.pcap")), nets, "dst_ip4").count()
    names = ("pkt_count", "byte_count", "sni", "app")
    assert sorted(repr([x[c] for c in (*flows.KEY, *names)]) for x in engine.flows(one).collect()) == sorted(repr([x[c] for c in (*flows.KEY, *names)]) for x in engine.flows(many).collect())


def test_a_stream_finds_and_judges_as_a_batch(spark, tmp_path):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, 4)
    r = rules.parse(RULES)
    stream = lambda: spark.readStream.format("pcap").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    got = run(tracker.judge(stream(), r, idle_ms=10**9), spark, "judged").select("seq_num", "blocked", "first_rule", "sni_asof", "app_asof")
    ok = engine.judged(engine.packets(spark.read.format("pcap").load(str(tmp_path / "in"))), r).where("parse_status = 'ok' AND ip_a IS NOT NULL")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, ok.select(*got.columns).collect())))
    last = run(tracker.track(stream(), r, idle_ms=10**9), spark, "tracked2").groupBy(*flows.KEY).agg(F.max_by(F.struct("sni", "app", "first_rule", "blocked_pkts"), "pkt_count").alias("s")).collect()
    assert sorted((x.s.app, x.s.blocked_pkts) for x in last) == sorted(zip(T.APPS, [2, 0, 4, 9, 0, 0, 0, 1, 0, 0, 0, 0], strict=True))


@pytest.mark.parametrize("p", [T.hello("a.b"), T.hello("x" * 99, session=b"s" * 32, before=bytes.fromhex("00170000") * 60), T.hello(""), T.hello("a.b")[:-1], T.hello("a.b") + b"more", b"", b"\x16" * 60, T.hello("a.b")[:44]])
def test_names_in_streams_are_those_in_batches(spark, p):
    got = spark.createDataFrame([(bytearray(p),)], "p binary").select(extract.sni(F.col("p")).alias("s")).first().s
    assert fold.server_name(p) == got


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, 6)
    late = [(tmp_path / "in" / f"{k:03}.pcap") for k in (4, 5)]
    held = [f.read_bytes() for f in late]
    for f in late:
        f.unlink()
    seen = []

    def go():
        load = spark.readStream.format("pcap").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
        q = load.writeStream.foreachBatch(lambda df, k: seen.extend(r[0] for r in df.select("seq_num").collect())).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    go()
    for f, b in zip(late, held, strict=True):
        f.write_bytes(b)
    go()
    assert len(seen) == len(set(seen)) == T.PACKETS


def test_ticks_of_a_stream(spark, tmp_path):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, 2)
    rates = tracker.Rates()
    spark.streams.addListener(rates)
    try:
        q = tracker.observed(spark.readStream.format("pcap").load(str(tmp_path / "in"))).writeStream.format("noop").start()
        q.processAllAvailable()
        q.stop()
        for _ in range(50):
            if sum(t["packets"] for t in rates.ticks) == T.PACKETS:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(rates)
    assert sum(t["packets"] for t in rates.ticks) == T.PACKETS and any(t.get("capture", {}).get("packets") for t in rates.ticks)


def test_idle_flows_are_closed_and_not_lost(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    frame = lambda host, sec: pcap.record(sec, 0, T.ethernet(T.ipv4(host, "9.9.9.9", 6, T.tcp(1, 2))))
    for k, rows in enumerate(([("10.0.0.1", 100), ("10.0.0.1", 101)], [("10.0.0.2", 200)], [("10.0.0.3", 400)], [("10.0.0.4", 500)])):
        (folder / f"{k}.pcap").write_bytes(pcap.file_header() + b"".join(frame(*r) for r in rows))
    stream = spark.readStream.format("pcap").option("maxFilesPerTrigger", 1).load(str(folder))
    closed = run(tracker.track(stream), spark, "closed").where("closed").collect()
    assert {r.ip_b if r.ip_b.startswith("0A") else r.ip_a: r.pkt_count for r in closed}.get("0A000001") == 2


def test_sliding_rates_and_sessions(spark, tmp_path):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, 3)
    load = lambda: spark.readStream.format("pcap").load(str(tmp_path / "in"))
    pps = run(tracker.sliding_pps(load()), spark, "pps", "complete").collect()
    assert max(r.pps for r in pps) * 10 <= T.PACKETS and abs(sum(r.pps for r in pps) - T.PACKETS) < 1e-6
    whole = run(tracker.sessions(load(), gap="15 seconds"), spark, "sessions", "append")
    # The watermark is ten seconds behind the last packet, so sessions that end before 200 - 10 - 15 are told.
    assert whole.agg(F.sum("pkt_count")).first()[0] >= 48 and whole.where("session_window.end > timestamp_seconds(1700000200)").count() == 0
    seen = []
    tracker.each_batch(load(), lambda df, k: seen.append(df.count())).trigger(availableNow=True).start().awaitTermination(120)
    assert sum(seen) == T.PACKETS


def test_captures_are_observed_and_replayed(spark, tmp_path):
    (tmp_path / "whole.pcap").write_bytes(T.capture())
    split_capture(tmp_path, 2)
    q = tracker.observed(spark.readStream.format("pcap").load(str(tmp_path / "in"))).writeStream.format("noop").start()
    try:
        q.processAllAvailable()
        seen = [p["observedMetrics"]["capture"] for p in q.recentProgress if p["observedMetrics"].get("capture")]
    finally:
        q.stop()
    assert sum(r["packets"] for r in seen) == T.PACKETS and all(r["cut_off"] == 0 for r in seen)
    rounds = []
    tracker.replay(lambda: spark.read.format("pcap").load(str(tmp_path / "in")), lambda df, k: rounds.append((k, df.count())), 3)
    assert rounds == [(k, T.PACKETS) for k in range(3)]
