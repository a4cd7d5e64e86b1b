"""Flows over a stream of packets: keyed state with names and verdicts, a TTL in event time, metrics by micro-batch."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.decode import decode
from ..operators.flows import KEY, canonical, flow_bytes
from ..operators.rules import RuleSet, network_rule
from .fold import STATE, Flow

IDLE_MS = 60_000
_KEY = "ip_a string, port_a int, ip_b string, port_b int, ip_proto int"
FLOW = f"{_KEY}, pkt_count long, byte_count long, first_us long, last_us long, sni string, app string, first_rule int, blocked_pkts long, closed boolean"
PACKET = f"{_KEY}, seq_num long, ts timestamp, sni_asof string, app_asof string, blocked boolean, first_rule int"
_SEEN = ("seq_num", "ts", "ts_us", "size", "has_tcp", "has_udp", "tcp_seq", "payload", "pkt_app", "static")


def packets(stream: DataFrame) -> DataFrame:
    """Decoded packets of a stream of frames, with event time and key."""
    out = canonical(decode(stream)).where("parse_status = 'ok' AND src_ip IS NOT NULL")
    return out.withColumn("ts_us", F.unix_micros("ts")).withColumn("size", flow_bytes().cast("long"))


def _folded(stream: DataFrame, rules: RuleSet | None, delay: str, idle_ms: int, by_packet: bool) -> DataFrame:
    rules = rules or RuleSet()
    apps: dict[str, int] = {}
    for k, a in enumerate(rules.apps, rules.first("app")):
        apps.setdefault(a, k)
    domains = [(d, k) for k, d in enumerate(rules.domains, rules.first("domain"))]
    ports = {p: k for k, p in reversed(list(enumerate(rules.ports, rules.first("port"))))}
    flow_names = [c.split()[0] for c in FLOW.split(", ")]
    packet_names = [c.split()[0] for c in PACKET.split(", ")]
    held_names = [c.split()[0] for c in STATE.split(", ")]
    result = [c for c in flow_names if c in held_names]
    told = lambda flow: [(flow.app or "Unknown") if c == "app" else getattr(flow, c) for c in result]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flow = Flow(*state.get) if state.exists else Flow()
        if state.hasTimedOut:
            state.remove()
            if not by_packet:
                yield pd.DataFrame([(*key, *told(flow), True)], columns=flow_names)
            return
        seen = pd.concat(parts).sort_values("seq_num")
        none = lambda x: None if x is None or x != x else x
        rows = []
        for seq, ts, ts_us, size, tcp, udp, number, payload, own, static in seen[list(_SEEN)].itertuples(index=False, name=None):
            number, static = none(number), none(static)
            rule = flow.add(int(ts_us), int(size), bool(tcp), bool(udp), None if number is None else int(number), payload, own, None if static is None else int(static), apps, domains)
            if by_packet:
                rows.append((*key, seq, ts, flow.sni, flow.app or "Unknown", rule is not None, rule))
        state.update(tuple(getattr(flow, c) for c in held_names))
        newest = max(int(seen["ts_us"].max()) // 1000, state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + idle_ms)
        if by_packet:
            out = pd.DataFrame(rows, columns=packet_names)
            yield out.astype({"first_rule": "Int32"})
        else:
            yield pd.DataFrame([(*key, *told(flow), False)], columns=flow_names).astype({"first_rule": "Int32"})

    port = F.create_map(*(F.lit(x) for pair in ports.items() for x in pair))[F.col("dst_port")] if ports else F.lit(None).cast("int")
    held = network_rule(packets(stream), rules).withColumn("static", F.coalesce("net_rule", port))
    held = held.select(*KEY, *_SEEN).withWatermark("ts", delay)
    return held.groupBy(*KEY).applyInPandasWithState(run, PACKET if by_packet else FLOW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def track(stream: DataFrame, rules: RuleSet | None = None, delay: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """A row for a flow that got packets, and one, closed, when it has been idle: none is lost.

    It has the flow's counters, its name and application so far, and the rule that blocks it. Rows of a batch are put in
    order of seq_num, as a shuffle keeps none. A flow's state is what fold.Flow holds, MAX_BUFFER bytes of payload at most,
    so it is bounded by the number of live flows; the watermark closes those that are idle.
    """
    return _folded(stream, rules, delay, idle_ms, False)


def judge(stream: DataFrame, rules: RuleSet, delay: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """Each packet with what is known of its flow once it has been seen, and its verdict, as judged() of a batch gives it."""
    return _folded(stream, rules, delay, idle_ms, True)


def sliding_pps(stream: DataFrame, delay: str = "10 seconds", seconds: int = 10) -> DataFrame:
    """Packets a second over the last seconds, every second, in event time."""
    window = F.window("ts", f"{seconds} seconds", "1 second")
    return stream.withWatermark("ts", delay).groupBy(window).agg((F.count("*") / seconds).alias("pps"))


def sessions(stream: DataFrame, gap: str = "60 seconds", delay: str = "10 seconds") -> DataFrame:
    """Flows' sessions with their packets and bytes, once the watermark has passed the gap."""
    return packets(stream).withWatermark("ts", delay).groupBy(*KEY, F.session_window("ts", gap)).agg(F.count("*").alias("pkt_count"), F.sum("size").alias("byte_count"))


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], every: str = "1 second") -> DataStreamWriter:
    """Calls sink with each micro-batch: for metrics files and alerts."""
    return stream.writeStream.foreachBatch(sink).trigger(processingTime=every)


def observed(stream: DataFrame, name: str = "capture") -> DataFrame:
    """stream, with packets, bytes and cut-off packets of each micro-batch among its query's progress."""
    cut_off = F.count_if(F.col("orig_len") > F.col("incl_len"))
    return stream.observe(name, F.count("*").alias("packets"), F.sum("incl_len").alias("bytes"), cut_off.alias("cut_off"))


class Rates(StreamingQueryListener):
    """Keeps the newest ticks of the session's queries: packets a second, seconds of the batch, and what observed() counts."""

    def __init__(self, most: int = 60):
        self.ticks: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        counts = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
        self.ticks.append({"batch": p.batchId, "packets": p.numInputRows, "pps": p.processedRowsPerSecond, "batch_ms": p.batchDuration, **counts})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def replay(read: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], rounds: int, delay: float = 0.0) -> None:
    """Gives sink the same capture again and again, with its round."""
    for k in range(rounds):
        if k and delay:
            time.sleep(delay)
        sink(read(), k)
