"""Summaries: counters, stages, mixes, top lists, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decode import decode, quick_tuple
from .rates import percentiles
from .rules import RuleSet

TOP_DOMAINS, TOP_FLOWS, TOP_JSON, TOP_IPS, IP_LIST, ALERTS, CHART = 8, 5, 50, 10, 8, 100, 60


def _ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b != 0, scale * a / b).otherwise(0.0)


def stats(judged: DataFrame) -> DataFrame:
    """One row of counters, of all packets with parse_status and blocked. Times are the trace's, not the clock's."""
    ok = F.col("parse_status") == "ok"
    seconds = (F.max("ts_us") - F.min("ts_us")) / 1e6
    total, size, blocked = F.count("*"), F.sum("incl_len"), F.count_if(ok & F.col("blocked"))
    return judged.agg(
        total.alias("packets_total"), size.alias("bytes_total"), F.count_if(~ok).alias("malformed"), F.count_if(ok & (F.col("ip_proto") == 6)).alias("tcp"), F.count_if(ok & (F.col("ip_proto") == 17)).alias("udp"),
        F.count_if(ok & (F.col("ip_proto") == 1)).alias("icmp"), blocked.alias("blocked"), F.count_if(ok & ~F.col("blocked")).alias("forwarded"),
        _ratio(total, seconds).alias("throughput_pps"), _ratio(size / 1048576.0, seconds).alias("throughput_mbps"), _ratio(blocked, total, 100.0).alias("block_rate"),
    )


def metrics(judged: DataFrame) -> DataFrame:
    """The row that metrics files hold."""
    s = stats(judged)
    return s.select("packets_total", F.col("blocked").alias("packets_blocked"), "bytes_total", F.round("throughput_pps", 0).alias("throughput_pps"), F.round("throughput_mbps", 1).alias("throughput_mbps"), F.round("block_rate", 2).alias("block_rate"))


def stages(judged: DataFrame) -> DataFrame:
    """stage, packets, pct, in order of the pipeline: what is read, parsed, inspected, evaluated, dropped and forwarded. pct of all read, or of all parsed."""
    s = stats(judged).withColumn("parsed", F.col("packets_total") - F.col("malformed"))
    rows = (("reader", "packets_total", "packets_total"), ("parser", "parsed", "packets_total"), ("dpi", "parsed", "parsed"), ("rules", "parsed", "parsed"), ("drop", "blocked", "parsed"), ("forward", "forwarded", "parsed"))
    each = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(n).alias("stage"), F.col(a).alias("packets"), _ratio(F.col(a), F.col(b), 100.0).alias("pct")) for k, (n, a, b) in enumerate(rows)))
    return s.select(F.inline(each))


def bottleneck(staged: DataFrame) -> DataFrame:
    """The stage that loses most of what the one before passed on; the first of equals."""
    order = Window.orderBy("pos")  # six rows
    lost = staged.where("stage <> 'drop'").withColumn("lost", F.coalesce(F.lag("packets").over(order) - F.col("packets"), F.lit(0)))
    return lost.agg(F.max_by(F.struct("stage", "lost"), F.struct("lost", -F.col("pos"))).alias("s")).select("s.*")


def backpressure(rate: Column) -> Column:
    """Of a drop rate in percent."""
    return F.when(rate > 5, "HIGH").when(rate > 1, "MILD").otherwise("HEALTHY")


def protocol_mix(packets: DataFrame) -> DataFrame:
    names = F.when(F.col("ip_proto") == 6, "TCP").when(F.col("ip_proto") == 17, "UDP").when(F.col("ip_proto") == 1, "ICMP").otherwise("OTHER")
    return packets.where("parse_status = 'ok'").groupBy(names.alias("protocol")).agg(F.count("*").alias("packets"), F.sum("incl_len").alias("bytes"))


def domains(flows: DataFrame) -> DataFrame:
    """domain, packets of all its flows, share of all domains' packets in percent."""
    per = flows.where("sni <> ''").groupBy(F.col("sni").alias("domain")).agg(F.sum("pkt_count").alias("packets"))
    total = per.agg(F.sum("packets").alias("_total"), F.lit(1).alias("_one"))  # a row
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("domain", "packets", (100.0 * F.col("packets") / F.col("_total")).alias("share"))


def top(rows: DataFrame, by: str, name: str | list[str], n: int) -> DataFrame:
    """The n greatest; ties by name."""
    return rows.orderBy(F.desc(by), *([name] if isinstance(name, str) else name)).limit(n)


def by_ip(packets: DataFrame) -> DataFrame:
    """Packets of each address, as source or target."""
    return packets.select(F.explode(F.array("src_ip_str", "dst_ip_str")).alias("ip")).where("ip IS NOT NULL").groupBy("ip").agg(F.count("*").alias("packets"))


def ip_list(packets: DataFrame, n: int = IP_LIST) -> DataFrame:
    """The first n of: sources in order of appearance, then targets."""
    seen = lambda c, k: packets.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("ip")).agg(F.min("seq_num").alias("first")).select("ip", F.lit(k).alias("kind"), "first")
    return seen("src_ip_str", "SRC").unionByName(seen("dst_ip_str", "DST")).orderBy(F.desc("kind"), "first", "ip").limit(n).select("ip", "kind")


def rule_matches(judged: DataFrame) -> DataFrame:
    """Packets that each kind of rule decided first."""
    return judged.where("first_reason IS NOT NULL").groupBy(F.col("first_reason").alias("type")).agg(F.count("*").alias("hits"))


def rule_hits(judged: DataFrame, rules: RuleSet) -> DataFrame:
    """type, rule, hits: packets that each rule decided, first in their flow."""
    per = judged.where("first_rule IS NOT NULL").groupBy("first_rule").agg(F.count("*").alias("hits"))
    names = judged.sparkSession.createDataFrame([(k, t, v) for k, (t, v) in enumerate(rules.rows())], "first_rule int, type string, rule string")
    return per.join(F.broadcast(names), "first_rule").select("type", "rule", "hits")


def rejects(raw: DataFrame) -> DataFrame:
    """rejected_by, packets: frames that the reader's pre-filter rejects, those that only the parser does, and the rest."""
    by = F.when(F.col("quick").isNull(), "reader").when(F.col("parse_status") != "ok", "parser").otherwise("none")
    return decode(quick_tuple(raw), fields=("parse_status",)).groupBy(by.alias("rejected_by")).agg(F.count("*").alias("packets"))


def snapshot(totals: DataFrame, latencies: DataFrame) -> DataFrame:
    """totals (a row: packets, dropped) with avg_latency_ms, the median of a histogram of microseconds, and drop_pct of all that came."""
    p50 = percentiles(latencies).select((F.col("p50_us") / 1000).alias("avg_latency_ms"), F.lit(1).alias("_one"))
    share = _ratio(F.col("dropped"), F.col("packets") + F.col("dropped"), 100.0).alias("drop_pct")
    return totals.select("packets", "dropped", share, F.lit(1).alias("_one")).join(F.broadcast(p50), "_one").drop("_one")  # a row each


def alerts(rows: DataFrame, n: int = ALERTS) -> DataFrame:
    """The newest."""
    return rows.orderBy(F.desc("ts_us"), F.desc("seq_num")).limit(n)


def flow_json(flows: DataFrame, n: int = TOP_JSON) -> DataFrame:
    """json of each of the n flows with most bytes, escaped as JSON asks for."""
    best = top(flows, "byte_count", ["ip_a", "port_a", "ip_b", "port_b", "ip_proto"], n)
    return best.select(F.to_json(F.struct("ip_a", "port_a", "ip_b", "port_b", "ip_proto", F.col("app"), F.coalesce("sni", F.lit("")).alias("sni"), "pkt_count", "byte_count")).alias("json"))


def summary_json(judged: DataFrame, flows: DataFrame, n: int = TOP_JSON) -> DataFrame:
    """One row of JSON: the counters, and the n flows with most bytes."""
    listed = flow_json(flows, n).agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("flows"))  # n rows at most
    counters = stats(judged).select(F.to_json(F.struct("*")).alias("stats"))
    row = counters.withColumn("k", F.lit(1)).join(F.broadcast(listed.withColumn("k", F.lit(1))), "k")  # one row each
    return row.select(F.concat(F.lit('{"stats":'), "stats", F.lit(',"flows":['), "flows", F.lit("]}")).alias("json"))


def export_metrics(judged: DataFrame, path: str) -> None:
    """Writes metrics() as a JSON file below path."""
    metrics(judged).coalesce(1).write.mode("overwrite").json(path)


def proxy(requests: DataFrame) -> DataFrame:
    """Requests of each host, of parsed requests."""
    return requests.where("r IS NOT NULL").groupBy(F.col("r.host").alias("host")).agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"))


def proxy_summary(requests: DataFrame, blocked: Column, n: int = TOP_DOMAINS) -> DataFrame:
    """A row: connections, requests, blocked, bytes and the n hosts with most requests, of parsed requests (connection, r, size)."""
    seen = requests.where("r IS NOT NULL")
    totals = seen.agg(F.countDistinct("connection").alias("connections"), F.count("*").alias("requests"), F.count_if(blocked).alias("blocked"), F.sum("size").alias("bytes"), F.lit(1).alias("_one"))
    hosts = top(proxy(requests), "requests", "host", n).agg(F.sort_array(F.collect_list(F.struct("requests", "host")), asc=False).alias("top_hosts"), F.lit(1).alias("_one"))  # n rows
    return totals.join(F.broadcast(hosts), "_one").drop("_one")


def views(judged: DataFrame, flows: DataFrame, rules: RuleSet) -> dict[str, DataFrame]:
    """What a dashboard's endpoints serve, by name."""
    return {
        "stats": stats(judged), "metrics": metrics(judged), "stages": stages(judged), "bottleneck": bottleneck(stages(judged)), "protocols": protocol_mix(judged), "flows": flow_json(flows),
        "alerts": alerts(judged.where("blocked").select("seq_num", "ts_us", "src_ip_str", "dst_ip_str", "first_reason")), "rules": rule_hits(judged, rules),
        "domains": top(domains(flows), "packets", "domain", TOP_DOMAINS), "ips": top(by_ip(judged), "packets", "ip", TOP_IPS),
    }


def summary_text(judged: DataFrame, flows: DataFrame) -> str:
    """The report that a console shows. It collects counters and top lists, a few rows each."""
    s = stats(judged).first()
    lines = [f"Packets   {s['packets_total']}", f"Bytes     {s['bytes_total']}", f"TCP/UDP/ICMP {s['tcp']}/{s['udp']}/{s['icmp']}", f"Malformed {s['malformed']}", f"Blocked   {s['blocked']} ({s['block_rate']:.2f}%)", f"Forwarded {s['forwarded']}", "Stages"]
    lines += [f"  {r['stage']:<8} {r['packets']:>10} {r['pct']:6.2f}%" for r in stages(judged).orderBy("pos").collect()]
    lines += ["Domains"] + [f"  {r['domain']:<40} {r['packets']:>8} {r['share']:6.2f}%" for r in top(domains(flows), "packets", "domain", TOP_DOMAINS).collect()]
    lines += ["Flows"] + [f"  {r['ip_a']}:{r['port_a']} - {r['ip_b']}:{r['port_b']} {r['app']} {r['byte_count'] // 1024} KB" for r in top(flows, "byte_count", ["ip_a", "port_a", "ip_b", "port_b"], TOP_FLOWS).collect()]
    return "\n".join(lines)
