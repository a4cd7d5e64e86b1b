"""Findings about packets: entropy, bursts, ports, sizes, frequency. Each is (type, subject, confidence, reason)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import entropy

#: Ports that are nothing unusual, and thresholds. Names of findings are fixed, too.
COMMON_PORTS = (80, 443, 22, 25, 53, 110, 143, 3306, 5432, 27017, 6379, 8080, 8443)
ENTROPY, LARGE, BURST_PPS, BURST_SECONDS, RECENT = 7.0, 100000, 10000, 5, 100


def _finding(kind: str, subject: Column, confidence: Column, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), subject.alias("subject"), confidence.cast("double").alias("confidence"), reason.alias("reason"))


def entropy_score(bits: Column) -> Column:
    """Of bits per byte, 0 to 1."""
    return F.least(F.lit(1.0), bits / 8)


def burst_score(pps: Column, threshold: int = BURST_PPS) -> Column:
    """0 up to the threshold, then half of what is beyond it, 1 at most."""
    return F.when(pps <= threshold, 0.0).otherwise(F.least(F.lit(1.0), 0.5 * (pps / threshold - 1)))


def with_entropy(rows: DataFrame, payload: str = "payload") -> DataFrame:
    return rows.withColumn("entropy", entropy(F.col(payload)))


def high_entropy(rows: DataFrame, threshold: float = ENTROPY) -> DataFrame:
    """rows (domain, entropy) beyond the threshold."""
    e = F.col("entropy")
    hit = rows.where(e > threshold)
    return hit.withColumn("finding", _finding("HIGH_ENTROPY", F.col("domain"), F.least(F.lit(1.0), e / 8), F.concat(F.format_number(e, 3), F.lit(" bits a byte: encrypted or packed"))))


def bursts(rows: DataFrame, threshold: int = BURST_PPS, literal: bool = True, by: tuple[str, ...] = ("domain",), slot_seconds: int = 60) -> DataFrame:
    """rows (ts_us, seq_num) with pps over the threshold, packets of the last seconds by whole division.

    literal: only the last RECENT packets are looked at, and from the tenth on; else all of the time window.
    Windows are kept by ``by`` and slot of time; a slot sees the one before as well, so a hot subject is spread over its slots.
    """
    span, slot_us = BURST_SECONDS * 1_000_000, max(slot_seconds, BURST_SECONDS) * 1_000_000
    slot = F.floor(F.col("ts_us") / slot_us)
    each = rows.withColumn("_own", slot).withColumn("_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    order = Window.partitionBy(*by, "_slot").orderBy("ts_us", "seq_num")
    if literal:
        last = F.collect_list("ts_us").over(order.rowsBetween(-(RECENT - 1), Window.currentRow))
        n = F.size(F.filter(last, lambda t: t > F.col("ts_us") - span))
        here = F.sum(F.when(F.col("_own") == F.col("_slot"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = rows.groupBy(*by, slot.alias("_slot")).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_slot").alias("_at"), before.alias("_before"))  # a row for each slot
        out = each.withColumn("pps", F.floor(n / BURST_SECONDS)).withColumn("_here", here).where("_own = _slot")
        on = F.col("_slot") == F.col("_at")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        out = out.join(counts, on).where("_before + _here >= 10").drop("_here", "_at", "_before", *(f"_by_{c}" for c in by))
    else:
        ahead = Window.partitionBy(*by, "_slot").orderBy("ts_us").rangeBetween(-span + 1, Window.currentRow)
        out = each.withColumn("pps", F.floor(F.count("*").over(ahead) / BURST_SECONDS)).where("_own = _slot")
    hit = out.drop("_own", "_slot").where(F.col("pps") > threshold)
    return hit.withColumn("finding", _finding("TRAFFIC_BURST", F.col("domain"), F.least(F.lit(1.0), F.col("pps") / (2.0 * threshold)) if threshold else F.lit(1.0), F.concat(F.col("pps").cast("string"), F.lit(" packets a second"))))


def unusual_ports(rows: DataFrame) -> DataFrame:
    """The first packet of each domain and uncommon port, after the domain's first packet. Firsts are partial aggregates."""
    first = rows.groupBy("domain", "port").agg(F.min("seq_num").alias("_first"))
    known = rows.groupBy("domain").agg(F.min("seq_num").alias("_known"))
    late = first.join(known, "domain").where((F.col("_first") > F.col("_known")) & ~F.col("port").isin(*COMMON_PORTS))
    hit = rows.join(late.select("domain", "port", F.col("_first").alias("seq_num")), ["domain", "port", "seq_num"], "left_semi")
    return hit.withColumn("finding", _finding("UNUSUAL_PORTS", F.concat_ws(":", "domain", F.col("port").cast("string")), F.lit(0.6), F.lit("a port that the domain has not used before")))


def exfiltration(rows: DataFrame, large: int = LARGE) -> DataFrame:
    hit = rows.where(F.col("size") > large)
    return hit.withColumn("finding", _finding("DATA_EXFILTRATION", F.col("domain"), F.lit(0.75), F.concat(F.lit("a packet of "), F.col("size").cast("string"), F.lit(" bytes"))))


def frequency(rows: DataFrame, slot_us: int = 5_000_000, least: float = 0.8) -> DataFrame:
    """Slots of a domain with a count so far above its mean that z / 5 passes least: domain, slot, n, z."""
    per = rows.groupBy("domain", F.floor(F.col("ts_us") / slot_us).alias("slot")).agg(F.count("*").alias("n"))
    all_ = per.groupBy("domain").agg(F.avg("n").alias("_mean"), F.stddev_pop("n").alias("_sd"))
    per = per.join(all_, "domain")
    z = (F.col("n") - F.col("_mean")) / F.greatest(F.col("_sd"), F.lit(0.1))
    hit = per.withColumn("z", z).drop("_mean", "_sd").where((F.col("z") >= 2) & (F.least(F.lit(1.0), F.col("z") / 5) > least))
    return hit.withColumn("finding", _finding("FREQUENCY_ANOMALY", F.col("domain"), F.least(F.lit(1.0), F.col("z") / 5), F.lit("far more packets than in other slots")))


def union(*parts: DataFrame) -> DataFrame:
    """All findings."""
    out = None
    for p in parts:
        rows = p.select("finding.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def entropy_ewma(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """domain, ewma: of entropy in order of seq_num, from 0. A sum of discounted terms, of the last ones whose weight a double can tell.

    The limit on a rank lets each task keep no more of a domain than that before the shuffle.
    """
    ages = math.ceil(math.log(1e-20) / math.log(1 - alpha)) if 0 < alpha < 1 else 1
    order = Window.partitionBy("domain").orderBy(F.desc("seq_num"))
    last = rows.select("domain", "seq_num", "entropy").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= ages)
    return last.groupBy("domain").agg(F.sum(alpha * F.col("entropy") * F.pow(F.lit(1 - alpha), F.col("_rank") - 1)).alias("ewma"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
