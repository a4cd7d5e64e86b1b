"""Rates over time and latency histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS, BUCKETS = 10, 1000


def per_slot(packets: DataFrame, slot_us: int = 1_000_000) -> DataFrame:
    """slot, packets, bytes of slots that have any: small beside the packets, as they are counted before any window."""
    return packets.groupBy(F.floor(F.col("ts_us") / slot_us).alias("slot")).agg(F.count("*").alias("packets"), F.sum("incl_len").alias("bytes"))


def sliding(slots: DataFrame, n: int = SLOTS) -> DataFrame:
    """slots with pps: packets of the last n slots, through this one, divided by n. Slots without packets count as 0.

    Each slot adds to the n slots that see it; that needs no ordered window over all time.
    """
    seen = slots.select(F.explode(F.sequence("slot", F.col("slot") + n - 1)).alias("slot"), "packets").groupBy("slot").agg((F.sum("packets") / n).alias("pps"))
    return slots.join(seen, "slot")


def histogram(latencies: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: of latency_us, the last bucket holds all beyond."""
    return latencies.groupBy(F.least("latency_us", F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(hist: DataFrame) -> DataFrame:
    """p50_us, p99_us: the first bucket by which floor(total / 2), floor(total * 99 / 100) are reached; 0 of nothing. A histogram has few rows."""
    order = Window.orderBy("bucket")
    upto = hist.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    first = lambda q: F.coalesce(F.min(F.when(F.col("upto") >= F.floor(F.col("total") * q / 100), F.col("bucket"))), F.lit(0))
    return upto.agg(first(50).alias("p50_us"), first(99).alias("p99_us"))
