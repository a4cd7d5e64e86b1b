"""The whole plan: frames, packets, flow keys, findings, state as of each packet, verdicts, reports.

Findings and verdicts look at packets several times: to find, by partial
aggregates, where in each flow something begins, and to tell each packet. So
that frames are read and decoded once, ``stored`` keeps the decoded columns as a table in
the shared folder, of which each look reads what it needs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows as fl
from ..operators import rules as ru
from ..operators.decode import decode


#: What flows, rules and reports read of a packet.
FIELDS = (
    "ip_proto", "ip_total_len", "src_ip", "dst_ip", "src_ip4", "dst_ip4", "src_ip_str", "dst_ip_str", "has_tcp", "has_udp", "has_icmp", "src_port", "dst_port", "tcp_seq", "payload", "payload_len", "pkt_app", "parse_status",
)


def packets(raw: DataFrame, fields: tuple[str, ...] | None = FIELDS, **options) -> DataFrame:
    """Decoded packets with ts_us and the key of their flow; malformed ones too."""
    out = decode(raw, fields=fields, **options)
    if "ts_us" not in out.columns:
        out = out.withColumn("ts_us", F.col("ts_sec") * 1000000 + F.col("ts_usec"))
    return fl.canonical(out)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder of this machine where it is unset (local mode only)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'flowlens-checkpoints')}"


def stored(decoded: DataFrame, folder: str | None = None) -> DataFrame:
    """decoded as a table that is written now, to a new folder below shared_dir() unless one is named. It is the caller's to remove."""
    folder = folder or f"{shared_dir(decoded.sparkSession)}/packets-{uuid.uuid4().hex}"
    decoded.write.option("compression", "zstd").parquet(folder)
    return decoded.sparkSession.read.schema(decoded.schema).parquet(folder)


def known(decoded: DataFrame) -> DataFrame:
    """The well-formed packets, with what is known of their flow as of each."""
    ok = decoded.where("parse_status = 'ok'")
    return fl.as_of(ok, fl.inspect(ok))


def judged(decoded: DataFrame, rules: ru.RuleSet) -> DataFrame:
    """All packets, with verdicts; malformed ones are neither blocked nor forwarded."""
    return ru.verdicts(decoded, rules)


def flows(asof: DataFrame) -> DataFrame:
    """A row for each flow: counters, its name and application once all is seen."""
    last = [F.max_by("sni_asof", "seq_num").alias("sni"), F.max_by("app_asof", "seq_num").alias("app")]
    return fl.aggregate(asof.where("ip_a IS NOT NULL AND parse_status = 'ok'"), extra=last)
