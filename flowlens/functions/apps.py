"""Applications: numbers, names, and the ladder from host names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of applications in order of their numbers.
NAMES = ("Unknown", "HTTP", "HTTPS", "DNS", "FTP", "SSH", "SMTP", "NTP", "TLS", "Google", "YouTube", "Facebook", "Twitter", "Instagram", "Netflix", "Amazon", "Microsoft", "Cloudflare", "GitHub", "BitTorrent", "QUIC", "ICMP", "ARP")

#: What a host name contains, and the application; the first that fits counts.
LADDER = (
    ("YouTube", ("youtube", "googlevideo", "ytimg")),
    ("Google", ("google", "gstatic")),
    ("Instagram", ("instagram",)),
    ("Facebook", ("facebook", "fbcdn", "whatsapp")),
    ("Netflix", ("netflix", "nflxvideo")),
    ("Amazon", ("amazon", "cloudfront", "twitch")),
    ("Microsoft", ("microsoft", "windows", "azure", "office365", "outlook")),
    ("Twitter", ("twitter", "twimg", "t.co")),
    ("Cloudflare", ("cloudflare", "1.1.1.1")),
    ("GitHub", ("github",)),
)

#: An application that a later finding may replace.
GENERIC = ("Unknown", "HTTPS", "TLS")


def app_name(number: Column) -> Column:
    """Unknown for numbers that are none."""
    table = F.create_map(*(F.lit(x) for pair in enumerate(NAMES) for x in pair))
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit("Unknown"))


def app_of_host(host: Column) -> Column:
    """Of a server name: Unknown if empty or null, TLS if nothing fits."""
    name = F.lower(host)
    out = F.when(host.isNull() | (host == ""), F.lit("Unknown"))
    for app, keys in LADDER:
        hit = F.lit(False)
        for k in keys:
            hit = hit | name.contains(k)
        out = out.when(hit, app)
    return out.otherwise(F.lit("TLS"))


def app_of_host_sql(host: str) -> str:
    """The same in SQL."""
    steps = " ".join(f"WHEN {' OR '.join(f"contains(lower({host}), '{k}')" for k in keys)} THEN '{app}'" for app, keys in LADDER)
    return f"CASE WHEN coalesce({host}, '') = '' THEN 'Unknown' {steps} ELSE 'TLS' END"
