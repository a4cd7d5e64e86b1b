"""Block rules: addresses, ports, applications, domains; verdicts that stick to a flow.

Rules are configuration and are held on the driver. Up to FOLDED networks are one
predicate; more are tables by prefix length, broadcast and looked up where the
packets are. Names are tested once for each flow in which one was found.
"""

from __future__ import annotations

import ipaddress
import json
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import part
from ..functions.net import cidr
from .flows import KEY, inspect, join_flows, own_app, state

MAX_VALUE = 256
#: Up to so many networks, a predicate tests them all; beyond, they are looked up by prefix.
FOLDED = 64
KINDS = ("ip", "port", "app", "domain")
#: Names that rule files use for applications.
APPS = {"youtube": "YouTube", "facebook": "Facebook", "netflix": "Netflix", "bittorrent": "BitTorrent"}


@dataclass
class RuleSet:
    """Rules by type. add() takes a type and a value as text and says whether it is one; loaded and refused count what it was given."""

    networks4: list[ipaddress.IPv4Network] = field(default_factory=list)
    networks6: list[ipaddress.IPv6Network] = field(default_factory=list)
    ports: list[int] = field(default_factory=list)
    apps: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    loaded: int = field(default=0, compare=False)
    refused: int = field(default=0, compare=False)

    def add(self, kind: str, value: str) -> bool:
        done = self._add(kind, str(value))
        self.loaded, self.refused = self.loaded + done, self.refused + (not done)
        return done

    def _add(self, kind: str, value: str) -> bool:
        if not value or len(value) > MAX_VALUE:
            return False
        if kind == "ip":
            try:
                net = cidr(value)
            except ValueError:
                return False
            (self.networks4 if net.version == 4 else self.networks6).append(net)
        elif kind == "port":
            if not value.isdigit() or int(value) > 65535:
                return False
            self.ports.append(int(value))
        elif kind == "app":
            if value.lower() not in APPS:
                return False
            self.apps.append(APPS[value.lower()])
        elif kind == "domain":
            self.domains.append(value.lower())
        else:
            return False
        return True

    def add_ip(self, value: str) -> bool:
        return self.add("ip", value)

    def add_port(self, value: int | str) -> bool:
        return self.add("port", str(value))

    def add_app(self, value: str) -> bool:
        return self.add("app", value)

    def add_domain(self, value: str) -> bool:
        return self.add("domain", value)

    def __len__(self) -> int:
        return len(self.networks4) + len(self.networks6) + len(self.ports) + len(self.apps) + len(self.domains)

    def rows(self) -> list[tuple[str, str]]:
        """(type, value) of each rule, in the order in which they are tried; a rule's number is its place."""
        return [("ip", str(n)) for n in (*self.networks4, *self.networks6)] + [("port", str(p)) for p in self.ports] + [("app", a) for a in self.apps] + [("domain", d) for d in self.domains]

    def first(self, kind: str) -> int:
        """The number of the first rule of a kind."""
        return next((k for k, (t, _) in enumerate(self.rows()) if t == kind), len(self))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "type string, value string")


def from_rows(rows: DataFrame) -> RuleSet:
    """Of a table (type, value). Rows that lack either are refused."""
    out = RuleSet()
    for r in rows.select("type", "value").collect():  # rules are configuration: small by nature
        if r["type"] and r["value"]:
            out.add(r["type"], r["value"])
        else:
            out.refused += 1
    return out


def read(spark: SparkSession, path: str) -> RuleSet:
    """Of a JSON file {"rules": [{"type", "value"}]}; a number as value is its text. ValueError if it is no such file."""
    entry = "array<struct<type:string,value:string>>"
    rows = spark.read.schema(f"rules {entry}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True).collect()  # a file is a row
    if not rows or any(r["_corrupt"] is not None or r["rules"] is None for r in rows):
        raise ValueError(f"{path}: no rules file")
    out = RuleSet()
    for r in rows:
        for x in r["rules"]:
            if x is not None and x["type"] and x["value"]:
                out.add(x["type"], x["value"])
            else:
                out.refused += 1
    return out


def load(spark: SparkSession, path: str, into: RuleSet) -> int:
    """Adds the rules of a file and returns how many were loaded, -1 if it can't be read or is none; into is unchanged then."""
    try:
        got = read(spark, path)
    except (ValueError, PySparkException):
        return -1
    for kind, value in got.rows():
        into._add(kind, value if kind != "app" else next(k for k, v in APPS.items() if v == value))
    into.loaded, into.refused = into.loaded + got.loaded, into.refused + got.refused
    return got.loaded


def parse(text: str) -> RuleSet:
    out = RuleSet()
    for r in json.loads(text).get("rules", []):
        if isinstance(r, dict) and r.get("type") and r.get("value") is not None:
            out.add(r["type"], str(r["value"]))
        else:
            out.refused += 1
    return out


# --- predicates ---------------------------------------------------------------------


def in_networks4(ip: Column, networks: list[ipaddress.IPv4Network]) -> Column:
    """Of a number, for few networks. Those that touch or overlap are tested as one range."""
    out = F.lit(False)
    for net in ipaddress.collapse_addresses(networks):
        out = out | ip.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(out, F.lit(False))


def in_networks6(ip: Column, networks: list[ipaddress.IPv6Network]) -> Column:
    """Of 16 bytes."""
    out = F.lit(False)
    for net in ipaddress.collapse_addresses(networks):
        out = out | ((F.octet_length(ip) == 16) & (ip >= F.lit(net.network_address.packed)) & (ip <= F.lit(net.broadcast_address.packed)))
    return F.coalesce(out, F.lit(False))


def join_networks(packets: DataFrame, networks: DataFrame, ip: str) -> DataFrame:
    """packets whose ip (a number) is in any of networks (address, bits): an equi-join on the prefix, for each length that occurs."""
    lengths = [r["bits"] for r in networks.select("bits").distinct().orderBy("bits").collect()]  # 33 at most
    if not lengths:
        return packets.where("false")
    nets = networks.select(F.col("bits").alias("_bits"), F.expr("shiftright(address, 32 - bits)").alias("_prefix")).distinct()
    keys = F.explode(F.array(*(F.struct(F.lit(b).alias("_bits"), F.shiftright(F.col(ip), 32 - b).alias("_prefix")) for b in lengths)))
    hits = packets.select("seq_num", keys.alias("k")).select("seq_num", "k.*").join(nets, ["_bits", "_prefix"], "left_semi").select("seq_num").distinct()
    return packets.join(hits, "seq_num", "left_semi")


def domain_hit(host: Column, domains: list[str], normalise_case: bool = True) -> Column:
    """A rule's domain stands anywhere in the name."""
    name = F.lower(host) if normalise_case else host
    out = F.lit(False)
    for d in sorted(set(domains)):
        out = out | name.contains(d)
    return F.coalesce(out, F.lit(False))


def _prefixes(networks: list, wide: int, first: int) -> dict[int, dict[int, int]]:
    """Prefix length -> prefix -> the least number of a rule, for networks numbered from first."""
    out: dict[int, dict[int, int]] = {}
    for k, net in enumerate(networks, first):
        out.setdefault(net.prefixlen, {}).setdefault(int(net.network_address) >> (wide - net.prefixlen), k)
    return out


def network_rule(packets: DataFrame, rules: RuleSet, name: str = "net_rule") -> DataFrame:
    """packets with the least number of a network rule that holds their source or target, null if none does.

    Up to FOLDED networks of a version are a chain of tests; more are looked up by prefix, length by length, in broadcast
    tables, which are as large as the rules on the driver.
    """
    found = []
    for networks, wide, ends, first in ((rules.networks4, 32, ("src_ip4", "dst_ip4"), 0), (rules.networks6, 128, ("src_ip", "dst_ip"), len(rules.networks4))):
        if not networks:
            continue
        if len(networks) <= FOLDED:
            test = in_networks4 if wide == 32 else in_networks6
            hits = [F.when(test(F.col(ends[0]), [net]) | test(F.col(ends[1]), [net]), k) for k, net in enumerate(networks, first)]
            found.append(F.coalesce(*hits, F.lit(None).cast("int")))
            continue
        spark = packets.sparkSession
        for bits, table in sorted(_prefixes(networks, wide, first).items()):
            for end in ends:
                column = f"_n{wide}_{bits}_{end}"
                if wide == 32:
                    rows = spark.createDataFrame(list(table.items()), f"_p bigint, {column} int")
                    prefix = F.shiftright(F.col(end), 32 - bits)
                else:
                    whole = -(-bits // 8)
                    packed_ = [(bytearray((p << (8 * whole - bits)).to_bytes(whole, "big")), k) for p, k in table.items()]
                    rows = spark.createDataFrame(packed_, f"_p binary, {column} int")
                    prefix = F.when(F.octet_length(end) == 16, _cut_bits(F.col(end), bits))
                packets = packets.join(F.broadcast(rows), prefix == F.col("_p"), "left").drop("_p")
                found.append(F.col(column))
    if not found:
        return packets.withColumn(name, F.lit(None).cast("int"))
    made = [c for c in packets.columns if c.startswith("_n32_") or c.startswith("_n128_")]
    return packets.withColumn(name, F.least(*found, F.lit(None).cast("int"))).drop(*made)


def _cut_bits(ip: Column, bits: int) -> Column:
    """The first bits of an address as bytes, what is left of the last byte zero."""
    whole, rest = divmod(bits, 8)
    if not rest:
        return part(ip, 0, whole)
    last = F.conv(F.hex(part(ip, whole, 1)), 16, 10).cast("int").bitwiseAND(256 - (1 << 8 - rest))
    return F.concat(part(ip, 0, whole), F.unhex(F.lpad(F.hex(last.cast("bigint")), 2, "0")))


def _numbered(column: Column, values: list, first: int) -> Column:
    """The number of the rule that a value equals, null if none. Numbers are looked up as BIGINT."""
    if not values:
        return F.lit(None).cast("int")
    table: dict = {}
    for k, v in enumerate(values, first):
        table.setdefault(v, k)
    key = lambda v: F.lit(v).cast("long") if isinstance(v, int) else F.lit(v)
    return F.create_map(*(x for v, k in table.items() for x in (key(v), F.lit(k))))[column]


def domain_rule(host: Column, rules: RuleSet, normalise_case: bool = True) -> Column:
    """The number of the first domain rule that a name contains."""
    name, first = F.lower(host) if normalise_case else host, rules.first("domain")
    return F.coalesce(*(F.when(name.contains(d), k) for k, d in enumerate(rules.domains, first)), F.lit(None).cast("int"))


def verdicts(packets: DataFrame, rules: RuleSet, key: tuple[str, ...] = KEY, normalise_case: bool = True, found: DataFrame | None = None) -> DataFrame:
    """packets with sni_asof, app_asof, reason (of this packet as things stand), blocked (this or an earlier packet of the flow), first_reason and first_rule (its number).

    Packets that aren't ok pass without a verdict. A flow's facts are partial aggregates: where its first packet of a blocked
    address or port is, and of an application of its own. With what was found in it they tell from which packet on it is blocked.
    """
    ok = F.col("parse_status") == "ok" if "parse_status" in packets.columns else F.lit(True)
    port = _numbered(F.col("dst_port").cast("long"), rules.ports, rules.first("port"))
    held = network_rule(packets, rules).withColumn("static", F.when(ok, F.coalesce("net_rule", port))).drop("net_rule")
    good = held.where(ok)
    at = F.when(F.col("static").isNotNull(), F.col("seq_num"))
    facts = good.groupBy(*key).agg(F.min(at).alias("static_at"), F.min_by("static", at).alias("static_rule"), *own_app(key)).where("static_at IS NOT NULL OR own_at IS NOT NULL")
    facts = facts.join(inspect(good, key) if found is None else found, list(key), "full")
    app = lambda c: _numbered(F.col(c), rules.apps, rules.first("app"))
    facts = facts.withColumns({"own_hit": app("own_app"), "app_hit": app("dpi_app"), "name_hit": domain_rule(F.col("sni"), rules, normalise_case)})
    found_hit = F.coalesce("app_hit", "name_hit")
    own_hit = F.when(F.coalesce(F.col("own_at") < F.col("found_at"), F.lit(True)), F.col("own_hit"))
    steps = [(F.col("static_at"), F.col("static_rule")), (F.col("found_at"), found_hit), (F.col("own_at"), own_hit)]
    least = F.array_min(F.filter(F.array(*(F.struct(a.alias("at"), n.alias("rule")) for a, n in steps)), lambda s: s["at"].isNotNull() & s["rule"].isNotNull()))
    facts = facts.withColumn("block", least)
    out = state(join_flows(held, facts, key))
    seen, own = F.col("seq_num") >= F.col("found_at"), F.col("seq_num") >= F.col("own_at")
    now = F.coalesce("static", F.when(seen, found_hit).otherwise(F.when(own, F.col("own_hit"))))
    kind = lambda n: F.when(n < rules.first("port"), "ip").when(n < rules.first("app"), "port").when(n < rules.first("domain"), "app").when(n.isNotNull(), "domain")
    blocked = F.coalesce(ok & (F.col("seq_num") >= F.col("block.at")), F.lit(False))
    out = out.withColumns({"reason": kind(now), "blocked": blocked}).withColumn("first_rule", F.when(F.col("blocked"), F.col("block.rule")))
    return out.withColumn("first_reason", kind(F.col("first_rule"))).drop("static", "static_at", "static_rule", "own_at", "own_app", "own_hit", "found_at", "sni", "dpi_app", "app_hit", "name_hit", "block")


def forwarded(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("blocked"))


def wildcard(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """packets with blocked: any rule (ipv4_src, ipv4_dst, port, protocol, block) that fits and blocks; 0 fits all, a port either end.

    Rules are configuration, read to the driver and folded into one predicate.
    """
    out = F.lit(False)
    for r in rules.where("block").collect():
        hit = F.lit(True)
        if r["ipv4_src"]:
            hit = hit & (F.col("src_ip4") == r["ipv4_src"])
        if r["ipv4_dst"]:
            hit = hit & (F.col("dst_ip4") == r["ipv4_dst"])
        if r["port"]:
            hit = hit & ((F.col("src_port") == r["port"]) | (F.col("dst_port") == r["port"]))
        if r["protocol"]:
            hit = hit & (F.col("ip_proto") == r["protocol"])
        out = out | F.coalesce(hit, F.lit(False))
    return packets.withColumn("blocked", out)
