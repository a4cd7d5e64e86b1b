"""Addresses: text forms and back."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4_text(ip: Column) -> Column:
    """Dotted form of an unsigned 32-bit number."""
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def ipv6_text(ip: Column) -> Column:
    """Eight groups of four lower-case digits, nothing left out."""
    return F.lower(F.regexp_replace(F.hex(ip), "(.{4})(?!$)", "$1:"))


def mac_text(mac: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(mac), "(..)(?!$)", "$1:"))


def ipv4_number(text: Column) -> Column:
    """The number of a dotted form, null if it is none."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    parts = F.split(text, r"\.")
    number = sum((parts[k].cast("bigint") * (1 << 8 * (3 - k)) for k in range(1, 4)), parts[0].cast("bigint") * (1 << 24))
    return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def cidr(token: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    """A network of a rule: no slash means one address. ValueError if it is none or its bits are out of range."""
    return ipaddress.ip_network(token.strip(), strict=False)
