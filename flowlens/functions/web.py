"""Requests, hosts and urls as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import latin, part

#: Methods that open a request.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")


def http_host(payload: Column) -> Column:
    """Host header of a request's first 4096 bytes, without a port; null if there is none."""
    text = latin(part(payload, 0, 4096))
    found = F.regexp_extract(text, r"(?s)\r\n(?:Host|host|HOST): ([^\r\n]*)", 1)
    host = F.regexp_replace(F.trim(found), r":\d*$", "")
    fits = (F.octet_length(payload) >= 16) & text.rlike(f"^(?:{'|'.join(METHODS)}) ")
    return F.when(fits & (host != ""), host)


def parse_request(request: Column) -> Column:
    """A struct (method, path, host, port, headers) of a request's text; null without a method or host."""
    line = F.split(F.regexp_extract(request, r"(?s)^([^\r\n]*)", 1), r"\s+")
    headers = F.regexp_replace(F.regexp_replace(F.regexp_extract(request, r"(?s)^[^\n]*\n(.*?)(?:\r?\n\r?\n.*)?$", 1), "\r", ""), r"\n+$", "")
    host = F.trim(F.regexp_extract(request, r"(?m)^Host:([^\r\n]*)", 1))
    ok = (F.get(line, F.lit(0)) != "") & (host != "")
    name, port = split_host_port(host)
    return F.when(ok, F.struct(F.get(line, F.lit(0)).alias("method"), F.get(line, F.lit(1)).alias("path"), name.alias("host"), port.alias("port"), headers.alias("headers")))


def split_host_port(host: Column) -> tuple[Column, Column]:
    """Name and port, cut at the first colon; 80 where there is none."""
    return F.substring_index(host, ":", 1), F.coalesce(F.when(F.instr(host, ":") > 0, F.regexp_extract(host, r"^[^:]*:(\d{1,5})", 1).try_cast("int")), F.lit(80))


def url_domain(url: Column) -> Column:
    """What stands between a url's scheme and the next slash; the port stays."""
    return F.substring_index(F.regexp_replace(url, r"^https?://", ""), "/", 1)


def sanitise_url(url: Column) -> Column:
    """A url that may be analysed, https:// before it if no scheme is there; null if too long or with other characters."""
    ok = (F.length(url) <= 255) & url.rlike(r"^[a-zA-Z0-9\-\.\:\/]+$")
    return F.when(ok, F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url)))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text
