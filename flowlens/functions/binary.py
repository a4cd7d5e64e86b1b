"""Integers and strings out of binary columns. All of it stays in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Place = int | Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once and stands once in the plan, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _col(x: Place) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def part(data: Column, offset: Place, size: Place) -> Column:
    """size bytes from offset (0 is the first); fewer at the end."""
    return F.substring(data, _col(offset) + 1, _col(size))


def uint(data: Column, offset: Place, size: int) -> Column:
    """A big-endian unsigned number of 1 to 4 bytes as BIGINT, null where bytes lack."""
    raw = F.hex(part(data, offset, size))
    return F.when(F.length(raw) == 2 * size, F.conv(raw, 16, 10).cast("bigint"))


def u8(data: Column, offset: Place) -> Column:
    return uint(data, offset, 1)


def u16(data: Column, offset: Place) -> Column:
    return uint(data, offset, 2)


def u32(data: Column, offset: Place) -> Column:
    return uint(data, offset, 4)


def be(value: Column, size: int) -> Column:
    """A number as size (1 to 7) big-endian bytes, the lowest that it has."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint").bitwiseAND((1 << 8 * size) - 1)), 2 * size, "0"))


def swap32(value: Column) -> Column:
    """The bytes of an unsigned 32-bit number, reversed."""
    return ((value.bitwiseAND(255)) * 16777216) + (F.shiftright(value, 8).bitwiseAND(255) * 65536) + (F.shiftright(value, 16).bitwiseAND(255) * 256) + F.shiftright(value, 24).bitwiseAND(255)


def latin(data: Column) -> Column:
    """Bytes as text, a character each: for searches by byte."""
    return F.decode(data, "ISO-8859-1")


def entropy(data: Column) -> Column:
    """Shannon bits per byte; 0 for no bytes. Counts by value, so work is bytes times different values."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        counts = F.transform(F.array_sort(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))), lambda k: k / n)
        return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return F.when(F.octet_length(data) > 0, let(F.split(F.regexp_replace(F.hex(data), "(..)(?!$)", "$1 "), " "), bits)).otherwise(F.lit(0.0))
