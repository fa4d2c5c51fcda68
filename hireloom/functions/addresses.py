"""Network addresses as numbers, and which of them are public, as Column expressions.

An IPv4 address is one number, an IPv6 address eight; what is not public is a list of
intervals that a number is looked up in. IPv4 addresses mapped into IPv6, in either
spelling, are judged as IPv4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .urls import host_of

#: First and last IPv4 addresses of what is not public.
PRIVATE_V4 = [("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"), ("224.0.0.0", "255.255.255.255")]
#: The same for the first of an IPv6 address's eight numbers. Short spellings
#: (fc::, not fc00::) count as what they begin like.
PRIVATE_V6 = [(0x00FC, 0x00FD), (0x00FF, 0x00FF), (0x0FC0, 0x0FDF), (0x0FE8, 0x0FEB), (0x0FF0, 0x0FFF), (0xFC00, 0xFDFF), (0xFE80, 0xFEBF), (0xFF00, 0xFFFF)]

_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}"


def v4_value(text: str) -> int:
    return sum(int(b) << (24 - 8 * k) for k, b in enumerate(text.split(".")))


def v4_number(address: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.transform(F.split(address, r"\."), lambda b: b.try_cast("bigint"))
    return F.when(address.rlike(rf"^{_V4}$"), F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, b: s * 256 + b))


def v6_numbers(address: Column) -> Column:
    """An IPv6 address as eight numbers; null if it is none."""

    def groups(text: Column) -> Column:
        hexed = F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.when(g.rlike("^[0-9a-f]{1,4}$"), F.conv(g, 16, 10).cast("int")))
        return hexed

    def expanded(text: Column) -> Column:
        left, right = groups(F.substring_index(text, "::", 1)), groups(F.when(text.contains("::"), F.substring_index(text, "::", -1)).otherwise(""))
        gap = F.lit(8) - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit(0), F.greatest(gap, F.lit(0))), right)
        whole = F.when(text.contains("::"), gap >= 1).otherwise(gap == 0)
        # one :: at most, and no single colon at an end
        shape = ~text.rlike(r"::.*::|:::|^:(?!:)|(?<!:):$") & text.contains(":")
        return F.when(shape & whole & (F.size(filled) == 8) & ~F.exists(filled, lambda g: g.isNull()), filled)

    tail = F.regexp_extract(address, rf":({_V4})$", 1)
    value = v4_number(tail)
    dotted = F.concat(F.substring(address, F.lit(1), F.length(address) - F.length(tail)), F.lower(F.hex(F.shiftright(value, 16))), F.lit(":"), F.lower(F.hex(value.bitwiseAND(F.lit(65535)))))
    return let(F.lower(F.when(tail != "", dotted).otherwise(address)), expanded)


def _within(number: Column, intervals: list[tuple[int, int]]) -> Column:
    table = F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in intervals))
    return F.exists(table, lambda i: (number >= i["a"]) & (number <= i["b"]))


def is_public(address: Column) -> Column:
    """Whether an address is one and public; brackets around it don't matter."""
    v4_ranges = [(v4_value(a), v4_value(b)) for a, b in PRIVATE_V4]
    public_v4 = lambda n: ~_within(n, v4_ranges)

    def of_v6(g: Column) -> Column:
        zeros = lambda k: F.forall(F.slice(g, F.lit(1), F.lit(k)), lambda x: x == 0)
        mapped = zeros(5) & (F.get(g, F.lit(5)) == 0xFFFF)
        last = F.get(g, F.lit(6)).cast("bigint") * 65536 + F.get(g, F.lit(7))
        own = zeros(7) & (F.get(g, F.lit(7)) <= 1)  # :: and ::1
        return F.when(mapped, public_v4(last)).otherwise(~own & ~_within(F.get(g, F.lit(0)), PRIVATE_V6))

    def judged(text: Column) -> Column:
        return F.coalesce(let(v4_number(text), lambda n: F.when(n.isNotNull(), public_v4(n))), let(v6_numbers(text), lambda g: F.when(g.isNotNull(), of_v6(g))), F.lit(False))

    return let(F.regexp_replace(F.lower(address), r"^\[(.*)\]$", "$1"), judged)


def unsafe_url(url: Column, addresses: Column, allow_loopback: bool = False) -> Column:
    """Why a URL must not be fetched, null if it may; addresses are those its host resolves to,
    which are not looked at where the host is an address itself."""

    def judged(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"^\[(.*)\]$", "$1")
        loopback = (host == "localhost") | (host == "::1") | host.startswith("127.")
        literal = v4_number(host).isNotNull() | v6_numbers(host).isNotNull()
        known = F.when(literal, F.array(host)).otherwise(F.coalesce(addresses, F.array().cast("array<string>")))
        public = (F.size(known) > 0) & F.forall(known, is_public)
        secure = (p["scheme"] == "https") | (F.lit(allow_loopback) & (p["scheme"] == "http") & loopback)
        return (
            F.when(p["host"].isNull() | (p["host"] == ""), "URL is malformed.").when(F.regexp_replace(p["user"], ":", "") != "", "URL must not contain credentials.").when(~secure, "URL must use public HTTPS.")
            .when(loopback, F.lit(None if allow_loopback else "Loopback URLs are not allowed.").cast("string")).when(~public, "URL resolved to a non-public network address.")
        )

    return let(host_of(url), judged)
