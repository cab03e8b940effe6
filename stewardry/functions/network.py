"""IPv4 and IPv6 arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one IPv4 address, octets 0-255 without leading zeros.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
STRICT_IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}\z"


def strip_prefix(address: Column) -> Column:
    """The address without its ``/length``."""
    return F.split_part(address, F.lit("/"), F.lit(1))


def prefix_length(address: Column) -> Column:
    """The length behind ``/``; 32 for a bare address."""
    tail = F.split_part(address, F.lit("/"), F.lit(2))
    return F.coalesce(tail.try_cast("int"), F.lit(32))


def ip_to_long(address: Column) -> Column:
    """The address as a number, NULL when it is not strictly four octets."""
    bare = strip_prefix(address)
    parts = F.split(bare, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(bare.rlike(STRICT_IPV4), number)


def network_of(number: Column, length: Column) -> Column:
    """The network number: the address with its host bits cleared."""
    size = F.pow(F.lit(2), F.lit(32) - length).cast("bigint")
    return number - F.pmod(number, size)


def cidr_first(prefix: Column) -> Column:
    return network_of(ip_to_long(prefix), prefix_length(prefix))


def cidr_last(prefix: Column) -> Column:
    size = F.pow(F.lit(2), F.lit(32) - prefix_length(prefix)).cast("bigint")
    return cidr_first(prefix) + size - 1


def long_to_ip(number: Column) -> Column:
    octets = [F.pmod(F.floor(number / 256**i), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]
    return F.concat_ws(".", *octets)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bits(groups: Column, first: int) -> Column:
    """Four groups of 16 bits as one 64-bit number."""
    four = F.slice(groups, first + 1, F.lit(4))
    return F.aggregate(four, F.lit(0).cast("bigint"), lambda n, g: F.shiftleft(n, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")))


def _ipv6(bare: Column) -> Column:
    """``hi, lo`` of an IPv6 address, NULL when it is none."""
    spelled = lambda dotted: once(ip_to_long(dotted), lambda n: F.format_string("%x:%x", F.shiftright(n, 16), n.bitwiseAND(F.lit(0xFFFF))))
    in_hex = lambda dotted: F.when(dotted == "", bare).otherwise(F.concat(F.left(bare, F.length(bare) - F.length(dotted)), spelled(dotted)))
    groups_of = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda x: x != "")

    def numbers(plain: Column, parts: Column) -> Column:
        left, right, n_halves = parts["left"], parts["right"], parts["n"]
        missing = 8 - F.size(left) - F.size(right)
        stray = plain.rlike(r"^:(?!:)|(?<!:):\z|:::")
        count = F.when(n_halves == 1, missing == 0).otherwise((n_halves == 2) & (missing >= 1))
        groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        valid = plain.rlike(r"^[0-9a-f:]+\z") & ~stray & count & F.forall(F.concat(left, right), lambda g: F.length(g) <= 4)
        return F.when(valid, once(groups, lambda g: F.struct(_bits(g, 0).alias("hi"), _bits(g, 4).alias("lo"))))

    def read(plain: Column) -> Column:
        halves = F.split(plain, "::", -1)
        parts = F.struct(groups_of(F.get(halves, F.lit(0))).alias("left"), groups_of(F.get(halves, F.lit(1))).alias("right"), F.size(halves).alias("n"))
        return once(parts, lambda p: numbers(plain, p))

    dotted = F.regexp_extract(bare, r":(\d+(?:\.\d+){3})\z", 1)
    return F.when(F.contains(bare, F.lit(":")), once(F.lower(once(dotted, in_hex)), read))


def ip_parts(address: Column) -> Column:
    """``family`` (4 or 6), ``hi``, ``lo`` and ``length`` of an address or prefix as 128 bits; NULL when it is neither.

    An IPv4 address is the low 32 bits, and its length counts from 96, so that both families are compared alike.
    A bare address has the whole length.
    """
    bare = strip_prefix(address)
    six = once(_ipv6(bare), lambda n: F.when(n.isNotNull(), F.struct(F.lit(6).alias("family"), n["hi"].alias("hi"), n["lo"].alias("lo"))))
    four = once(ip_to_long(bare), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"), n.alias("lo"))))
    given = F.split_part(address, F.lit("/"), F.lit(2))

    def with_length(ip: Column) -> Column:
        most = F.when(ip["family"] == 4, 32).otherwise(128)
        length = F.when(F.contains(address, F.lit("/")), given.try_cast("int")).otherwise(most)
        fits = length.between(0, most) & (F.split_part(address, F.lit("/"), F.lit(3)) == "")
        from_96 = F.when(ip["family"] == 4, length + 96).otherwise(length)
        return F.when(ip.isNotNull() & fits, F.struct(ip["family"].alias("family"), ip["hi"].alias("hi"), ip["lo"].alias("lo"), from_96.alias("length")))

    return once(F.coalesce(four, six), with_length)


def network_parts(hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """Both halves of an address with all but its first ``length`` bits cleared."""
    ones = F.lit(-1).cast("bigint")
    # a shift by 64 would be one by 0
    high = F.when(length >= 64, hi).when(length <= 0, 0).otherwise(hi.bitwiseAND(F.call_function("shiftleft", ones, 64 - length)))
    low = F.when(length >= 128, lo).when(length <= 64, 0).otherwise(lo.bitwiseAND(F.call_function("shiftleft", ones, 128 - length)))
    return high.cast("bigint"), low.cast("bigint")
