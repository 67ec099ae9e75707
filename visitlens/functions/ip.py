"""Addresses as fixed-width hexadecimal text, so that a network prefix is a text prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
V4_TEXT = rf"^({OCTET}\.){{3}}{OCTET}\z"
# Hexadecimal groups of up to four digits with at most one double colon.
V6_TEXT = r"(?i)^(?!.*::.*::)(?!.*[0-9a-f]{5})[0-9a-f]*:[0-9a-f:]*\z"
V4_MAPPED_TEXT = r"(?i)^(0{0,4}:)+ffff:(?=[0-9]+\.)"
V4_MAPPED_HEX = "0" * 20 + "ffff"

V4_DIGITS = 8
V6_DIGITS = 32


def is_v6(ip: Column) -> Column:
    return ip.contains(":")


def _v4_hex(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("bigint"))), 2, "0"))
    return F.when(ip.rlike(V4_TEXT), F.array_join(octets, ""))


def _groups(ip: Column) -> Column:
    return F.filter(F.split(ip, ":"), lambda g: g != "")


def _v6_hex(ip: Column) -> Column:
    """32 digits; the double colon is filled up to eight groups first."""
    zeros = F.repeat(F.lit("0:"), F.lit(8) - F.size(_groups(ip)))
    full = F.replace(ip, F.lit("::"), F.concat(F.lit(":"), zeros))
    digits = F.array_join(F.transform(_groups(full), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    return F.when(ip.rlike(V6_TEXT), digits)


def address_hex(ip: Column) -> Column:
    """8 digits for IPv4 and 32 for IPv6; NULL for text that is neither.

    An IPv4-mapped IPv6 address counts as IPv4, as it does in the geo databases.
    """
    digits = F.when(is_v6(ip) & ~ip.contains("."), _v6_hex(ip)).otherwise(
        _v4_hex(F.regexp_replace(ip, V4_MAPPED_TEXT, ""))
    )
    mapped = F.regexp_replace(digits, f"^{V4_MAPPED_HEX}", "")
    return F.when(F.length(mapped).isin(V4_DIGITS, V6_DIGITS), mapped)


# What stays of a hexadecimal digit when only its first 1, 2 or 3 bits count.
DIGITS = "0123456789abcdef"
KEEP_BITS = {1: "0000000088888888", 2: "000044448888cccc", 3: "0022446688aaccee"}


def prefix_of(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address, as whole digits and a masked last one."""
    whole = F.floor(bits / 4).cast("int")
    rest = bits % 4
    last = F.substr(digits, whole + 1, F.lit(1))
    masked = F.lit("")
    for n, kept in KEEP_BITS.items():
        masked = F.when(rest == n, F.translate(last, DIGITS, kept)).otherwise(masked)
    return F.concat(F.substr(digits, F.lit(1), whole), masked)


def _short(group: Column) -> Column:
    return F.regexp_replace(group, "^0{1,3}", "")


def subnet_of(ip: Column, strict: bool = False) -> Column:
    """/24 of an IPv4 address, /64 of an IPv6 address.

    By default an IPv6 subnet is named by the first four non-empty groups as written, so a
    compressed address can name another network; ``strict`` expands ``::`` first.
    """
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    if strict:
        digits = _v6_hex(ip)
        first = F.array(*[_short(F.substr(digits, F.lit(1 + 4 * i), F.lit(4))) for i in range(4)])
    else:
        first = F.slice(_groups(ip), 1, 4)
    return F.when(is_v6(ip), F.concat(F.array_join(first, ":"), F.lit("::/64"))).otherwise(v4)


def subnet24(ip: Column) -> Column:
    """The 24-bit network of an address of either family, in compressed lower-case text."""
    digits = _v6_hex(ip)
    first = _short(F.substr(digits, F.lit(1), F.lit(4)))
    second = _short(F.concat(F.substr(digits, F.lit(5), F.lit(2)), F.lit("00")))
    both = F.concat_ws(":", first, second)
    v6 = F.regexp_replace(F.concat(both, F.lit("::/24")), "^(0:0|([0-9a-f]+):0)::", "$2::")
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    return F.when(is_v6(ip), v6).otherwise(v4)


def in_subnet(ip: Column, subnet: str) -> Column:
    """Text test against one configured subnet: prefix match for IPv6, first three octets for IPv4."""
    if "::" in subnet:
        return ip.startswith(subnet.split("::")[0])
    return F.substring_index(ip, ".", 3) == ".".join(subnet.split(".")[:3])
