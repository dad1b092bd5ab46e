"""Column functions over IPv4 addresses and prefixes.

Addresses are dotted strings at the edges and BIGINT everywhere else, so joins and tests are integer work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def ip_to_int(ip) -> Column:
    """Dotted quad to 32-bit value held in a BIGINT; octets that are not given count as 0."""
    parts = F.split(_c(ip), r"\.")
    octet = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).cast("bigint"), F.lit(0))
    return (octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)).cast("bigint")


def int_to_ip(n) -> Column:
    n = _c(n)
    octet = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def ip_atom(ip) -> Column:
    """`w.x.y.z` -> `ipw_x_y_z`; an atom stays as it is."""
    ip = _c(ip)
    plain = F.when(ip.startswith("ip"), F.substr(ip, F.lit(3))).otherwise(ip)
    return F.concat(F.lit("ip"), F.translate(plain, ".", "_"))


def atom_ip(atom) -> Column:
    """`ipw_x_y_z` -> `w.x.y.z`; a dotted address stays as it is."""
    a = _c(atom)
    return F.translate(F.when(a.startswith("ip"), F.substr(a, F.lit(3))).otherwise(a), "_", ".")


def prefix_mask(length) -> Column:
    length = _c(length).cast("int")
    host = F.lit(32) - length
    return F.call_function("shiftleft", F.call_function("shiftright", F.lit(4294967295).cast("bigint"), host), host)


def prefix_match(net, length, ip) -> Column:
    mask = prefix_mask(length)
    return _c(ip).bitwiseAND(mask) == _c(net).bitwiseAND(mask)


def canonical_prefix(text):
    """`a.b.c.d[/len]` -> struct(net, len) with host bits cleared.

    Without a length it comes from the zero octets at the end: /8, /16 or /24; with none of these the length is null.
    """
    text = _c(text)
    addr = ip_to_int(F.split(text, "/")[0])
    given = F.try_element_at(F.split(text, "/"), F.lit(2)).cast("int")
    implied = (
        F.when(addr.bitwiseAND(F.lit(0xFFFFFF)) == 0, 8)
        .when(addr.bitwiseAND(F.lit(0xFFFF)) == 0, 16)
        .when(addr.bitwiseAND(F.lit(0xFF)) == 0, 24)
    )
    length = F.coalesce(given, implied)
    return F.struct(
        F.coalesce(addr.bitwiseAND(prefix_mask(length)), addr).alias("net"), length.cast("int").alias("len")
    )


def off_by_one(a, b) -> Column:
    """Addresses next to each other inside one /30."""
    a, b = _c(a), _c(b)
    return (F.abs(a - b) == 1) & (F.shiftright(a, 2) == F.shiftright(b, 2))


def off_by_one_loose(a, b) -> Column:
    """Addresses next to each other inside one /24."""
    a, b = _c(a), _c(b)
    return (F.abs(a - b) == 1) & (F.shiftright(a, 8) == F.shiftright(b, 8))


def link_peer_addresses(ip, length, compat: bool = False) -> Column:
    """Addresses that may sit at the far end of a point-to-point or small shared subnet.

    For a /29 the default is every other host of the subnet; ``compat`` gives octet+1 .. (octet+1)|6 instead.
    """
    ip, length = _c(ip), _c(length)
    if compat:
        octet = ip.bitwiseAND(F.lit(255))
        base = ip - octet
        first = octet + 1
        wide = F.transform(F.sequence(first, first.bitwiseOR(F.lit(6))), lambda o: base + o)
    else:
        net = ip.bitwiseAND(F.lit(0xFFFFFFF8))
        wide = F.filter(F.sequence(net + 1, net + 6), lambda x: x != ip)
    return (
        F.when(length == 31, F.array(ip.bitwiseXOR(F.lit(1))))
        .when(length == 30, F.array(ip.bitwiseXOR(F.lit(3))))
        .when(length == 29, wide)
        .otherwise(F.array().cast("array<bigint>"))
    )


def is_bogon(ip) -> Column:
    ip = _c(ip)
    return (
        (F.shiftright(ip, 24) == 10)
        | (F.shiftright(ip, 16) == 192 * 256 + 168)
        | (F.shiftright(ip, 20) == 172 * 16 + 1)
    )


def is_loopback(ip) -> Column:
    return _c(ip) == F.lit(127 * 16777216 + 1)


def canonical_pair(a, b):
    """Order-free pair: two columns, smaller first."""
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))


def subnet_key(ip_text, octets: int = 2) -> Column:
    return F.substring_index(_c(ip_text), ".", octets)
