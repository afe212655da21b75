"""IP addresses as text: canonical form and membership in networks."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def bare(address: Column) -> Column:
    """Without surrounding blanks and brackets."""
    return F.regexp_replace(F.trim(address), r"^\[+|\]+$", "")


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    part = F.split(bare(address), "[.]")
    value = sum((F.try_element_at(part, F.lit(i + 1)).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(1, 4)), F.try_element_at(part, F.lit(1)).try_cast("bigint") * (1 << 24))
    return F.when(bare(address).rlike(IPV4), value)


def ipv6_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address in lower-case hexadecimal without leading zeros; null if it isn't one."""

    def dotted_tail(a: Column) -> Column:
        tail = F.regexp_extract(a, r"([0-9]+(?:\.[0-9]+){3})$", 1)
        return F.when(tail == "", a).otherwise(let(ipv4_number(tail), lambda n: F.concat(F.substring(a, F.lit(1), F.length(a) - F.length(tail)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(F.pmod(n, F.lit(65536)))))))

    def groups(a: Column) -> Column:
        halves = F.split(a, "::")
        parts = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
        filled = F.when(F.size(halves) == 1, parts(1)).otherwise(F.concat(parts(1), F.array_repeat(F.lit("0"), F.greatest(F.lit(1), 8 - F.size(parts(1)) - F.size(parts(2)))), parts(2)))
        sound = a.rlike(r"^[0-9a-f:]+$") & a.contains(":") & ~a.contains(":::") & (F.size(halves) <= 2) & ~a.rlike("^:[^:]|[^:]:$")
        return let(filled, lambda g: F.when(sound & (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(g, lambda x: F.regexp_replace(x, "^0{1,3}(?=.)", ""))))

    return let(dotted_tail(F.lower(bare(address))), groups)


def canonical_ip(address: Column) -> Column:
    """The canonical text of an IPv4 or IPv6 address (an embedded IPv4 part as groups); null if it is neither."""
    return F.when(bare(address).rlike(IPV4), bare(address)).when(address.contains(":"), let(ipv6_groups(address), lambda g: let(F.concat(F.lit(":"), F.array_join(g, ":"), F.lit(":")), packed)))


def packed(text: Column) -> Column:
    """``:1:0:0:2:`` with its longest run of zeros, the first of equal ones, as ``::``; without the outer colons."""
    runs = [":" + "0:" * n for n in range(8, 1, -1)]
    run = F.coalesce(*[F.when(text.contains(r), F.lit(r)) for r in runs])
    trimmed = F.regexp_replace(text, "^:|:$", "")
    return F.when(run.isNull(), trimmed).otherwise(F.concat(F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(1), F.instr(text, run) - 1), "^:", ""), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_replace(F.substring(text, F.instr(text, run) + F.length(run), F.length(text)), "^:", ""), ":$", "")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_network(address: Column, network: str) -> Column:
    """Whether the address lies in the network (host bits of the network are ignored); false for other texts."""
    net = ipaddress.ip_network(network.strip().strip("[]"), strict=False)
    if net.version == 4:
        n = ipv4_number(address)
        return F.coalesce(n.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    bits = F.array_join(F.transform(ipv6_groups(address), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.coalesce(F.substring(bits, 1, net.prefixlen) == f"{int(net.network_address):0128b}"[: net.prefixlen], F.lit(False))
