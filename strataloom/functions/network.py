"""IPv4 addresses as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that count as private, as (first address, prefix length), and the two hosts that don't.
PRIVATE_NETWORKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32),
]
PUBLIC_HOSTS = ["192.0.0.9", "192.0.0.10"]


def _number(address: str) -> int:
    return reduce(lambda n, part: n * 256 + int(part), address.split("."), 0)


def ipv4_number(c: Column) -> Column:
    """The address as a bigint; null for what is none, octets above 255 and leading zeros included."""
    octet = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    parts = F.split(c, r"\.")
    value = reduce(lambda n, i: n * 256 + parts[i].cast("long"), range(1, 4), parts[0].cast("long"))
    return F.when(c.rlike(rf"^{octet}(\.{octet}){{3}}$"), value)


def is_private_ipv4(c: Column) -> Column:
    n = ipv4_number(c)
    inside = reduce(lambda a, b: a | b, [n.between(_number(a), _number(a) + 2 ** (32 - bits) - 1) for a, bits in PRIVATE_NETWORKS])
    return inside & ~n.isin([_number(a) for a in PUBLIC_HOSTS])


def private_ipv4_sql(n: str) -> str:
    """The same as SQL over a number."""
    ranges = " OR ".join(f"{n} BETWEEN {_number(a)} AND {_number(a) + 2 ** (32 - bits) - 1}" for a, bits in PRIVATE_NETWORKS)
    return f"(({ranges}) AND {n} NOT IN ({', '.join(str(_number(a)) for a in PUBLIC_HOSTS)}))"
