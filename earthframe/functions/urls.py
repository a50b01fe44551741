"""Which published hrefs may be read: characters, scheme, host, address, allowlist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from earthframe.functions.rules import first_failure, let

# IPv4 blocks that are not public unicast (special-purpose registry, multicast).
NON_PUBLIC_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# Fixed value: what a catalog identifier may look like.
IDENTIFIER = r"^[A-Za-z0-9._-]{1,200}$"


def valid_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER) & ~value.isin(".", ".."), F.lit(False))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user info and port; '' when it has none."""
    authority = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(v6 != "", v6).otherwise(F.regexp_replace(bare, r":\d*$", "")))


def _ipv4_number(host: Column) -> Column:
    octets = [F.regexp_extract(host, _IPV4, i).try_cast("bigint") for i in range(1, 5)]
    return F.when(host.rlike(_IPV4), reduce(lambda acc, o: acc * 256 + o, octets))


def non_public_address(host: Column) -> Column:
    """Whether the host is an IP literal outside the public unicast space."""
    blocks = [ip_network(b) for b in NON_PUBLIC_IPV4]
    in_block = let(_ipv4_number(host), lambda number: reduce(lambda a, b: a | b, [
        number.between(int(b.network_address), int(b.broadcast_address)) for b in blocks]))
    is_v6 = host.contains(":")
    head = F.conv(F.regexp_extract(host, r"^([0-9a-f]{1,4}):", 1), 16, 10).try_cast("int")
    second = F.coalesce(
        F.conv(F.regexp_extract(host, r"^[0-9a-f]{1,4}:([0-9a-f]{1,4})", 1), 16, 10)
        .try_cast("int"), F.lit(0))
    global_v6 = (
        head.between(0x2000, 0x3FFF)
        & ~((head == 0x2001) & ((second < 0x200) | (second == 0xDB8)))
        & (head != 0x2002) & ~((head == 0x3FFF) & (second < 0x1000))
    )
    return F.when(is_v6, ~F.coalesce(global_v6, F.lit(False))).otherwise(
        F.coalesce(in_block, F.lit(False)))


def href_problem(url: Column, trusted: Sequence[str] = ()) -> Column:
    """Code of the first rule an href breaks, or NULL when it may be read."""
    scheme = F.lower(F.when(url.contains("://"), F.substring_index(url, "://", 1)))
    entries = [e.strip().lower().lstrip("*") for e in trusted]
    entries = [e for e in entries if e]

    def host_rules(host: Column) -> Column:
        rules = [(host == "", "no_host"), (non_public_address(host), "non_public_address")]
        if entries:
            permitted = reduce(lambda a, b: a | b, [
                (host == e.lstrip(".")) | host.endswith(e if e.startswith(".") else f".{e}")
                for e in entries])
            rules.append((~permitted, "host_not_trusted"))
        return first_failure(rules)

    return first_failure([
        (url.rlike(r"[\x00\r\n\t]"), "control_character"),
        (~F.coalesce(scheme, F.lit("")).isin("http", "https"), "unreadable_scheme"),
        let(host_of(url), host_rules),
    ])
