"""Addresses: text to number, ranges, and what isn't public."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayscope.config import BOGON_V4, DOCUMENTATION_V4, DOCUMENTATION_V6

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def is_ipv4(ip: Column) -> Column:
    """Four octets without leading zeros."""
    return F.coalesce(ip.rlike(_V4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it isn't IPv4."""
    octets = F.transform(F.split(ip, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("bigint"))
    value = F.get(octets, F.lit(0)) * 16777216 + F.get(octets, F.lit(1)) * 65536 + F.get(octets, F.lit(2)) * 256 + F.get(octets, F.lit(3))
    return F.when(is_ipv4(ip), value)


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def _within(number: Column, cidrs: list[str]) -> Column:
    inside = F.lit(False)
    for low, high in map(cidr_bounds, cidrs):
        inside = inside | number.between(low, high)
    return inside


@F.pandas_udf(T.BooleanType())
def _ipv6_bogon(ips: pd.Series) -> pd.Series:
    spared = [ipaddress.ip_network(x) for x in DOCUMENTATION_V6]

    def test(text: str | None) -> bool:
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        if ip.version != 6 or any(ip in net for net in spared):
            return False
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_unspecified or ip.is_multicast

    return ips.map(test)


@F.pandas_udf(T.BooleanType())
def _ipv6_valid(ips: pd.Series) -> pd.Series:
    def test(text: str | None) -> bool:
        try:
            return ipaddress.ip_address(text).version == 6
        except ValueError:
            return False

    return ips.map(test)


@F.pandas_udf(T.StringType())
def _ipv6_digits(ips: pd.Series) -> pd.Series:
    def digits(text: str | None) -> str | None:
        try:
            ip = ipaddress.ip_address(text.split("%")[0]) if text else None
        except ValueError:
            return None
        return f"{int(ip):032x}" if ip is not None and ip.version == 6 else None

    return ips.map(digits)


def ipv6_hex(ip: Column) -> Column:
    """The address as 32 hexadecimal digits, which sort as the addresses do; null if it isn't IPv6. Only values with a colon reach Python."""
    return F.when(ip.contains(":"), _ipv6_digits(F.when(ip.contains(":"), ip)))


def is_bogon(ip: Column, ipv6: bool = True) -> Column:
    """Private, loopback, link-local, reserved, unspecified or multicast; documentation ranges and whatever isn't an address are not.

    IPv4 stays in the JVM. Only values with a colon reach Python; ``ipv6=False`` leaves them out.
    """
    number = ipv4_number(ip)
    v4 = _within(number, BOGON_V4) & ~_within(number, DOCUMENTATION_V4)
    v6 = F.when(ip.contains(":"), _ipv6_bogon(F.when(ip.contains(":"), ip).otherwise(F.lit("0")))) if ipv6 else F.lit(None).cast("boolean")
    return F.coalesce(v4, v6, F.lit(False))


def is_ip(text: Column) -> Column:
    """IPv4 or IPv6 literal."""
    return is_ipv4(text) | F.coalesce(F.when(text.contains(":"), _ipv6_valid(F.when(text.contains(":"), text).otherwise(F.lit("0")))), F.lit(False))


def organisation_domain(host: Column) -> Column:
    """The last two labels of a host, in lower case, without dots at the end."""
    return F.substring_index(plain_host(host), ".", -2)


def plain_host(host: Column) -> Column:
    """Lower case without dots at the end; null stays null."""
    return F.lower(F.regexp_replace(host, r"\.+$", ""))
