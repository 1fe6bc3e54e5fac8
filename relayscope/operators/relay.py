"""Relay chains out of Received headers.

Headers are newest first; sequence 0 is the origin. What can't be read is null and lowers the hop's
confidence. Chains of null or empty arrays have no hops.
"""

from __future__ import annotations

from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayscope.functions.net import is_bogon, is_ipv4
from relayscope.operators.auth import fold

# fixed values: patterns of the header
_FROM = r"(?i)\bfrom\s+([^\s(;]+)(?:\s*\(([^)]*)\))?"
_BY = r"(?i)\bby\s+([^\s(;]+)"
_WITH = r"(?i)\bwith\s+([^\s;]+)"
_V4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_V6 = r"\b[0-9a-fA-F:]{2,45}\b"


def chain(df: DataFrame, headers: str) -> DataFrame:
    """One row per Received header, origin first: the other columns, ``sequence`` and ``raw_header``."""
    rest = [c for c in df.columns if c != headers]
    return df.select(*rest, F.posexplode(F.reverse(F.col(headers))).alias("sequence", "raw_header"))


def _stripped(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[,;]+$", ""))


def _ip_in(text: Column) -> Column:
    """First valid IPv4 address, else the first candidate with a colon that may be IPv6."""
    v4 = F.get(F.filter(F.regexp_extract_all(text, F.lit(_V4), F.lit(0)), is_ipv4), F.lit(0))
    v6 = F.get(F.filter(F.regexp_extract_all(text, F.lit(_V6), F.lit(0)), lambda x: x.contains(":") & _looks_ipv6(x)), F.lit(0))
    return F.coalesce(v4, v6)


def _looks_ipv6(text: Column) -> Column:
    """Groups of up to four hex digits, eight of them or fewer with one gap."""
    groups = F.size(F.filter(F.split(text, ":"), lambda g: g != ""))
    gap = text.contains("::")
    sound = text.rlike(r"^(?:[0-9a-fA-F]{0,4}:)+[0-9a-fA-F]{0,4}$") & ~text.rlike(":::|::.*::") & ~text.rlike("^:[^:]|[^:]:$")
    return sound & F.when(gap, groups <= 7).otherwise(groups == 8)


def stamp_text(header: Column) -> Column:
    """What stands after the last semicolon; null if there is none or nothing after it."""
    text = F.trim(F.substring_index(header, ";", -1))
    return F.when(header.contains(";") & (text != ""), text)


@F.pandas_udf(T.TimestampType())
def mail_date(texts: pd.Series) -> pd.Series:
    """The standard library's reading of a mail date; -0000 and a missing zone are UTC, unreadable text is null."""

    def read(text: str | None) -> datetime | None:
        if text is None:
            return None
        try:
            found = parsedate_to_datetime(text)
            return found.astimezone(UTC) if found.tzinfo else found.replace(tzinfo=UTC)
        except (TypeError, ValueError, OverflowError, IndexError):
            return None

    # with its zone, so that the session's zone doesn't matter
    return pd.Series([read(t) for t in texts], dtype="datetime64[us, UTC]")


def parse_hops(df: DataFrame, raw: str = "raw_header", with_time: bool = True) -> DataFrame:
    """``df`` with from_host, from_ip, by_host, protocol, timestamp_raw (and timestamp, parse_confidence) of each header."""
    text = fold(F.col(raw))
    whole = F.regexp_extract(text, _FROM, 0)
    parenthesis = F.regexp_extract(text, _FROM, 2)
    out = df.withColumns(
        {
            "from_host": _stripped(text, _FROM),
            "from_ip": F.coalesce(_ip_in(parenthesis), _ip_in(whole)),
            "by_host": _stripped(text, _BY),
            "protocol": _stripped(text, _WITH),
            "timestamp_raw": stamp_text(text),
        }
    )
    if not with_time:
        return out
    found = sum(F.col(c).isNotNull().cast("int") for c in ("from_host", "by_host", "timestamp"))
    return out.withColumn("timestamp", mail_date(F.col("timestamp_raw"))).withColumn("parse_confidence", F.round(found / 3.0, 2))


def mark_bogons(df: DataFrame, ip: str = "from_ip") -> DataFrame:
    """``df`` with ``is_bogon``."""
    return df.withColumn("is_bogon", is_bogon(F.col(ip)))


def unique_hops(df: DataFrame, message: str, hop_id: str) -> DataFrame:
    """Each hop once, by its id. Partitioned by message, which the windows over a chain then reuse."""
    return df.repartition(message).dropDuplicates([message, hop_id])
