"""Addresses joined with ranges of addresses, IPv4 and IPv6.

Ranges are cut at the borders of blocks, /16 of IPv4 and /32 of IPv6, so the join is an equality on the
block with a range condition on top: it shuffles or broadcasts like any other, skewed blocks are split
by AQE, and no nested loop arises. Ranges broader than ``_WIDE`` blocks go by blocks 256 or 65 536 times
as wide. Where ranges overlap, the narrowest counts, then the lowest start. Null, invalid and unmatched
addresses keep null columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.functions.net import ipv4_number, ipv6_hex

_WIDE = 256


def _half(digits: Column, first: int) -> Column:
    """Sixteen hexadecimal digits as a number, near enough to tell ranges of different size apart."""
    return F.conv(F.substring(digits, first, 16), 16, 10).cast("double")


def _best(wanted: DataFrame, ranges: DataFrame, columns: list[str], block: Column, low: Column, high: Column, broad: int, size: Column) -> DataFrame:
    """``_ip`` with the columns of its narrowest range. ``block`` of an address, ``low`` and ``high`` of a range: numbers of blocks; ``broad``: blocks that make a wide one."""
    found = None
    kept = ranges.withColumns({"_first": low, "_last": high, "_size": size})
    for step in (1, broad):
        few = F.col("_last") - F.col("_first") < _WIDE
        part = kept.where(few if step == 1 else ~few).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / step), F.floor(F.col("_last") / step))))
        one = wanted.withColumn("_block", F.floor(block / step)).join(part, "_block").where(F.col("_ip").between(F.col("low"), F.col("high")))
        found = one if found is None else found.unionByName(one)
    narrowest = Window.partitionBy("_ip").orderBy("_size", "low", *columns)
    return found.withColumn("_n", F.row_number().over(narrowest)).where("_n = 1").select("_ip", *columns)


def range_join(df: DataFrame, ip: str, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of the range (``low`` to ``high``) that its address ``ip`` lies in; columns it had by these names make way.

    Bounds are numbers of IPv4 addresses, or addresses as text, IPv4 and IPv6 ones side by side. A range
    with an invalid bound, or with bounds of two kinds, is none.
    """
    narrow = df.drop(*columns)
    textual = dict(ranges.dtypes)["low"] == "string"
    number = (lambda c: ipv4_number(F.trim(F.col(c)))) if textual else (lambda c: F.col(c).cast("bigint"))
    v4 = ranges.select(number("low").alias("low"), number("high").alias("high"), *columns).where("low <= high")
    block4 = lambda c: F.floor(F.col(c) / 65536)
    numbered = narrow.withColumn("_ip4", ipv4_number(F.col(ip)))
    # each address is looked up once, however often it occurs
    wanted = numbered.select(F.col("_ip4").alias("_ip")).where("_ip is not null").distinct()
    best = _best(wanted, v4, columns, block4("_ip"), block4("low"), block4("high"), 256, (F.col("high") - F.col("low")).cast("double"))
    if not textual:
        return numbered.join(best.withColumnRenamed("_ip", "_ip4"), "_ip4", "left").drop("_ip4")
    v6 = ranges.select(ipv6_hex(F.trim("low")).alias("low"), ipv6_hex(F.trim("high")).alias("high"), *columns).where("low <= high")
    block6 = lambda c: F.conv(F.substring(F.col(c), 1, 8), 16, 10).cast("bigint")
    size6 = (_half(F.col("high"), 1) - _half(F.col("low"), 1)) * 2.0**64 + (_half(F.col("high"), 17) - _half(F.col("low"), 17))
    both = numbered.withColumn("_ip6", ipv6_hex(F.col(ip)))
    wanted6 = both.select(F.col("_ip6").alias("_ip")).where("_ip is not null").distinct()
    best6 = _best(wanted6, v6, columns, block6("_ip"), block6("low"), block6("high"), 65536, size6)
    # the two kinds of keys can't meet: the one is digits only, of at most ten, the other 32 of them
    found = best.withColumn("_ip", F.col("_ip").cast("string")).unionByName(best6)
    return both.withColumn("_ip", F.coalesce(F.col("_ip4").cast("string"), "_ip6")).join(found, "_ip", "left").drop("_ip", "_ip4", "_ip6")


def enrich(hops: DataFrame, cities: DataFrame | None, networks: DataFrame | None) -> DataFrame:
    """Hops with country, city, latitude, longitude, asn, asn_org and enrichment_source.

    ``cities`` and ``networks`` have low, high and their columns. Addresses that aren't public are never
    looked up. The source is ``unavailable`` unless one of the two has the address.
    """
    public = hops.withColumn("_public", F.when(~F.col("is_bogon"), F.col("from_ip")))
    place, net = ["country", "city", "latitude", "longitude"], ["asn", "asn_org"]
    kinds = {"latitude": "double", "longitude": "double", "asn": "int"}
    out = public
    for table, columns in ((cities, place), (networks, net)):
        if table is None:
            out = out.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in columns})
        else:
            out = range_join(out, "_public", table, columns)
    hit = F.coalesce(*[F.col(c).cast("string") for c in place + net]).isNotNull()
    return out.withColumn("enrichment_source", F.when(hit, "geolite2-local").otherwise("unavailable")).drop("_public")
