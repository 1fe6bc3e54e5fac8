"""Authentication verdicts out of header text.

Only the topmost Authentication-Results header counts. Mechanism names are matched as written, small
letters; a semicolon ends a segment even inside a comment; of each mechanism the first segment counts.
A null header gives source ``unavailable`` and null verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.config import AUTH_RESULTS, DMARC_POLICIES

MECHANISMS = ("spf", "dkim", "dmarc")
# fixed values: patterns of the header
_RESULT = r"\b(spf|dkim|dmarc)\s*=\s*([a-zA-Z]+)"
_COMMENT = r"\(([^()]*)\)"
_DOMAIN = r"header\.from=([^\s;]+)|header\.d=([^\s;]+)|smtp\.mailfrom=(?:[^@\s;]*@)?([^\s;]+)"
_DOMAIN_NAME = r"^(?:header\.from=|header\.d=|smtp\.mailfrom=(?:[^@\s;]*@)?)"
_POLICY = r"\b(?:policy|p)=([a-zA-Z]+)"


def fold(header: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(header, r"(?U)\s+", " "))


#: A segment with a verdict; the second group is the mechanism of its first one.
_SEGMENT = r"(?:^|;)([^;]*?\b(spf|dkim|dmarc)\s*=\s*[a-zA-Z][^;]*)"


def segment_of(parts: Column, mechanisms: Column, mechanism: str) -> Column:
    """Of the segments with a verdict, the first that is of ``mechanism``; null if there is none."""
    return F.trim(F.get(parts, F.array_position(mechanisms, mechanism).cast("int") - 1))


def result_of(segment: Column) -> Column:
    word = F.lower(F.regexp_extract(segment, _RESULT, 2))
    return F.when(segment.isNotNull(), F.when(word.isin(*AUTH_RESULTS), word).otherwise("unknown"))


def domain_of(segment: Column) -> Column:
    """The leftmost domain that the segment names, its local part taken off."""
    return F.regexp_replace(F.regexp_substr(segment, F.lit(_DOMAIN)), _DOMAIN_NAME, "")


def reason_of(segment: Column) -> Column:
    """The first comment without comments inside."""
    comment = F.regexp_substr(segment, F.lit(_COMMENT))
    return F.trim(F.substr(comment, F.lit(2), F.length(comment) - 2))


def policy_of(segment: Column) -> Column:
    """Published DMARC policy of the DMARC segment, else ``unknown``."""
    word = F.lower(F.regexp_extract(segment, _POLICY, 1))
    return F.when(word.isin(*DMARC_POLICIES), word).otherwise("unknown")


def parse(df: DataFrame, header: str) -> DataFrame:
    """``df`` with source, and of each mechanism result, reason, domain and segment, and dmarc_policy."""
    out = df.withColumn("source", F.when(F.col(header).isNull(), "unavailable").otherwise("authentication-results-header"))
    # two passes over the header serve all mechanisms
    folded = out.withColumn("_folded", fold(F.col(header)))
    split = folded.withColumns({f"_{n}": F.regexp_extract_all("_folded", F.lit(_SEGMENT), F.lit(i)) for i, n in ((1, "parts"), (2, "mechanisms"))})
    out = split.withColumns({f"{m}_segment": segment_of(F.col("_parts"), F.col("_mechanisms"), m) for m in MECHANISMS}).drop("_folded", "_parts", "_mechanisms")
    named = {}
    for m in MECHANISMS:
        segment = F.col(f"{m}_segment")
        named |= {f"{m}_result": result_of(segment), f"{m}_reason": reason_of(segment), f"{m}_domain": domain_of(segment)}
    return out.withColumns(named | {"dmarc_policy": F.coalesce(policy_of(F.col("dmarc_segment")), F.lit("unknown"))})


_LATEST = 253_402_300_799  # 9999-12-31T23:59:59Z


def dkim_tags(signature: Column) -> Column:
    """Tags of a DKIM signature as a map; of equal tags the last counts."""
    pairs = F.filter(F.transform(F.split(signature, ";"), lambda p: F.trim(p)), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    # the last of equal keys, whatever the session says about duplicate map keys
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries) + 1), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def dkim_expiry(df: DataFrame, signature: str, message_time: str, as_of: Column | None = None) -> DataFrame:
    """``df`` with dkim_signature_present, dkim_expiry and dkim_signature_expired (before the message time, else before ``as_of``)."""
    tag = F.try_element_at(dkim_tags(F.col(signature)), F.lit("x"))
    # however long the number is; times beyond the last year there is count as its end
    expiry = F.when(tag.rlike(r"^\d+$"), F.timestamp_seconds(F.least(F.coalesce(tag.try_cast("bigint"), F.lit(_LATEST)), F.lit(_LATEST))))
    reference = F.coalesce(F.col(message_time), as_of) if as_of is not None else F.col(message_time)
    return (
        df.withColumn("dkim_signature_present", F.coalesce(F.col(signature) != "", F.lit(False)))
        .withColumn("dkim_expiry", expiry)
        .withColumn("dkim_signature_expired", F.coalesce(F.col("dkim_expiry") < reference, F.lit(False)))
    )
