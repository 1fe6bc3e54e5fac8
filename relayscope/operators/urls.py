"""Links out of bodies, and what is odd about them.

Of equal links in a message the first counts and keeps its anchor text. Null and empty bodies have no
links. Relative and mail links are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.config import NEW_DOMAIN_DAYS, REDIRECT_PARAMETERS
from relayscope.functions.net import is_ip

# fixed values: patterns
URL_PATTERN = r"https?://[^\s<>\"']+"
_ANCHOR_DOMAIN = r"\b([a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.[a-zA-Z]{2,})\b"
_LOOKS_LIKE_URL = r"^https?://[^\s]+\.[a-zA-Z]{2,}"


def text_links(df: DataFrame, message: str, body: str) -> DataFrame:
    """message, ordinal, raw_url of plain text; stays in the JVM and needs no shuffle."""
    found = F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(URL_PATTERN), F.lit(0)))
    return df.where(F.col(body).contains("://")).select(message, F.posexplode(found).alias("ordinal", "raw_url"))


#: A comment, a tag, or text. Quoted values end before the next tag at the latest, so reading is linear.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*)>|([^<]+|<)""", re.S)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def html_links(text: str) -> list[tuple[str, str | None]]:
    """(link, anchor text) of anchors, then of bare links in the visible text; each link once.

    Scripts, styles and comments aren't visible; tags that aren't closed are text.
    """
    links: list[tuple[str, list[str]]] = []
    visible: list[str] = []
    inside: list[str] | None = None
    hidden = ""
    for m in _MARKUP.finditer(text):
        closing, tag, attributes, plain = m.groups()
        if plain is not None:
            if not hidden:
                plain = html.unescape(plain)
                visible.append(plain)
                if inside is not None and plain.strip():
                    inside.append(plain.strip())
        elif tag is not None:
            tag = tag.lower()
            if hidden:
                hidden = "" if closing and tag == hidden else hidden
            elif tag in ("script", "style", "template") and not closing:
                hidden = tag
            elif tag == "a":
                inside = None
                href = None if closing else _HREF.search(attributes)
                if href:
                    inside = []
                    links.append((html.unescape(next(g for g in href.groups() if g is not None)).strip(), inside))
    found = [(href, "".join(parts) or None) for href, parts in links if href.lower().startswith(("http://", "https://"))]
    found += [(u, None) for u in re.findall(URL_PATTERN, " ".join(visible))]
    seen: dict[str, str | None] = {}
    for url, anchor in found:
        seen.setdefault(url, anchor)
    return list(seen.items())


def body_links(df: DataFrame, message: str, body: str, is_html: str) -> DataFrame:
    """message, ordinal, raw_url, anchor_text of HTML and plain bodies."""
    narrow = df.select(message, body, is_html).where(F.col(body).isNotNull())
    kind = dict(narrow.dtypes)[message]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ordinal, url, anchor = [], [], [], []
            for i, (text, rich) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                links = html_links(text) if rich else [(u, None) for u in dict.fromkeys(re.findall(URL_PATTERN, text))]
                for k, (u, a) in enumerate(links):
                    at.append(i)
                    ordinal.append(k)
                    url.append(u)
                    anchor.append(a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(url, pa.string()), pa.array(anchor, pa.string())], names=[message, "ordinal", "raw_url", "anchor_text"])

    return narrow.mapInArrow(run, f"`{message}` {kind}, ordinal int, raw_url string, anchor_text string")


def scheme_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    """Host in lower case, brackets of IPv6 taken off; null if there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"^\[|\]$", "")))


def claimed_domain(anchor: Column, host: Column) -> Column:
    """The first thing like a domain in the anchor text."""
    found = F.lower(F.regexp_extract(anchor, _ANCHOR_DOMAIN, 1))
    return F.when(host.isNotNull() & (found != ""), found)


def mismatch(claimed: Column, host: Column) -> Column:
    """Whether the claimed domain is neither the host, nor it with or without www, nor above or below it."""
    actual = F.lower(host)
    fits = (claimed == actual) | (claimed == F.concat(F.lit("www."), actual)) | (F.concat(F.lit("www."), claimed) == actual) | actual.endswith(F.concat(F.lit("."), claimed)) | claimed.endswith(F.concat(F.lit("."), actual))
    return F.coalesce(~fits, F.lit(False))


def redirect_target(url: Column) -> Column:
    """The link inside a redirecting parameter, percent- or base64-encoded; parameters are tried in a fixed order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.array(*[F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1) for name in REDIRECT_PARAMETERS])

    def target(value: Column) -> Column:
        plain = F.translate(value, "-_", "+/")
        padded = F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, "=")
        decoded = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
        return F.when(value.rlike(_LOOKS_LIKE_URL), value).when(decoded.rlike(_LOOKS_LIKE_URL), decoded)

    # one lambda over the parameters keeps the generated code small
    values = F.transform(F.filter(raw, lambda v: v != ""), lambda v: target(F.try_url_decode(v)))
    return F.when(url.contains("?"), F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)))


def analyse(links: DataFrame) -> DataFrame:
    """``links`` (raw_url, anchor_text) with scheme, host, is_ip_literal, anchor_claimed_domain, anchor_text_mismatch, unwrapped_target."""
    out = links.withColumns({"scheme": scheme_of(F.col("raw_url")), "host": host_of(F.col("raw_url")), "unwrapped_target": redirect_target(F.col("raw_url"))})
    out = out.withColumns({"is_ip_literal": is_ip(F.col("host")), "anchor_claimed_domain": claimed_domain(F.col("anchor_text"), F.col("host"))})
    return out.withColumn("anchor_text_mismatch", mismatch(F.col("anchor_claimed_domain"), F.col("host")))


def domain_ages(df: DataFrame, domain: str, intel: DataFrame | None, as_of: Column) -> DataFrame:
    """``df`` with registration_date, age_days, is_newly_registered and intel_source.

    ``intel`` (domain, registration_date) is an offline dimension; without it, or for domains it lacks,
    the source is ``unavailable`` and newness null, not false. Columns called like a result make way.
    """
    df = df.drop("registration_date")
    key = F.regexp_replace(F.trim(F.lower(F.col(domain))), r"\.+$", "")
    if intel is None:
        found = df.withColumn("registration_date", F.lit(None).cast("timestamp"))
    else:
        known = intel.select(F.regexp_replace(F.trim(F.lower("domain")), r"\.+$", "").alias("_key"), F.col("registration_date").cast("timestamp").alias("registration_date")).where("_key is not null").groupBy("_key").agg(F.min("registration_date").alias("registration_date"))
        found = df.withColumn("_key", key).join(known, "_key", "left").drop("_key")
    age = F.floor((F.unix_seconds(as_of) - F.unix_seconds("registration_date")) / 86400).cast("int")
    return found.withColumn("age_days", age).withColumn("is_newly_registered", F.col("age_days") < NEW_DOMAIN_DAYS).withColumn("intel_source", F.when(F.col("registration_date").isNull(), "unavailable").otherwise("cached"))
