"""Indicators of compromise: addresses, hosts, links, digests, each with where it was found.

Order in a message: sender, hops (address, sending host, receiving host), attachments, links (link,
host, unwrapped target). Of equal (type, value) the first context counts; values are compared as written.
Null and empty values are no indicators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.operators.nested import parse_record, unwrap

ATTACHMENT_SCHEMA = "msg_id string, ordinal int, filename string, content_type string, size_bytes long, sha256 string"


def ip_type(ip: Column) -> Column:
    return F.when(ip.contains(":"), "ipv6").otherwise("ipv4")


def _rows(df: DataFrame, ordinal: Column, entries: list[tuple[Column, Column, Column]]) -> DataFrame:
    listed = F.array(*[F.struct((ordinal * len(entries) + k).cast("bigint").alias("ordinal"), kind.alias("type"), value.cast("string").alias("value"), context.alias("context")) for k, (kind, value, context) in enumerate(entries)])
    return df.select("msg_id", F.explode(listed).alias("i")).select("msg_id", "i.*").where("value <> ''")


def _text(value: object) -> str | None:
    return None if value is None else str(value).encode("utf-8", "replace").decode()


def _size(value: object) -> int | None:
    try:
        size = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return size if abs(size) < 2**63 else None


def stored_attachments(records: DataFrame) -> DataFrame:
    """Attachments of stored records (msg_id, record), read as ``nested`` reads them: a list, a single one, or JSON text of either.

    Only a message's own attachments, not those of messages attached to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["msg_id", "ordinal", "filename", "content_type", "size_bytes", "sha256"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for msg_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = unwrap((parse_record(text) or {}).get("attachments"))
                for ordinal, a in enumerate(held if isinstance(held, list) else [held]):
                    if isinstance(a := unwrap(a), dict):
                        rows.append((msg_id, ordinal, _text(a.get("filename")), _text(a.get("content_type")), _size(a.get("size_bytes")), _text(a.get("sha256"))))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return records.select(F.col("msg_id").cast("string").alias("msg_id"), "record").mapInArrow(run, ATTACHMENT_SCHEMA)


def candidates(messages: DataFrame, hops: DataFrame, attachments: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """All candidates with ``part`` and ``ordinal``, the order in which they are found."""
    seq = F.col("sequence").cast("string")
    parts = [
        _rows(messages, F.lit(0), [(F.lit("email"), F.col("from_address"), F.lit("sender (From) address"))]).withColumn("part", F.lit(0)),
        _rows(
            hops,
            F.col("sequence"),
            [
                (ip_type(F.col("from_ip")), F.col("from_ip"), F.concat(F.lit("relay hop #"), seq, F.lit(" source IP (claimed host: "), F.coalesce("from_host", F.lit("unknown")), F.lit(")"))),
                (F.lit("domain"), F.col("from_host"), F.concat(F.lit("relay hop #"), seq, F.lit(" source hostname"))),
                (F.lit("domain"), F.col("by_host"), F.concat(F.lit("relay hop #"), seq, F.lit(" receiving hostname"))),
            ],
        ).withColumn("part", F.lit(1)),
    ]
    if attachments is not None:
        context = F.concat(F.lit("attachment '"), F.coalesce("filename", F.lit("")), F.lit("' ("), F.coalesce(F.col("size_bytes").cast("string"), F.lit("0")), F.lit(" bytes, "), F.coalesce("content_type", F.lit("unknown type")), F.lit(")"))
        parts.append(_rows(attachments, F.col("ordinal"), [(F.lit("sha256"), F.col("sha256"), context)]).withColumn("part", F.lit(2)))
    if urls is not None:
        literal = F.coalesce("is_ip_literal", F.lit(False))
        parts.append(
            _rows(
                urls,
                F.col("ordinal"),
                [
                    (F.lit("url"), F.col("raw_url"), F.lit("link found in message body")),
                    (F.when(literal, ip_type(F.col("host"))).otherwise("domain"), F.col("host"), F.when(literal, F.concat(F.lit("IP-literal link host ("), F.col("raw_url"), F.lit(")"))).otherwise(F.concat(F.lit("host of link "), F.col("raw_url")))),
                    (F.lit("url"), F.col("unwrapped_target"), F.concat(F.lit("unwrapped redirect target of "), F.col("raw_url"))),
                ],
            ).withColumn("part", F.lit(3))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extract(messages: DataFrame, hops: DataFrame, attachments: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """msg_id, part, ordinal, type, value, context, each (type, value) of a message once."""
    first = Window.partitionBy("msg_id", "type", "value").orderBy("part", "ordinal", "context")
    return candidates(messages, hops, attachments, urls).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def case_id(row_id: Column, prefix: str = "CASE-") -> Column:
    """Prefix and the first eight hex digits of the id, in capitals."""
    return F.concat(F.lit(prefix), F.upper(F.substring(row_id, 1, 8)))
