"""Columns of a stored message record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_text(record: Column) -> Column:
    """The record's JSON; a record that is itself stored as a JSON string is unpacked once."""
    return F.when(record.startswith('"'), F.get_json_object(record, "$")).otherwise(record)


def record_field(record: Column, field: str) -> Column:
    """A top-level field as text; null for a null, broken or non-object record."""
    return F.get_json_object(record_text(record), f"$.{field}")


def plain_message_id(raw: Column) -> Column:
    """Without blanks and angle brackets around it, the part after the last @ in lower case; null if empty."""
    bare = F.regexp_replace(raw, r"^[\s<>]+|[\s<>]+$", "")
    at = F.length(bare) - F.length(F.substring_index(bare, "@", -1))
    return F.when(bare == "", None).when(bare.contains("@"), F.concat(F.substr(bare, F.lit(1), at), F.lower(F.substring_index(bare, "@", -1)))).otherwise(bare)


def delivery_key(record: Column, sha256: Column, row_id: Column) -> Column:
    """What makes two rows the same message: the message id, else the digest in lower case, else the row itself."""
    digest = F.lower(F.trim(sha256))
    return F.coalesce(
        F.concat(F.lit("m:"), plain_message_id(record_field(record, "message_id"))),
        F.concat(F.lit("s:"), F.when(digest != "", digest)),
        F.concat(F.lit("r:"), row_id),
    )
