"""The text fields of stored analyses in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.functions.messages import record_text

LOOKALIKE_DOMAIN = "lookalike_domain"


def lookalike_domain(signals: str = "ai_signals_json") -> F.Column:
    return F.get_json_object(record_text(F.col(signals)), "$.sender_domain_lookalike.domain")


def long_form(df: DataFrame, key: str, fields: dict[str, F.Column]) -> DataFrame:
    """(key, field, value) for each value that isn't null."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), column.cast("string").alias("value")) for name, column in fields.items()])
    return df.select(key, F.explode(pairs).alias("x")).select(key, "x.field", "x.value").where("value is not null")
