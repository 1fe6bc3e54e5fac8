"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.llm import encoding, fields, leaks, lookalikes, mojibake, pii, subjects
from relayscope.sources.tables import table


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    analyses = table(spark, folder, "analyses")
    known = pii.name_knowledge(analyses, ["from_address", "meta_json"])
    return pii.mask_fields(analyses, "id", {f: F.col(f) for f in ("analyst_notes", "subject", "from_display_name")}, known)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of personal data that a value mentions: id, field, kind."""
    return _mentions(spark, folder).select("id", "field", F.explode(F.array_distinct("kinds")).alias("kind"))


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Values with a mention, placeholders in place of it: id, field, masked."""
    return _mentions(spark, folder).select("id", "field", "masked")


def _disguised(spark: SparkSession, folder: str) -> DataFrame:
    """Values that aren't in plain form: id, field, value, plain. Garbled values are left out."""
    analyses = table(spark, folder, "analyses").select("id", "from_address", "from_display_name", "ai_signals_json")
    values = fields.long_form(analyses, "id", {"from_address": F.col("from_address"), "from_display_name": F.col("from_display_name"), fields.LOOKALIKE_DOMAIN: fields.lookalike_domain()})
    odd = values.where(F.col("value").rlike(r"[^\x20-\x7E]"))
    forms = lookalikes.plain_forms(mojibake.mark(odd, "value"), ["id", "field", "value"], "value", unless="garbled")
    return forms.where((F.col("plain") != F.col("value")) | F.col("mixed"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values spelled with other characters: id, field."""
    return _disguised(spark, folder).select("id", "field")


def p5_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Disguised values with their ordinary spelling: id, field, value, plain."""
    return _disguised(spark, folder).select("id", "field", "value", "plain")


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.detect(table(spark, folder, "analyses"), ["subject", "from_display_name"], ["id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that came from a wrong decoding: id, field."""
    return _garbled(spark, folder).select("id", "field")


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled values with what could be restored."""
    return _garbled(spark, folder)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document: doc_id, ids."""
    return encoding.encode(table(spark, folder, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the ids of ``p7_ids`` stand for: doc_id, text."""
    return encoding.decode(p7_ids(spark, folder), "doc_id", "ids")


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.search(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a run of an item: doc_id, item_id."""
    return leaks.leaked(_matches(spark, folder)).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the longest verbatim match and its place."""
    return leaks.leaked(_matches(spark, folder))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold no item: doc_id."""
    affected = p8_found(spark, folder).select("doc_id").distinct()
    return table(spark, folder, "documents").select("doc_id").join(affected, "doc_id", "left_anti")


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels, areas, items = (table(spark, folder, t) for t in ("documents", "area_labels", "subject_areas", "eval_items"))
    return subjects.subject_areas(docs, labels, areas, items)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Areas that a document is about: doc_id, area."""
    return _areas(spark, folder).select("doc_id", "area")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus composition: documents and sentences by area."""
    return _areas(spark, folder).groupBy("area").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {f.__name__: f for f in (p2_found, p2_masked, p5_found, p5_plain, p6_found, p6_restored, p7_ids, p7_decoded, p8_found, p8_matches, p8_kept, p9_found, p9_composition)}
ORACLE_SQL = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
