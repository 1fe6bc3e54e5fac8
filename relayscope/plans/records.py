"""Queries of the general record problems: nested records, repeated deliveries, mixed time stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.functions.messages import delivery_key, record_field
from relayscope.operators.nested import AUTH_CHILDREN, AUTH_PLACES, META_CHILDREN, META_PLACES, children, shred
from relayscope.operators.timestamps import normalise
from relayscope.sources.tables import table
from relayscope.streaming.dedupe import kept_ids, run_dedupe, surplus_ids

READ_STATUS = "complete"


def _shredded(spark: SparkSession, folder: str):
    return shred(table(spark, folder, "analyses"), "id", ["meta_json", "authentication_json"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Children of nested records: id, path, item."""
    return children(_shredded(spark, folder), {"meta_json": META_PLACES, "authentication_json": AUTH_PLACES}).select("id", "path", "item")


def p1_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct object once, with the number of its occurrences."""
    return _shredded(spark, folder).objects


def p1_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of an object, array or element, records included: parent identity, key, ordinal, path, own identity."""
    return _shredded(spark, folder).bridge


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with what its root object says of it and how many occurrences it has below: id, source, subject, message_id, raw_header, lists."""
    shredded = _shredded(spark, folder)
    roots = shredded.bridge.where("path = ''").select("id", "source", "hash")
    said = shredded.objects.select("hash", *[F.get_json_object("content", f"$.{c}").alias(c) for c in ("subject", "message_id", "raw_header")])
    lists = shredded.bridge.where(F.col("path").isin(*META_CHILDREN)).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("lists"))
    found = roots.join(said, "hash").join(lists, "id", "left")
    return found.select("id", "source", "subject", "message_id", "raw_header", F.when(F.col("source") == "meta_json", F.coalesce("lists", F.lit(""))).alias("lists"))


def _delivery_log(spark: SparkSession, folder: str) -> DataFrame:
    key = delivery_key(F.col("meta_json"), F.col("sha256"), F.col("id"))
    return run_dedupe(spark, f"{folder}/analyses.parquet", key, F.col("created_at"), F.col("id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Surplus copies of messages: id."""
    return surplus_ids(_delivery_log(spark, folder)).select("id")


def p3_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The copies that stay: id."""
    return kept_ids(_delivery_log(spark, folder)).select("id")


def _stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Relay stamps and Date headers in one form: field, id, source, raw, stored, zone, date_order, read (whether the analysis was)."""
    hosts = table(spark, folder, "mail_hosts").select(F.lower("host").alias("source"), F.col("time_zone").alias("zone"), "date_order")
    relay = table(spark, folder, "hops").select(
        F.lit("timestamp").alias("field"),
        "id",
        F.coalesce(F.lower(F.trim("by_host")), F.lit("")).alias("source"),
        F.col("timestamp_raw").alias("raw"),
        F.col("timestamp").alias("stored"),
        F.col("timestamp").isNotNull().alias("stands"),
        F.lit(True).alias("read"),
    ).join(hosts, "source", "left")
    record = F.col("meta_json")
    stored = record_field(record, "date_parsed")
    header = (
        table(spark, folder, "analyses")
        .select(
            F.lit("date_parsed").alias("field"),
            "id",
            F.concat(F.lit("Date headers of "), F.coalesce(F.lower(F.substring_index("from_address", "@", -1)), F.lit("nobody"))).alias("source"),
            record_field(record, "date_raw").alias("raw"),
            F.try_to_timestamp(stored).alias("stored"),
            (F.coalesce(F.trim(stored), F.lit("")) != "").alias("stands"),
            F.lit(None).cast("string").alias("zone"),
            F.lit(None).cast("string").alias("date_order"),
            F.coalesce(F.col("status") == READ_STATUS, F.lit(False)).alias("read"),
        )
    )
    return relay.unionByName(header)


def p4_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every stamp, of unread analyses too, with its instant, or why it has none."""
    return normalise(_stamps(spark, folder), raw="raw").select("field", "id", "raw", "stored", "instant", "status", "format", "posterior")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stored values that aren't the instant stated: field, id."""
    found = normalise(_stamps(spark, folder), raw="raw").where("read").where(
        F.when(F.col("instant").isNull(), F.col("stands")).otherwise(F.col("stored").isNull() | (F.col("stored") != F.col("instant")))
    )
    return found.select("field", "id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_objects, p1_bridge, p1_records, p3_found, p3_kept, p4_found, p4_instants)}


def _held(v: str) -> str:
    """SQL for what JSON text holds; text that starts like JSON but isn't complete holds nothing."""
    text = f"json_extract_string({v}, '$')"
    return f"(CASE WHEN json_type({v}) = 'VARCHAR' AND left(ltrim({text}), 1) IN ('{{', '[', '\"') THEN CASE WHEN json_valid({text}) THEN CAST({text} AS JSON) END ELSE {v} END)"


def elements(source: str, key: str) -> str:
    """SQL for the elements below a key, with their positions; null elements are left out."""
    size = "CAST(CASE WHEN json_type(n) = 'ARRAY' THEN json_array_length(n) WHEN n IS NULL THEN 0 ELSE 1 END AS BIGINT)"
    held = f"SELECT id, prefix, {_held(f"json_extract(j, '$.{key}')")} AS n FROM {source}"
    each = f"SELECT id, prefix, i, CASE WHEN json_type(n) = 'ARRAY' THEN json_extract(n, '$[' || i || ']') ELSE n END AS e FROM (SELECT id, prefix, n, unnest(range({size})) AS i FROM ({held}))"
    return f"(SELECT id, prefix, i, {_held('e')} AS e FROM ({each}) WHERE e IS NOT NULL AND json_type(e) <> 'NULL')"


def whole_record(column: str) -> str:
    """SQL for a stored record."""
    return f"(CASE WHEN json_valid({column}) THEN {_held(f'CAST({column} AS JSON)')} END)"


def _p1_sql() -> str:
    inner = "json_extract(e, '$.embedded')"
    said = [f"SELECT id, prefix || '{key}/' || i AS path, json_extract_string(e, '$.{field}') AS item FROM {elements('m', key)}" for key, field in (("attachments", "sha256"), ("issues", "field"))]
    said += [f"SELECT id, prefix || 'to_addresses/' || i, json_extract_string(e, '$') FROM {elements('m', 'to_addresses')}", "SELECT id, rtrim(prefix, '/'), json_extract_string(j, '$.sha256') FROM m WHERE prefix <> '' AND json_type(j) = 'OBJECT'"]
    said += [f"SELECT id, '{key}/' || i, json_extract_string(e, '$.result') FROM {elements('a', key)}" for key in AUTH_CHILDREN]
    return f"""
WITH RECURSIVE m(id, prefix, j) AS (
 SELECT id, '', {whole_record('meta_json')} FROM analyses
 UNION ALL SELECT id, prefix || 'attachments/' || i || '/embedded/', {_held(inner)} FROM {elements('m', 'attachments')} WHERE json_type({inner}) <> 'NULL'),
a(id, prefix, j) AS (SELECT id, '', {whole_record('authentication_json')} FROM analyses)
{" UNION ALL ".join(said)}"""


_P3_SQL = """
WITH k AS (SELECT id, created_at, lower(sha256) AS sha, CASE WHEN json_valid(meta_json) THEN regexp_replace(json_extract_string(CASE WHEN json_type(meta_json) = 'VARCHAR' THEN json_extract_string(meta_json, '$') ELSE meta_json END, '$.message_id'), '^[\\s<>]+|[\\s<>]+$', '', 'g') END AS mid FROM analyses),
g AS (SELECT id, created_at, CASE WHEN coalesce(mid, '') = '' THEN 's:' || sha WHEN contains(mid, '@') THEN 'm:' || regexp_replace(mid, '[^@]*$', '') || lower(regexp_extract(mid, '([^@]*)$', 1)) ELSE 'm:' || mid END AS key FROM k)
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY created_at, id) AS n FROM g)"""


def _p1_records_sql() -> str:
    # a key's list is an occurrence of its own if it is stored as an array
    lists = " || ".join(f"CASE WHEN json_type({_held(f"json_extract(j, '$.{key}')")}) = 'ARRAY' THEN '{key},' ELSE '' END" for key in sorted(META_CHILDREN))
    fields = ", ".join(f"CASE WHEN json_type(j, '$.{c}') <> 'NULL' THEN json_extract_string(j, '$.{c}') END AS {c}" for c in ("subject", "message_id", "raw_header"))
    return f"""
WITH r AS (SELECT id, 'meta_json' AS source, {whole_record('meta_json')} AS j FROM analyses UNION ALL SELECT id, 'authentication_json', {whole_record('authentication_json')} FROM analyses)
SELECT id, source, {fields}, CASE WHEN source = 'meta_json' THEN rtrim({lists}, ',') END AS lists FROM r WHERE json_type(j) = 'OBJECT'"""


ORACLE_SQL = {
    "p1_found": _p1_sql(),
    "p1_records": _p1_records_sql(),
    "p3_found": _P3_SQL + " WHERE n > 1",
    "p3_kept": _P3_SQL + " WHERE n = 1",
}
