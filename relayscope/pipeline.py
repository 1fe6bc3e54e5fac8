"""From raw messages to all tables of a report, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.config import MOST_BRANDS
from relayscope.operators import anomalies, attribution, auth, geo, iocs, lookalike, models, relay, scoring, urls
from relayscope.operators import reports as report_forms
from relayscope.session import materialize
from relayscope.sources import messages


@dataclass(frozen=True)
class Reports:
    """Long-form tables, all keyed by ``msg_id``."""

    messages: DataFrame
    hops: DataFrame
    anomalies: DataFrame
    urls: DataFrame
    factors: DataFrame
    risk: DataFrame
    attribution: DataFrame
    iocs: DataFrame
    signals: DataFrame  # msg_id, ai_signals: the nested record of lookalikes, links and model scores


def _with_auth(parsed: DataFrame, as_of: Column | None) -> DataFrame:
    top = parsed.withColumn("auth_header", F.get("authentication_results", F.lit(0)))
    verdicts = auth.parse(top, "auth_header").withColumnRenamed("source", "auth_source")
    return auth.dkim_expiry(verdicts, "dkim_signature", "date_parsed", as_of)


def generate(
    parsed: DataFrame,
    *,
    as_of: Column | None = None,
    cities: DataFrame | None = None,
    networks: DataFrame | None = None,
    domain_intel: DataFrame | None = None,
    brands: list[str] | None = None,
    model_folder: str = "",
    text_model_folder: str = "",
    keep: bool = False,
) -> Reports:
    """Reports of parsed messages (``sources.messages.parse``).

    Parsing is the costly step; write or checkpoint ``parsed`` before the call if more than one of the
    tables is wanted. ``keep`` writes what several tables are made of (verdicts, hops, anomalies, links,
    lookalikes, model scores) to the shared folder, so that each is worked out once. ``as_of`` stands for now where a message has no date; no rule reads the clock.
    """
    kept = (lambda df, name: materialize(df, name)) if keep else (lambda df, name: df)
    m = kept(_with_auth(parsed, as_of), "verdicts")
    hops = geo.enrich(relay.mark_bogons(relay.parse_hops(relay.chain(m.select("msg_id", "received"), "received"))), cities, networks)
    hops = kept(hops, "hops")
    odd = anomalies.detect(hops, m.select("msg_id", "dkim_signature_expired"))
    odd = kept(odd, "anomalies")
    links = urls.analyse(urls.body_links(m, "msg_id", "body", "is_html"))
    links = urls.domain_ages(links, "host", domain_intel, as_of) if domain_intel is not None else links.withColumn("is_newly_registered", F.lit(None).cast("boolean"))
    links = kept(links, "links")
    sender = m.select("msg_id", F.when(F.col("from_address").contains("@"), F.substring_index("from_address", "@", -1)).alias("domain")).where("domain <> ''")
    named = links.where("host is not null and not is_ip_literal").select("msg_id", F.col("ordinal").alias("url_ordinal"), F.col("host").alias("domain"))
    # every distinct domain is set against the brands once, whoever sent it or linked to it
    found = lookalike.matches(sender.select("domain").unionAll(named.select("domain")), "domain", brands)
    found = kept(found, "lookalikes")
    normal = lookalike.normal_domain(F.col("domain"))
    sent = sender.withColumn("domain", normal).join(found, "domain").withColumn("ordinal", F.col("position"))
    linked = named.withColumn("domain", normal).join(found, "domain").withColumn("ordinal", F.col("url_ordinal").cast("bigint") * MOST_BRANDS + F.col("position"))
    text = m.select("msg_id", F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"), F.coalesce("body", F.lit("")).alias("plain"))
    phishing, machine = models.phishing(text, "msg_id", "text", model_folder), models.machine_text(text, "msg_id", "plain", text_model_folder)
    phishing, machine = kept(phishing, "phishing"), kept(machine, "machine")
    factors = scoring.union(
        [
            scoring.auth_factors(m),
            scoring.anomaly_factors(odd),
            scoring.phishing_factors(phishing),
            scoring.lookalike_factors(sent, "sender"),
            scoring.url_factors(links),
            scoring.lookalike_factors(linked, "url"),
            scoring.ai_text_factors(machine),
        ]
    )
    factors = kept(factors, "factors")
    attached = m.select("msg_id", F.posexplode("attachments").alias("ordinal", "a")).select("msg_id", "ordinal", "a.*")
    return Reports(m, hops, odd, links, factors, scoring.risk(m, factors), attribution.attribute(m, hops, odd), iocs.extract(m, hops, attached, links), _signals(m, sender.withColumn("domain", normal), links, found, phishing, machine))


def _signals(m: DataFrame, sender: DataFrame, links: DataFrame, found: DataFrame, phishing: DataFrame, machine: DataFrame) -> DataFrame:
    match = F.struct("position", F.struct(F.col("brand").alias("matched_brand"), "method", "detail").alias("m"))
    by_domain = found.groupBy("domain").agg(F.first("is_punycode").alias("is_punycode"), F.first("decoded_unicode").alias("decoded_unicode"), F.array_sort(F.collect_list(match)).alias("ms"))
    like = by_domain.select("domain", F.struct("domain", "is_punycode", "decoded_unicode", F.transform("ms", lambda x: x["m"]).alias("matches")).alias("lookalike"))
    aged = F.struct(F.col("age_days")).alias("domain_intel") if "age_days" in links.columns else F.lit(None).cast("struct<age_days:int>").alias("domain_intel")
    shown = ["raw_url", "scheme", "host", "is_ip_literal", "anchor_text", "anchor_claimed_domain", "anchor_text_mismatch", "unwrapped_target", "is_newly_registered", aged, "lookalike"]
    named = links.withColumn("domain", F.when(~F.col("is_ip_literal"), lookalike.normal_domain(F.col("host")))).join(like, "domain", "left")
    urls_of = named.select("msg_id", F.struct("ordinal", F.struct(*shown).alias("u")).alias("x")).groupBy("msg_id").agg(F.struct(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["u"]).alias("urls")).alias("urls"))
    senders = sender.join(like, "domain").select("msg_id", F.col("lookalike").alias("sender_domain_lookalike"))
    scored = phishing.select("msg_id", F.struct(F.col("phishing_source").alias("source"), "phishing_probability", "label", "detail").alias("phishing"))
    read = machine.select("msg_id", F.struct(F.col("ai_text_source").alias("source"), "perplexity", "low_perplexity_flag", "detail").alias("ai_text"))
    wide = m.select("msg_id").join(senders, "msg_id", "left").join(urls_of, "msg_id", "left").join(scored, "msg_id", "left").join(read, "msg_id", "left")
    return wide.select("msg_id", F.struct("sender_domain_lookalike", "urls", "phishing", "ai_text").alias("ai_signals"))


def from_bytes(df: DataFrame, key: str = "filename", **settings) -> Reports:
    """Reports of (filename, content)."""
    return generate(messages.parse(df, key), **settings)


_META = "from_display_name from_address to_addresses subject date_raw date_parsed message_id return_path content_type has_attachments attachments parse_confidence issues source_format sha256".split()
HOP_COLUMNS = "sequence raw_header from_host from_ip by_host protocol timestamp_raw timestamp parse_confidence asn asn_org country city latitude longitude enrichment_source is_bogon".split()
ANALYSIS_COLUMNS = (
    "id filename sha256 source_format raw_bytes status status_detail parse_confidence from_display_name from_address subject message_date spf_result dkim_result "
    "dmarc_result dmarc_policy dkim_signature_expired risk_score verdict hop_count anomaly_count highest_anomaly_severity phishing_probability meta_json "
    "authentication_json sender_domain_intel_json ai_signals_json analyst_notes created_at"
).split()
_KEPT_ON_UPDATE = ("analyst_notes", "created_at")


def _json(*fields) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def analyses(reports: Reports, raw: DataFrame | None = None, created_at: Column | None = None) -> DataFrame:
    """The row that a store keeps of each message. ``raw``: msg_id and content of the messages, if they are to be kept."""
    hops = reports.hops.groupBy("msg_id").agg(F.count(F.lit(1)).cast("int").alias("hop_count"))
    odd = reports.anomalies.groupBy("msg_id").agg(F.count(F.lit(1)).cast("int").alias("anomaly_count"))
    worst = anomalies.highest_severity(reports.anomalies).withColumnRenamed("highest_severity", "highest_anomaly_severity")
    m = reports.messages
    verdict = lambda k: F.when(F.col(f"{k}_result").isNotNull(), F.struct(F.lit(k).alias("mechanism"), F.col(f"{k}_result").alias("result"), F.col(f"{k}_reason").alias("reason"), F.col(f"{k}_domain").alias("domain"), F.col(f"{k}_segment").alias("raw_segment"))).alias(k)
    names = F.transform("attachments", lambda a: a["filename"]).alias("attachment_names")
    flat = m.select(
        F.col("msg_id").alias("id"),
        "filename",
        "sha256",
        "source_format",
        F.lit("complete").alias("status"),
        F.lit(None).cast("string").alias("status_detail"),
        "parse_confidence",
        "from_display_name",
        "from_address",
        "subject",
        F.col("date_parsed").alias("message_date"),
        "spf_result",
        "dkim_result",
        "dmarc_result",
        "dmarc_policy",
        "dkim_signature_expired",
        _json(*_META, names).alias("meta_json"),
        _json(F.col("auth_source").alias("source"), *map(verdict, auth.MECHANISMS), F.col("auth_header").alias("raw_header"), "dkim_signature_present", "dkim_signature_expired", "dkim_expiry", "dmarc_policy").alias("authentication_json"),
        F.lit(None).cast("string").alias("sender_domain_intel_json"),
        F.lit(None).cast("string").alias("analyst_notes"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )
    joined = flat.join(reports.risk.select(F.col("msg_id").alias("id"), F.col("score").alias("risk_score"), "verdict"), "id")
    for part in (hops, odd, worst, reports.signals.select("msg_id", F.col("ai_signals.phishing.phishing_probability").alias("phishing_probability"), F.to_json("ai_signals").alias("ai_signals_json"))):
        joined = joined.join(part.withColumnRenamed("msg_id", "id"), "id", "left")
    if raw is None:
        joined = joined.withColumn("raw_bytes", F.lit(None).cast("binary"))
    else:
        joined = joined.join(raw.select(F.col("msg_id").alias("id"), F.col("content").alias("raw_bytes")), "id", "left")
    return joined.fillna(0, ["hop_count", "anomaly_count"]).select(*ANALYSIS_COLUMNS)


def stored_hops(reports: Reports) -> DataFrame:
    return reports.hops.select(F.concat_ws("-", "msg_id", F.col("sequence").cast("string")).alias("id"), F.col("msg_id").alias("analysis_id"), *HOP_COLUMNS)


def stored_anomalies(reports: Reports) -> DataFrame:
    return reports.anomalies.select(F.concat_ws("-", "msg_id", F.lpad(F.col("ordinal").cast("string"), 6, "0")).alias("id"), F.col("msg_id").alias("analysis_id"), "type", "severity", "hop_sequences", "summary", "evidence")


def whole_reports(reports: Reports, created_at: Column | None = None) -> DataFrame:
    """One row a message with all that its report holds, for ``operators.reports``."""
    rows = analyses(reports, None, created_at).select(F.col("id").alias("msg_id"), *report_forms.FLAT_FIELDS, *report_forms.RECORDS, "created_at")
    hops = stored_hops(reports).withColumnRenamed("analysis_id", "msg_id")
    return report_forms.assemble(rows, hops, reports.anomalies, reports.factors, reports.risk, reports.attribution, reports.iocs)


def _place(spark, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _replace(path: str, new: DataFrame, key: str, ids: DataFrame, buckets: int) -> None:
    """Make ``new`` the rows of the analyses ``ids`` in the table at ``path``; only their buckets are written anew."""
    spark = new.sparkSession
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    merged = new.withColumn("bucket", bucket(key))
    touched = [r[0] for r in ids.select(bucket("id")).distinct().collect()]  # as many as there are buckets, at most
    place, fs = _place(spark, path)
    if fs.exists(place):
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        kept = held.join(ids.select(F.col("id").alias(key)), key, "left_anti")
        if key == "id":  # what an analyst wrote and when the row came stay
            before = held.select("id", *[F.col(c).alias(f"_{c}") for c in _KEPT_ON_UPDATE])
            merged = merged.join(before, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in _KEPT_ON_UPDATE}).drop(*[f"_{c}" for c in _KEPT_ON_UPDATE])
        merged = merged.unionByName(kept)
    else:  # a file without rows, so that the table has its columns whatever is in it
        new.limit(0).write.parquet(f"{path}/bucket=-1")
    merged = materialize(merged, "store")  # before the files it was read from are replaced
    merged.repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    filled = {r[0] for r in merged.select("bucket").distinct().collect()}
    for empty in set(touched) - filled:  # their last rows are gone
        fs.delete(_place(spark, f"{path}/bucket={empty}")[0], True)


def save(reports: Reports, folder: str, *, raw: DataFrame | None = None, created_at: Column | None = None, buckets: int = 64) -> None:
    """Write the reports to the three stored tables in ``folder``; analyses stored before stay.

    An analysis that is already there is updated, its hops and anomalies are replaced, its notes and
    ``created_at`` stay. ``created_at`` is that of new ones, now unless given. Rows are kept in
    ``buckets`` folders by a hash of the analysis; those with nothing new aren't touched. The same number
    must be given each time. Children are written first, so an analysis that is there has them. One writer
    at a time.
    """
    rows = materialize(analyses(reports, raw, created_at), "analyses")
    ids = rows.select("id")
    _replace(f"{folder}/hops.parquet", stored_hops(reports), "analysis_id", ids, buckets)
    _replace(f"{folder}/anomalies.parquet", stored_anomalies(reports), "analysis_id", ids, buckets)
    _replace(f"{folder}/analyses.parquet", rows, "id", ids, buckets)
