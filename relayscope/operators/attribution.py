"""Where a message comes from, as far as its chain tells, with the reasons.

The earliest hop with a public address is the candidate. An anomaly that speaks of forgery at that hop
or before it caps the confidence at ``low``. Messages without a candidate have source ``unavailable``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.config import FORGERY_TYPES


def candidates(hops: DataFrame) -> DataFrame:
    """The earliest public hop of each message."""
    columns = ["sequence", "from_ip", "from_host", "enrichment_source", "asn", "asn_org", "country"]
    have = [c for c in columns if c in hops.columns]
    public = hops.where((F.col("from_ip") != "") & ~F.col("is_bogon"))
    return public.groupBy("msg_id").agg(F.min_by(F.struct(*have), "sequence").alias("c")).select("msg_id", "c.*")


def attribute(messages: DataFrame, hops: DataFrame, anomalies: DataFrame) -> DataFrame:
    """msg_id, source, origin_ip, origin_hop_sequence, asn, asn_org, country, confidence, reasoning.

    ``messages``: msg_id, spf_result. Anomalies are reduced to one row a message before they are joined.
    """
    forged = (
        anomalies.where(F.col("type").isin(*FORGERY_TYPES) & (F.size("hop_sequences") > 0))
        .groupBy("msg_id")
        .agg(F.collect_list(F.struct(F.array_min("hop_sequences").alias("seq"), "type")).alias("forged"))
    )
    joined = messages.select("msg_id", "spf_result").join(candidates(hops), "msg_id", "left").join(forged, "msg_id", "left")
    near = F.filter(F.coalesce("forged", F.array().cast("array<struct<seq:int,type:string>>")), lambda f: f["seq"] <= F.col("sequence"))
    held = joined.withColumn("near", near).withColumn("there", F.col("sequence").isNotNull())
    enriched = F.col("enrichment_source") == "geolite2-local"
    n = F.size("near")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("near", lambda f: f["type"]))), ", ")
    # fixed values: the sentences of the reasoning
    text = F.concat_ws(
        " ",
        F.concat(F.lit("earliest hop reporting a public source IP is hop #"), F.col("sequence").cast("string"), F.lit(" ("), F.col("from_ip"), F.lit(", claimed sending host "), F.coalesce("from_host", F.lit("unknown")), F.lit(").")),
        F.when(enriched, F.concat(F.lit("GeoIP enrichment attributes this address to "), F.coalesce("asn_org", F.lit("an unnamed organization")), F.lit(" (AS"), F.coalesce(F.col("asn").cast("string"), F.lit("?")), F.lit("), "), F.coalesce("country", F.lit("unknown country")), F.lit("."))).otherwise("no GeoIP enrichment is available for this address."),
        F.when(n > 0, F.concat(F.lit("confidence is capped at 'low': "), n.cast("string"), F.when(n == 1, " relay-chain anomaly (").otherwise(" relay-chain anomalies ("), kinds, F.when(n == 1, ") affects").otherwise(") affect"), F.lit(" this hop or an earlier one."))),
        F.when(F.col("spf_result") == "fail", "SPF failed for the claimed sending domain.").when(F.col("spf_result") == "pass", "SPF passed, corroborating that this hop's IP is an authorized sender for the claimed domain."),
    )
    return held.select(
        "msg_id",
        F.when(F.col("there"), "heuristic").otherwise("unavailable").alias("source"),
        F.col("from_ip").alias("origin_ip"),
        F.col("sequence").alias("origin_hop_sequence"),
        "asn",
        "asn_org",
        "country",
        F.when(~F.col("there"), "unknown").when(n > 0, "low").when(enriched, "high").otherwise("medium").alias("confidence"),
        F.when(F.col("there"), text).otherwise("no hop in the reconstructed relay chain reports a public, non-bogon source IP").alias("reasoning"),
    )
