"""Queries over stored analyses: pages, totals, breakdowns, details, and what a viewer derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = ("status", "spf_result", "dkim_result", "dmarc_result")


def filtered(analyses: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that equal every filter given; a filter of None is none."""
    for column, value in equal.items():
        if column not in FILTERS:
            raise ValueError(f"no filter on {column}")
        if value is not None:
            analyses = analyses.where(F.col(column) == value)
    return analyses


def page(analyses: DataFrame, columns: list[str], *, limit: int = 25, offset: int = 0, **equal: str | None) -> DataFrame:
    """A page of the newest rows; ids break ties. Only ``columns`` are read."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return filtered(analyses, **equal).select(*columns).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def total(analyses: DataFrame, **equal: str | None) -> DataFrame:
    """The number of rows behind a page."""
    return filtered(analyses, **equal).agg(F.count(F.lit(1)).alias("total"))


def breakdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, key, n of each column, in one pass; null keys are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("key")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).where("p.key is not null").groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("n"))


def since(analyses: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows created in the last hours before ``as_of``, that instant included."""
    return analyses.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))).agg(F.count(F.lit(1)).alias("n"))


def top_anomaly_types(anomalies: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent types, names breaking ties, underscores as spaces."""
    counted = anomalies.where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "type").limit(most).select(F.regexp_replace("type", "_", " ").alias("type"), "n")


def auth_failures(analyses: DataFrame) -> DataFrame:
    """How many analyses failed SPF, DKIM and DMARC."""
    return analyses.agg(*[F.count_if(F.coalesce(F.col(f"{m}_result") == "fail", F.lit(False))).alias(f"{m}_fail") for m in ("spf", "dkim", "dmarc")])


def details(analyses: DataFrame, hops: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Each analysis (id and its columns) with its hops in order and its anomalies in order of their ids."""
    h = hops.groupBy(F.col("analysis_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sequence", "from_host", "from_ip", "by_host"))).alias("hops"))
    a = anomalies.groupBy(F.col("analysis_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("anomaly_id"), "type", "severity"))).alias("anomalies"))
    return analyses.join(h, "id", "left").join(a, "id", "left")


def anomalous_hops(anomalies: DataFrame) -> DataFrame:
    """Hops that some anomaly names: analysis_id, sequence."""
    return anomalies.select("analysis_id", F.explode("hop_sequences").alias("sequence")).distinct()


def geo_segments(hops: DataFrame) -> DataFrame:
    """Neighbouring hops with coordinates; hops without are skipped."""
    placed = hops.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    order = Window.partitionBy("analysis_id").orderBy("sequence")
    before = {f"from_{c}": F.lag(c).over(order) for c in ("sequence", "latitude", "longitude")}
    return placed.withColumns(before).where("from_sequence is not null").select("analysis_id", "from_sequence", F.col("sequence").alias("to_sequence"), "from_latitude", "from_longitude", "latitude", "longitude")


def map_projection(hops: DataFrame, width: float = 500.0, height: float = 160.0, margin: float = 5.0) -> DataFrame:
    """Hops with coordinates on a map that spans their chain, with a margin in degrees."""
    chain = Window.partitionBy("analysis_id")
    low = lambda c: F.min(c).over(chain) - margin
    high = lambda c: F.max(c).over(chain) + margin
    placed = hops.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    x = (F.col("longitude") - low("longitude")) / (high("longitude") - low("longitude")) * width
    y = (F.col("latitude") - low("latitude")) / (high("latitude") - low("latitude")) * height
    return placed.select("analysis_id", "sequence", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def flagged_urls(urls: DataFrame) -> DataFrame:
    """Links with a bare address, a wrong anchor text, a redirect or a lookalike."""
    return urls.where(F.coalesce("is_ip_literal", F.lit(False)) | F.coalesce("anchor_text_mismatch", F.lit(False)) | F.col("unwrapped_target").isNotNull() | F.coalesce("has_lookalike", F.lit(False)))


def header_blocks(df: DataFrame, raw: str) -> DataFrame:
    """One row per header of a raw header section, folded lines together: the other columns, ``position``, ``block``."""
    rest = [c for c in df.columns if c != raw]
    section = F.regexp_replace(F.regexp_extract(F.col(raw), r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1), r"\r\n", "\n")
    # a line break that no blank follows begins a block
    blocks = F.filter(F.split(section, r"\n(?=[^\s])"), lambda b: F.trim(b) != "")
    return df.select(*rest, F.posexplode(blocks).alias("position", "block"))


def suspicious_headers(blocks: DataFrame, hops: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Header blocks (msg_id, position, block) with suspicious and reason.

    ``hops``: msg_id, raw_header of hops that an anomaly names. ``verdicts``: msg_id, auth_failed, dkim_signature_expired.
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    named = hops.groupBy("msg_id").agg(F.collect_set(flat(F.col("raw_header"))).alias("named"))
    joined = blocks.join(named, "msg_id", "left").join(verdicts, "msg_id", "left").withColumn("flat", flat(F.col("block")))
    kind = F.lower(F.substring_index("block", ":", 1))
    hit = F.exists(F.coalesce("named", F.array().cast("array<string>")), lambda h: F.col("flat").contains(h) | h.contains(F.col("flat")))
    reason = (
        F.when((kind == "received") & hit, "Hop flagged by relay-chain analysis")
        .when((kind == "authentication-results") & F.coalesce("auth_failed", F.lit(False)), "SPF, DKIM, or DMARC failed")
        .when((kind == "dkim-signature") & F.coalesce("dkim_signature_expired", F.lit(False)), "DKIM signature expired")
    )
    return joined.select("msg_id", "position", "block", reason.isNotNull().alias("suspicious"), reason.alias("reason"))
