"""Explainable risk: every point is a factor with its weight and evidence.

Factors are (msg_id, part, ordinal, name, weight, evidence, category); (part, ordinal) is the order in
which they are found. Weights are looked up in literal maps, so no join is needed. A message without
factors scores 0. Null verdicts, severities and probabilities give no factor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.config import (
    ANCHOR_MISMATCH_WEIGHT,
    IP_LITERAL_WEIGHT,
    LOW_PERPLEXITY_WEIGHT,
    MALICIOUS_FROM,
    MOST_BRANDS,
    NEW_DOMAIN_WEIGHT,
    PHISHING_THRESHOLD,
    PHISHING_WEIGHT,
    PUNYCODE_BONUS,
    SUSPICIOUS_FROM,
    WEIGHTS,
)
from relayscope.operators.urls import host_of


def weight_of(group: str, key: Column, default: int | None = None) -> Column:
    table = F.create_map(*[x for k, v in WEIGHTS[group].items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def _factor(part: int, ordinal: Column, name: Column, weight: Column, evidence: Column, category: str) -> Column:
    return F.struct(F.lit(part).alias("part"), ordinal.cast("bigint").alias("ordinal"), name.alias("name"), weight.cast("int").alias("weight"), evidence.cast("string").alias("evidence"), F.lit(category).alias("category"))


def _emit(df: DataFrame, factors: Column) -> DataFrame:
    """One row for each factor of a row's array that is there and weighs something; the rows are read once."""
    kept = F.filter(factors, lambda f: f.isNotNull() & (f["weight"] != 0))
    return df.select("msg_id", F.explode(kept).alias("f")).select("msg_id", "f.*")


def auth_factors(messages: DataFrame) -> DataFrame:
    """Of (msg_id, spf_result, dkim_result, dmarc_result, dmarc_policy, and *_segment as evidence if there)."""
    shown = lambda m: F.col(f"{m}_segment") if f"{m}_segment" in messages.columns else F.concat(F.lit(f"{m}="), F.col(f"{m}_result"))
    zero = F.lit(0)
    spf = _factor(0, zero, F.concat(F.lit("SPF "), F.col("spf_result")), weight_of("spf", F.col("spf_result")), shown("spf"), "authentication")
    dkim = _factor(1, zero, F.concat(F.lit("DKIM "), F.col("dkim_result")), weight_of("dkim", F.col("dkim_result")), shown("dkim"), "authentication")
    policy = weight_of("dmarc_fail", F.col("dmarc_policy"), WEIGHTS["dmarc_fail"]["unknown"])
    dmarc = _factor(2, zero, F.concat(F.lit("DMARC fail (policy="), F.coalesce("dmarc_policy", F.lit("unknown")), F.lit(")")), F.when(F.col("dmarc_result") == "fail", policy), shown("dmarc"), "authentication")
    return _emit(messages, F.array(spf, dkim, dmarc))


def anomaly_factors(anomalies: DataFrame) -> DataFrame:
    """Of (msg_id, ordinal, severity, summary, evidence)."""
    return _emit(anomalies, F.array(_factor(3, F.col("ordinal"), F.col("summary"), weight_of("severity", F.col("severity")), F.col("evidence"), "relay_chain")))


# fixed values: names and evidence of the factors


def _phishing(source: Column, probability: Column) -> Column:
    evidence = F.concat(F.lit("model-estimated phishing probability "), F.bround(probability * 100, 0).cast("int").cast("string"), F.lit("%"))
    fires = (source == "onnx-model") & (probability >= PHISHING_THRESHOLD)
    return _factor(4, F.lit(0), F.lit("Phishing classifier flagged this message"), F.when(fires, PHISHING_WEIGHT), evidence, "phishing_classifier")


def _ai_text(source: Column, flag: Column) -> Column:
    return _factor(8, F.lit(0), F.lit("Email body reads as unusually predictable to a reference language model"), F.when((source == "onnx-model") & flag, LOW_PERPLEXITY_WEIGHT), F.lit("a weak, informational signal only"), "ai_text")


def _quoted(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("None"))


def _url(ordinal: Column, raw_url: Column, host: Column, literal: Column, mismatch: Column, claimed: Column, new: Column, age: Column) -> Column:
    at = ordinal * 3
    said = F.concat(F.lit("anchor text claims "), _quoted(claimed), F.lit(", actual destination is "), _quoted(host), F.lit(" ("), raw_url, F.lit(")"))
    since = F.concat(F.coalesce(host, F.lit("None")), F.lit(" registered "), F.coalesce(age.cast("string"), F.lit("?")), F.lit(" days ago"))
    return F.array(
        _factor(6, at, F.lit("Link uses a bare IP address instead of a domain"), F.when(literal, IP_LITERAL_WEIGHT), raw_url, "url_analysis"),
        _factor(6, at + 1, F.lit("Link text claims a different domain than its destination"), F.when(mismatch, ANCHOR_MISMATCH_WEIGHT), said, "url_analysis"),
        _factor(6, at + 2, F.lit("Link points to a newly registered domain"), F.when(new, NEW_DOMAIN_WEIGHT), since, "url_analysis"),
    )


def phishing_factors(signals: DataFrame) -> DataFrame:
    """Of (msg_id, phishing_source, phishing_probability)."""
    return _emit(signals, F.array(_phishing(F.col("phishing_source"), F.col("phishing_probability"))))


def ai_text_factors(signals: DataFrame) -> DataFrame:
    """Of (msg_id, ai_text_source, low_perplexity_flag)."""
    return _emit(signals, F.array(_ai_text(F.col("ai_text_source"), F.col("low_perplexity_flag"))))


def lookalike_factors(found: DataFrame, where: str) -> DataFrame:
    """Of (msg_id, ordinal, domain, is_punycode, brand, method, detail); ``where``: sender or url.

    ``ordinal`` orders the matches of a message; those of one domain stand together.
    """
    part, group = (5, "sender_lookalike") if where == "sender" else (7, "url_lookalike")
    context = F.lit("Sender address") if where == "sender" else F.concat(F.lit("Link to "), F.col("domain"))
    plain = _emit(found, F.array(_factor(part, F.col("ordinal") * 2, F.concat(context, F.lit(" looks like "), F.col("brand")), weight_of(group, F.col("method")), F.col("detail"), "lookalike_domain")))
    group_of = ["msg_id", "domain"] if where == "sender" else ["msg_id", "domain", "url_ordinal"]
    coded = found.where("is_punycode").groupBy(*group_of).agg(F.max("ordinal").alias("ordinal"))
    bonus = _emit(coded, F.array(_factor(part, F.col("ordinal") * 2 + 1, F.concat(context, F.lit(" uses punycode/IDN encoding")), F.lit(PUNYCODE_BONUS), F.col("domain"), "lookalike_domain")))
    return plain.unionAll(bonus)


def url_factors(urls: DataFrame) -> DataFrame:
    """Of (msg_id, ordinal, raw_url, host, is_ip_literal, anchor_text_mismatch, is_newly_registered, and anchor_claimed_domain and age_days if there)."""
    there = lambda c, kind: F.col(c) if c in urls.columns else F.lit(None).cast(kind)
    return _emit(urls, _url(F.col("ordinal"), F.col("raw_url"), F.col("host"), F.col("is_ip_literal"), F.col("anchor_text_mismatch"), there("anchor_claimed_domain", "string"), F.col("is_newly_registered"), there("age_days", "int")))


def signal_factors(signals: DataFrame) -> DataFrame:
    """Of (msg_id, s), the stored signals in nested form: all their factors in one pass over the record.

    ``s``: sender_domain_lookalike (domain, is_punycode, matches), urls.urls (each with a lookalike of the
    same form), phishing, ai_text.
    """
    sender = F.col("s.sender_domain_lookalike")
    matches = F.coalesce(sender["matches"], F.array().cast("array<struct<matched_brand:string,method:string,detail:string>>"))
    looks = F.transform(matches, lambda m, i: _factor(5, i * 2, F.concat(F.lit("Sender address looks like "), m["matched_brand"]), weight_of("sender_lookalike", m["method"]), m["detail"], "lookalike_domain"))
    bonus = _factor(5, F.size(matches) * 2, F.lit("Sender address uses punycode/IDN encoding"), F.when(sender["is_punycode"] & (F.size(matches) > 0), PUNYCODE_BONUS), sender["domain"], "lookalike_domain")
    none = F.filter(F.array(bonus), lambda f: F.lit(False))

    def link(u: Column, i: Column) -> Column:
        host = F.coalesce(u["host"], host_of(u["raw_url"]))
        own = _url(i, u["raw_url"], host, u["is_ip_literal"], u["anchor_text_mismatch"], u["anchor_claimed_domain"], u["is_newly_registered"], u["domain_intel"]["age_days"])
        like, context = u["lookalike"], F.concat(F.lit("Link to "), host)
        found = F.coalesce(like["matches"], F.array().cast("array<struct<matched_brand:string,method:string,detail:string>>"))
        at = i.cast("bigint") * 2 * (MOST_BRANDS + 1)
        seen = F.transform(found, lambda m, k: _factor(7, at + k * 2, F.concat(context, F.lit(" looks like "), m["matched_brand"]), weight_of("url_lookalike", m["method"]), m["detail"], "lookalike_domain"))
        coded = _factor(7, at + F.size(found) * 2, F.concat(context, F.lit(" uses punycode/IDN encoding")), F.when(like["is_punycode"] & (F.size(found) > 0), PUNYCODE_BONUS), like["domain"], "lookalike_domain")
        return F.concat(own, seen, F.array(coded))

    links = F.flatten(F.transform(F.col("s.urls.urls"), link))
    alone = F.array(_phishing(F.col("s.phishing.source"), F.col("s.phishing.phishing_probability")), bonus, _ai_text(F.col("s.ai_text.source"), F.col("s.ai_text.low_perplexity_flag")))
    return _emit(signals, F.concat(alone, looks, F.coalesce(links, none)))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ranked(factors: DataFrame) -> DataFrame:
    """Factors with ``rank``: heaviest first, equal weights in the order found."""
    order = Window.partitionBy("msg_id").orderBy(F.desc("weight"), "part", "ordinal", "name")
    return factors.withColumn("rank", F.row_number().over(order))


def verdict_of(score: Column) -> Column:
    return F.when(score >= MALICIOUS_FROM, "malicious").when(score >= SUSPICIOUS_FROM, "suspicious").otherwise("clean")


def risk(messages: DataFrame, factors: DataFrame) -> DataFrame:
    """msg_id, score (0 to 100), verdict, factors. Messages join the sum as rows of weight nothing: one shuffle, no join."""
    rows = factors.select("msg_id", "weight").unionAll(messages.select("msg_id", F.lit(None).cast("int").alias("weight")))
    summed = rows.groupBy("msg_id").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"), F.count("weight").alias("factors"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("total"))).cast("int")
    return summed.select("msg_id", score.alias("score"), verdict_of(score).alias("verdict"), "factors")
