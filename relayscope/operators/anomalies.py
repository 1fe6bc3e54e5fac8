"""Anomalies of relay chains, one rule each.

Every rule takes hops (``msg_id``, ``sequence`` and the columns it reads) and gives (msg_id, type,
severity, hop_sequences, summary, evidence) and ``rule``, the place of the rule in the order of
reporting. Null hosts, addresses and times never fire a rule that compares them, but for the bogon rule,
which a missing host doesn't excuse. Empty chains have no anomalies.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.config import EARLIEST_YEAR, LARGE_GAP_SECONDS, MAX_HOPS, SEVERITY_RANK
from relayscope.functions.net import is_bogon, organisation_domain, plain_host

def _iso(ts: Column) -> Column:
    """UTC, whatever the session's zone is."""
    return F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def _said(fires: Column, rule: int, kind: str, severity: str, sequences: Column, summary: Column, evidence: Column) -> Column:
    """What a rule says of a row, null where it doesn't fire."""
    return F.when(fires, F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), sequences.cast("array<int>").alias("hop_sequences"), summary.alias("summary"), evidence.alias("evidence")))


def _emit(rows: DataFrame, said: list[Column]) -> DataFrame:
    """One row for each rule that fires; all rules read the same rows."""
    return rows.select("msg_id", F.explode(F.filter(F.array(*said), lambda a: a.isNotNull())).alias("a")).select("msg_id", "a.*")


def _beside(hops: DataFrame, *columns: str) -> DataFrame:
    """Each hop with ``columns`` of the hop before it; plain lag, missing values included."""
    order = Window.partitionBy("msg_id").orderBy("sequence")
    return hops.withColumns({f"prev_{c}": F.lag(c).over(order) for c in ("sequence", *columns)})


def _delta() -> Column:
    return (F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")) / 1_000_000


# fixed values: what summaries and evidence of the rules say


def _impossible(before: int) -> Column:
    first = int(datetime(before, 1, 1, tzinfo=UTC).timestamp())
    return _said(F.unix_seconds("timestamp") < first, 1, "impossible_timestamp", "medium", F.array("sequence"), F.concat(F.lit("Hop "), _s("sequence"), F.lit(" timestamp predates the internet email era")), F.concat(F.lit("Received timestamp parses to "), _iso(F.col("timestamp"))))


def _negative() -> Column:
    summary = F.concat(F.lit("Hop "), _s("sequence"), F.lit(" is timestamped before hop "), _s("prev_sequence"), F.lit(", which received it earlier in the chain"))
    evidence = F.format_string("hop %d at %s -> hop %d at %s, delta %ds", "prev_sequence", _iso(F.col("prev_timestamp")), "sequence", _iso(F.col("timestamp")), F.bround(_delta(), 0).cast("bigint"))
    return _said(_delta() < 0, 2, "negative_time_delta", "high", F.array("prev_sequence", "sequence"), summary, evidence)


def _gap(seconds: int) -> Column:
    summary = F.concat(F.lit("Large "), F.bround(_delta() / 3600, 1).cast("decimal(18,1)").cast("string"), F.lit("h gap between hop "), _s("prev_sequence"), F.lit(" and "), _s("sequence"))
    evidence = F.format_string("hop %d at %s -> hop %d at %s", "prev_sequence", _iso(F.col("prev_timestamp")), "sequence", _iso(F.col("timestamp")))
    return _said(_delta() > seconds, 2, "large_timezone_jump", "low", F.array("prev_sequence", "sequence"), summary, evidence)


def _bogon() -> Column:
    same = F.coalesce(organisation_domain(F.col("from_host")) == organisation_domain(F.col("by_host")), F.lit(False))
    shown = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c), F.lit("'")), F.lit("None"))
    evidence = F.concat(F.lit("hop "), _s("sequence"), F.lit(" from "), shown("from_host"), F.lit(" reports source IP "), F.col("from_ip"), F.lit(" (by "), shown("by_host"), F.lit(")"))
    return _said(F.col("_bogon") & ~same, 3, "bogon_ip_in_path", "high", F.array("sequence"), F.concat(F.lit("Hop "), _s("sequence"), F.lit(" claims a private/non-routable sending address")), evidence)


def _long(most: int) -> Column:
    return _said(F.col("_first") & (F.col("_n") > most), 4, "hop_count_outlier", "low", F.sequence(F.lit(0), F.col("_n") - 1), F.concat(F.lit("Unusually long relay chain: "), _s("_n"), F.lit(" hops")), F.concat(_s("_n"), F.lit(f" Received headers exceeds the {most}-hop baseline")))


def _duplicate() -> Column:
    n = F.size("_at").cast("string")
    summary = F.concat(F.lit("Same recipient host '"), F.col("_host"), F.lit("' claimed by "), n, F.lit(" separate hops"))
    evidence = F.concat(F.lit("hops ["), F.array_join(F.col("_at").cast("array<string>"), ", "), F.lit("] all name '"), F.col("_host"), F.lit("' as the receiving server"))
    return _said((F.col("_host") != "") & (F.size("_at") > 1) & (F.get("_at", F.lit(0)) == F.col("sequence")), 5, "forged_internal_origin", "medium", F.col("_at"), summary, evidence)


def _break() -> Column:
    fires = (F.col("prev_by_host") != "") & (F.col("from_host") != "") & (plain_host(F.col("prev_by_host")) != plain_host(F.col("from_host")))
    summary = F.concat(F.lit("Relay chain break between hop "), _s("prev_sequence"), F.lit(" and hop "), _s("sequence"))
    evidence = F.concat(F.lit("hop "), _s("prev_sequence"), F.lit(" was received 'by "), F.col("prev_by_host"), F.lit("', but hop "), _s("sequence"), F.lit(" claims to be 'from "), F.col("from_host"), F.lit("'"))
    return _said(fires, 6, "forged_internal_origin", "medium", F.array("prev_sequence", "sequence"), summary, evidence)


def _counted(hops: DataFrame) -> DataFrame:
    chain = Window.partitionBy("msg_id")
    return hops.withColumn("_n", F.count(F.lit(1)).over(chain).cast("int")).withColumn("_first", F.col("sequence") == F.min("sequence").over(chain))


def _received(hops: DataFrame) -> DataFrame:
    host = Window.partitionBy("msg_id", "_host")
    return hops.withColumn("_host", plain_host(F.col("by_host"))).withColumn("_at", F.array_sort(F.collect_list("sequence").over(host)))


def impossible_timestamp(hops: DataFrame, before: int = EARLIEST_YEAR) -> DataFrame:
    """Times before the year ``before``."""
    return _emit(hops, [_impossible(before)])


def negative_delta(hops: DataFrame) -> DataFrame:
    """A hop stamped before the one that handed the message to it."""
    return _emit(_beside(hops, "timestamp"), [_negative()])


def large_gap(hops: DataFrame, seconds: int = LARGE_GAP_SECONDS) -> DataFrame:
    """More than ``seconds`` between neighbours."""
    return _emit(_beside(hops, "timestamp"), [_gap(seconds)])


def bogon_in_path(hops: DataFrame, ipv6: bool = True) -> DataFrame:
    """A sending address that isn't public on a hop that isn't known to stay in one organisation."""
    return _emit(hops.withColumn("_bogon", is_bogon(F.col("from_ip"), ipv6)), [_bogon()])


def hop_count_outlier(hops: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """Chains of more than ``most`` hops."""
    return _emit(_counted(hops), [_long(most)])


def duplicate_receiver(hops: DataFrame) -> DataFrame:
    """One receiving host named by several hops of a chain."""
    return _emit(_received(hops), [_duplicate()])


def chain_break(hops: DataFrame) -> DataFrame:
    """A hop that doesn't come from the host that received it last."""
    return _emit(_beside(hops, "by_host"), [_break()])


def dkim_expired(messages: DataFrame) -> DataFrame:
    """Messages (msg_id, dkim_signature_expired) whose signature had expired."""
    said = _said(F.col("dkim_signature_expired"), 7, "dkim_signature_expired", "medium", F.array().cast("array<int>"), F.lit("DKIM signature is expired"), F.lit("signature expiration tag is in the past relative to the message Date"))
    return _emit(messages, [said])


def detect(hops: DataFrame, messages: DataFrame | None = None, ipv6: bool = True) -> DataFrame:
    """All rules; with ``ordinal``, the place of the anomaly in its message's report.

    One pass: every window is over the message, so hops are read and shuffled once.
    """
    rows = _received(_counted(_beside(hops.withColumn("_bogon", is_bogon(F.col("from_ip"), ipv6)), "timestamp", "by_host")))
    every = _emit(rows, [_impossible(EARLIEST_YEAR), _negative(), _gap(LARGE_GAP_SECONDS), _bogon(), _long(MAX_HOPS), _duplicate(), _break()])
    if messages is not None:
        every = every.unionByName(dkim_expired(messages))
    order = Window.partitionBy("msg_id").orderBy("rule", F.get("hop_sequences", F.lit(0)), "type", "summary")
    return every.withColumn("ordinal", F.row_number().over(order) - 1)


def highest_severity(anomalies: DataFrame, message: str = "msg_id") -> DataFrame:
    """The highest severity of each message."""
    rank = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    return anomalies.groupBy(message).agg(F.max_by("severity", F.try_element_at(rank, F.col("severity"))).alias("highest_severity"))
