"""Queries of the forensic operators over the stored tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.config import BOGON_V4, CONFUSABLE_FROM, CONFUSABLE_TO, DOCUMENTATION_V4, TRUSTED_BRANDS, WEIGHTS
from relayscope.functions.messages import record_text
from relayscope.functions.net import cidr_bounds, is_bogon, is_ip, organisation_domain
from relayscope.operators import anomalies as rules
from relayscope.operators import attribution, auth, dataprep, exports, geo, iocs, lookalike, models, relay, reports, scoring, store, urls
from relayscope.plans.records import elements, whole_record
from relayscope.sources import messages as raw
from relayscope.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- shared projections -------------------------------------------------------------------------------------

_HEADER = """concat('mx.local; spf=', CASE o_orderkey % 6 WHEN 0 THEN 'fail' WHEN 1 THEN 'softfail' WHEN 2 THEN 'neutral' WHEN 3 THEN 'none' WHEN 4 THEN 'bogus' ELSE 'pass' END,
 ' (c', CAST(o_custkey AS STRING), ') smtp.mailfrom=u', CAST(o_custkey AS STRING), '@d', CAST(o_custkey % 97 AS STRING), '.test; dkim=',
 CASE o_orderkey % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' ELSE 'pass' END, ' header.d=d', CAST(o_custkey % 97 AS STRING), '.test; dmarc=',
 CASE o_orderkey % 3 WHEN 0 THEN 'fail' ELSE 'pass' END, ' (policy=', CASE o_orderkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'none' ELSE 'other' END,
 ') header.from=d', CAST(o_custkey % 97 AS STRING), '.test')"""
_DOMAIN = "CASE c_custkey % 8 WHEN 0 THEN 'paypai.com' WHEN 1 THEN 'micr0soft-online.com' WHEN 2 THEN 'g00gle.com' WHEN 3 THEN 'netfilx.com' WHEN 4 THEN 'paypal-secure-login.com' WHEN 5 THEN 'github.com' WHEN 6 THEN concat('d', CAST(c_custkey AS STRING), '.test') ELSE 'wellsfargoo-bank.net' END"
_BRANDS = "(VALUES " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(TRUSTED_BRANDS)) + ") AS b(position, brand)"


def _rec(column: str) -> str:
    """SQL for a record's JSON, unpacked if it is stored as a JSON string."""
    return f"(CASE WHEN json_valid({column}) THEN CASE WHEN json_type({column}) = 'VARCHAR' THEN json_extract_string({column}, '$') ELSE {column} END END)"


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr("CAST(o_orderkey AS STRING) AS msg_id", f"{_HEADER} AS header")


def _domains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(f"{_DOMAIN} AS domain")


def _hops(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each stored hop once, keyed by msg_id and partitioned by it."""
    kept = dict.fromkeys(["id", "sequence", *columns])
    hops = table(spark, folder, "hops").select(F.col("analysis_id").alias("msg_id"), *kept)
    return relay.unique_hops(hops, "msg_id", "id")


_UNIQUE = "(SELECT DISTINCT ON (id) *, analysis_id AS msg_id FROM hops ORDER BY id)"


def _anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "anomalies").select(F.col("analysis_id").alias("msg_id"), F.col("id").alias("anomaly_id"), "type", "severity", "hop_sequences", "summary", "evidence")


_SIGNALS = (
    "sender_domain_lookalike struct<domain:string,is_punycode:boolean,matches:array<struct<matched_brand:string,method:string,detail:string>>>, "
    "urls struct<urls:array<struct<raw_url:string,scheme:string,host:string,is_ip_literal:boolean,anchor_text:string,anchor_claimed_domain:string,anchor_text_mismatch:boolean,unwrapped_target:string,is_newly_registered:boolean,"
    "domain_intel:struct<age_days:int>,lookalike:struct<domain:string,is_punycode:boolean,matches:array<struct<matched_brand:string,method:string,detail:string>>>>>>, "
    "phishing struct<source:string,phishing_probability:double>, ai_text struct<source:string,low_perplexity_flag:boolean>"
)


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    analyses = table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), "ai_signals_json")
    return analyses.select("msg_id", F.from_json(record_text(F.col("ai_signals_json")), _SIGNALS).alias("s"))


def _stored_urls(spark: SparkSession, folder: str) -> DataFrame:
    held = _signals(spark, folder).select("msg_id", F.posexplode("s.urls.urls").alias("ordinal", "u"))
    return held.select("msg_id", "ordinal", "u.raw_url", F.coalesce("u.host", urls.host_of(F.col("u.raw_url"))).alias("host"), F.coalesce("u.is_ip_literal", F.lit(False)).alias("is_ip_literal"), F.coalesce("u.anchor_text_mismatch", F.lit(False)).alias("anchor_text_mismatch"), "u.unwrapped_target", "u.is_newly_registered")


_LINKS = "'$.urls.urls[' || CAST(i AS VARCHAR) || ']"
_URLS_SQL = f"""SELECT msg_id, i AS ordinal, json_extract_string(s, {_LINKS}.raw_url') AS raw_url, coalesce(CAST(json_extract_string(s, {_LINKS}.is_ip_literal') AS BOOLEAN), false) AS is_ip_literal,
 coalesce(CAST(json_extract_string(s, {_LINKS}.anchor_text_mismatch') AS BOOLEAN), false) AS mismatch, coalesce(CAST(json_extract_string(s, {_LINKS}.is_newly_registered') AS BOOLEAN), false) AS is_new, json_extract(s, {_LINKS}.lookalike') AS lookalike
FROM (SELECT id AS msg_id, s, unnest(range(CAST(coalesce(json_array_length(s, '$.urls.urls'), 0) AS BIGINT))) AS i FROM (SELECT id, {_rec('ai_signals_json')} AS s FROM analyses))"""

# --- authentication -------------------------------------------------------------------------------------------

_SEGMENT = "list_filter(list_transform(string_split(trim(regexp_replace(header, '\\s+', ' ', 'g')), ';'), lambda s: trim(s)), lambda s: regexp_extract(s, '\\b(spf|dkim|dmarc)\\s*=\\s*([a-zA-Z]+)', 1) = '{m}')[1]"
_AUTH_SQL = f"""
WITH h AS (SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, {_HEADER} AS header FROM orders),
s AS (SELECT msg_id, {_SEGMENT.format(m='spf')} AS spf, {_SEGMENT.format(m='dkim')} AS dkim, {_SEGMENT.format(m='dmarc')} AS dmarc FROM h),
r AS (SELECT *, lower(regexp_extract(spf, '=\\s*([a-zA-Z]+)', 1)) AS a, lower(regexp_extract(dkim, '=\\s*([a-zA-Z]+)', 1)) AS b, lower(regexp_extract(dmarc, '=\\s*([a-zA-Z]+)', 1)) AS c, lower(regexp_extract(dmarc, '\\b(?:policy|p)=([a-zA-Z]+)', 1)) AS p FROM s),
v AS (SELECT msg_id, spf, dkim, dmarc,
 CASE WHEN a IN ('pass','fail','softfail','neutral','none','temperror','permerror','policy') THEN a ELSE 'unknown' END AS spf_result,
 CASE WHEN b IN ('pass','fail','softfail','neutral','none','temperror','permerror','policy') THEN b ELSE 'unknown' END AS dkim_result,
 CASE WHEN c IN ('pass','fail','softfail','neutral','none','temperror','permerror','policy') THEN c ELSE 'unknown' END AS dmarc_result,
 CASE WHEN p IN ('none','quarantine','reject') THEN p ELSE 'unknown' END AS dmarc_policy FROM r)
"""


@_query(
    _AUTH_SQL
    + """SELECT msg_id, spf_result, dkim_result, dmarc_result, trim(regexp_extract(spf, '\\(([^()]*)\\)', 1)) AS spf_reason,
 regexp_extract(spf, 'smtp\\.mailfrom=(?:[^@\\s;]*@)?([^\\s;]+)', 1) AS spf_domain, regexp_extract(dkim, 'header\\.d=([^\\s;]+)', 1) AS dkim_domain, regexp_extract(dmarc, 'header\\.from=([^\\s;]+)', 1) AS dmarc_domain FROM v"""
)
def auth_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts, reasons and domains of authentication headers."""
    return auth.parse(_headers(spark, folder), "header").select("msg_id", "spf_result", "dkim_result", "dmarc_result", "spf_reason", "spf_domain", "dkim_domain", "dmarc_domain")


@_query(_AUTH_SQL + "SELECT dmarc_policy, dmarc_result, count(*) AS n FROM v GROUP BY ALL")
def auth_dmarc_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Published policies by verdict."""
    return auth.parse(_headers(spark, folder), "header").groupBy("dmarc_policy", "dmarc_result").agg(F.count(F.lit(1)).alias("n"))


_STORED_HEADER = f"json_extract_string({_rec('authentication_json')}, '$.raw_header')"


@_query(
    f"""WITH h AS (SELECT id, {_STORED_HEADER} AS header FROM analyses)
SELECT id, CASE WHEN header IS NULL THEN 'unavailable' ELSE 'authentication-results-header' END AS source,
 nullif(lower(regexp_extract(header, '\\bspf\\s*=\\s*([a-zA-Z]+)', 1)), '') AS spf_result, nullif(lower(regexp_extract(header, '\\bdkim\\s*=\\s*([a-zA-Z]+)', 1)), '') AS dkim_result,
 nullif(lower(regexp_extract(header, '\\bdmarc\\s*=\\s*([a-zA-Z]+)', 1)), '') AS dmarc_result FROM h"""
)
def auth_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of the headers kept in stored analyses."""
    analyses = table(spark, folder, "analyses").select("id", F.get_json_object(record_text(F.col("authentication_json")), "$.raw_header").alias("header"))
    return auth.parse(analyses, "header").select("id", "source", "spf_result", "dkim_result", "dmarc_result")


_SIGNATURE = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v=1; a=rsa-sha256; d=x.test' WHEN 2 THEN 'v=1; x=soon; d=x.test' ELSE concat('v=1; x=1; X = ', CAST(CAST({epoch} AS BIGINT) + (o_orderkey % 7 - 3) * 86400 AS STRING), ' ; d=x.test') END"


@_query(
    f"""WITH d AS (SELECT o_orderkey, epoch(o_orderdate) AS e, {_SIGNATURE.format(epoch='epoch(o_orderdate)')} AS s FROM orders)
SELECT o_orderkey, s IS NOT NULL AS dkim_signature_present, TRY_CAST(regexp_extract(s, 'X = (\\d+)', 1) AS BIGINT) AS expiry,
 coalesce(TRY_CAST(regexp_extract(s, 'X = (\\d+)', 1) AS BIGINT) < e, false) AS dkim_signature_expired FROM d"""
)
def dkim_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Expiry of DKIM signatures against the message time."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    signed = orders.withColumn("signature", F.expr(_SIGNATURE.format(epoch="unix_seconds(at)")))
    return auth.dkim_expiry(signed, "signature", "at").select("o_orderkey", "dkim_signature_present", F.unix_seconds("dkim_expiry").alias("expiry"), "dkim_signature_expired")


def _case(column: str, group: str, default: int = 0) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[group].items()) + f" ELSE {default} END"


_VERDICT = "CASE WHEN score >= 70 THEN 'malicious' WHEN score >= 30 THEN 'suspicious' ELSE 'clean' END"


@_query(
    _AUTH_SQL
    + f""", w AS (SELECT msg_id, {_case('spf_result', 'spf')} + {_case('dkim_result', 'dkim')} + CASE WHEN dmarc_result = 'fail' THEN {_case('dmarc_policy', 'dmarc_fail', 5)} ELSE 0 END AS total FROM v),
t AS (SELECT msg_id, CAST(least(100, greatest(0, total)) AS INTEGER) AS score FROM w) SELECT msg_id, score, {_VERDICT} AS verdict FROM t"""
)
def auth_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of authentication alone."""
    verdicts = auth.parse(_headers(spark, folder), "header")
    return scoring.risk(verdicts, scoring.auth_factors(verdicts)).select("msg_id", "score", "verdict")


# --- relay chains ----------------------------------------------------------------------------------------------

_V4_OK = "regexp_full_match(x, '(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)')"
_FOLDED = "trim(regexp_replace(raw_header, '\\s+', ' ', 'g'))"
_FROM = "(?i)\\bfrom\\s+([^\\s(;]+)(?:\\s*\\(([^)]*)\\))?"


@_query(
    f"""WITH f AS (SELECT id, {_FOLDED} AS t FROM hops), g AS (SELECT *, regexp_extract(t, '{_FROM}', 2) AS p FROM f)
SELECT id, nullif(regexp_replace(regexp_extract(t, '{_FROM}', 1), '[,;]+$', ''), '') AS from_host,
 coalesce(list_filter(regexp_extract_all(p, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b'), lambda x: {_V4_OK})[1], list_filter(regexp_extract_all(p, '\\b[0-9a-fA-F:]{{2,45}}\\b'), lambda x: contains(x, ':'))[1],
  list_filter(regexp_extract_all(regexp_extract(t, '{_FROM}', 0), '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b'), lambda x: {_V4_OK})[1]) AS from_ip,
 nullif(regexp_replace(regexp_extract(t, '(?i)\\bby\\s+([^\\s(;]+)', 1), '[,;]+$', ''), '') AS by_host, nullif(regexp_replace(regexp_extract(t, '(?i)\\bwith\\s+([^\\s;]+)', 1), '[,;]+$', ''), '') AS protocol,
 CASE WHEN contains(t, ';') THEN nullif(trim(regexp_extract(t, '([^;]*)$', 1)), '') END AS timestamp_raw FROM g"""
)
def hop_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of Received headers."""
    hops = table(spark, folder, "hops").select("id", "raw_header")
    return relay.parse_hops(hops, with_time=False).select("id", "from_host", "from_ip", "by_host", "protocol", "timestamp_raw")


@_query()
def hop_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Mail dates of Received headers and the hops' confidence."""
    return relay.parse_hops(table(spark, folder, "hops").select("id", "raw_header")).select("id", "timestamp", "parse_confidence")


@_query("SELECT DISTINCT analysis_id AS msg_id, sequence, md5(raw_header) AS header FROM hops")
def hop_order(spark: SparkSession, folder: str) -> DataFrame:
    """Chains out of header lists, origin first."""
    newest_first = _hops(spark, folder, "raw_header").groupBy("msg_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("sequence", "raw_header")))).alias("x"))
    headers = newest_first.select("msg_id", F.transform("x", lambda h: h["raw_header"]).alias("received"))
    return relay.chain(headers, "received").select("msg_id", "sequence", F.md5("raw_header").alias("header"))


_NUMBER = "(CAST(split_part({ip}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({ip}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({ip}, '.', 3) AS BIGINT) * 256 + CAST(split_part({ip}, '.', 4) AS BIGINT))"


def _within_sql(number: str, cidrs: list[str]) -> str:
    return "(" + " OR ".join(f"{number} BETWEEN {a} AND {b}" for a, b in map(cidr_bounds, cidrs)) + ")"


def _bogon_sql(ip: str) -> str:
    number = _NUMBER.format(ip=ip)
    return f"(CASE WHEN {_V4_OK.replace('(x,', f'({ip},')} THEN {_within_sql(number, BOGON_V4)} AND NOT {_within_sql(number, DOCUMENTATION_V4)} ELSE coalesce({ip} LIKE 'fe80:%' OR {ip} LIKE 'fc%:%' OR {ip} LIKE 'fd%:%' OR {ip} IN ('::', '::1'), false) END)"


@_query(f"SELECT DISTINCT from_ip, {_bogon_sql('from_ip')} AS is_bogon FROM hops WHERE from_ip IS NOT NULL")
def hop_bogon(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that aren't public."""
    ips = table(spark, folder, "hops").select("from_ip").where("from_ip is not null").distinct()
    return ips.withColumn("is_bogon", is_bogon(F.col("from_ip")))


def _ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping invented ranges: one narrow range for each mail host, and three broad ones."""
    hosts = table(spark, folder, "mail_hosts").where("asn_org is not null").select("host", "asn_org")
    i = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("bigint") % 16384
    narrow = hosts.select((F.lit(167772160) + i * 1024).alias("low"), (F.lit(167772160) + i * 1024 + 1023).alias("high"), F.concat("asn_org", F.lit(" "), "host").alias("network"))
    broad = spark.createDataFrame([(167772160, 184549375, "ten"), (3325256704, 3325256959, "doc one"), (3405803776, 3405804031, "doc two")], "low long, high long, network string")
    return narrow.unionAll(broad)


@_query(
    f"""WITH h AS (SELECT asn_org || ' ' || host AS network, 167772160 + CAST('0x' || substr(md5(host), 1, 4) AS BIGINT) % 16384 * 1024 AS low FROM mail_hosts WHERE asn_org IS NOT NULL),
r AS (SELECT low, low + 1023 AS high, network FROM h UNION ALL VALUES (167772160, 184549375, 'ten'), (3325256704, 3325256959, 'doc one'), (3405803776, 3405804031, 'doc two')),
i AS (SELECT id, CASE WHEN {_V4_OK.replace('(x,', '(from_ip,')} THEN {_NUMBER.format(ip='from_ip')} END AS n FROM {_UNIQUE}),
j AS (SELECT n, first(network ORDER BY high - low, low, network) AS network FROM (SELECT DISTINCT n FROM i) JOIN r ON n BETWEEN low AND high GROUP BY n)
SELECT id, network FROM i LEFT JOIN j USING (n)"""
)
def geo_range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Hops with the network whose range holds their address."""
    hops = _hops(spark, folder, "from_ip").select("id", "from_ip")
    return geo.range_join(hops, "from_ip", _ranges(spark, folder), ["network"]).select("id", "network")


_FIXED_RANGES = [(167772160, 167772160 + 2**23 - 1, "ten low"), (167772160 + 2**23, 184549375, "ten high"), (2886729728, 2887778303, "private"), (3221225984, 3221226239, "doc"), (3325256704, 3325256959, "doc one"), (3325256704, 3325256767, "doc one a"), (3405803776, 3405804031, "doc two")]


@_query(
    f"""WITH r(low, high, network) AS (VALUES {", ".join(f"({a}, {b}, '{n}')" for a, b, n in _FIXED_RANGES)}),
i AS (SELECT id, from_ip, CASE WHEN {_V4_OK.replace('(x,', '(from_ip,')} THEN {_NUMBER.format(ip='from_ip')} END AS n FROM {_UNIQUE})
SELECT id, (SELECT network FROM r WHERE i.n BETWEEN r.low AND r.high ORDER BY r.high - r.low, r.low LIMIT 1) AS network FROM i"""
)
def geo_fixed_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ranges that SQL can list, one within another."""
    ranges = spark.createDataFrame(_FIXED_RANGES, "low long, high long, network string")
    return geo.range_join(_hops(spark, folder, "from_ip").select("id", "from_ip"), "from_ip", ranges, ["network"]).select("id", "network")


_TEXT_RANGES = [("10.0.0.0", "10.255.255.255", "ten"), ("198.51.100.0", "198.51.100.255", "doc one"), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "doc six"), ("2001:db8::", "2001:db8::7fff:ffff", "doc six low"), ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "unicast")]
_V6_TAIL = "split_part(from_ip, '2001:db8::', 2)"


@_query(
    f"""WITH i AS (SELECT id, from_ip, CASE WHEN {_V4_OK.replace('(x,', '(from_ip,')} THEN {_NUMBER.format(ip='from_ip')} END AS n FROM {_UNIQUE})
SELECT id, CASE WHEN n BETWEEN 167772160 AND 184549375 THEN 'ten' WHEN n BETWEEN 3325256704 AND 3325256959 THEN 'doc one'
 WHEN from_ip LIKE '2001:db8::%' AND (NOT contains({_V6_TAIL}, ':') OR length(split_part({_V6_TAIL}, ':', 1)) < 4 OR split_part({_V6_TAIL}, ':', 1) < '8') THEN 'doc six low'
 WHEN from_ip LIKE '2001:db8:%' THEN 'doc six' END AS network FROM i"""
)
def geo_text_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """IPv4 and IPv6 addresses with ranges given as text."""
    ranges = spark.createDataFrame(_TEXT_RANGES, "low string, high string, network string")
    return geo.range_join(_hops(spark, folder, "from_ip").select("id", "from_ip"), "from_ip", ranges, ["network"]).select("id", "network")


# --- anomalies ---------------------------------------------------------------------------------------------------

def _rule(found: DataFrame) -> DataFrame:
    return found.select("msg_id", "type", "severity", F.array_join(F.col("hop_sequences").cast("array<string>"), ",").alias("sequences"))


def _pair_sql(where: str, kind: str, severity: str) -> str:
    return f"""WITH u AS {_UNIQUE}, l AS (SELECT *, lag(timestamp) OVER w AS pt, lag(by_host) OVER w AS pb, lag(sequence) OVER w AS ps FROM u WINDOW w AS (PARTITION BY msg_id ORDER BY sequence))
SELECT msg_id, '{kind}' AS type, '{severity}' AS severity, CAST(ps AS VARCHAR) || ',' || CAST(sequence AS VARCHAR) AS sequences FROM l WHERE {where}"""


@_query(f"SELECT msg_id, 'impossible_timestamp' AS type, 'medium' AS severity, CAST(sequence AS VARCHAR) AS sequences FROM {_UNIQUE} WHERE timestamp < TIMESTAMPTZ '2025-01-01 00:00:00+00'")
def anomaly_old_time(spark: SparkSession, folder: str) -> DataFrame:
    """Times before a year, here 2025 as nothing is older than mail."""
    return _rule(rules.impossible_timestamp(_hops(spark, folder, "timestamp"), 2025))


@_query(_pair_sql("timestamp < pt", "negative_time_delta", "high"))
def anomaly_negative_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Hops stamped before the hop they follow."""
    return _rule(rules.negative_delta(_hops(spark, folder, "timestamp")))


@_query(_pair_sql("epoch_us(timestamp) - epoch_us(pt) > 21600000000", "large_timezone_jump", "low"))
def anomaly_large_gap(spark: SparkSession, folder: str) -> DataFrame:
    """More than six hours between hops."""
    return _rule(rules.large_gap(_hops(spark, folder, "timestamp")))


_ORG = "list_aggregate(list_slice(string_split(lower(regexp_replace({h}, '\\.+$', '')), '.'), -2, -1), 'string_agg', '.')"


@_query(
    f"""SELECT msg_id, 'bogon_ip_in_path' AS type, 'high' AS severity, CAST(sequence AS VARCHAR) AS sequences FROM {_UNIQUE}
WHERE from_ip IS NOT NULL AND {_bogon_sql('from_ip')} AND NOT coalesce({_ORG.format(h='from_host')} = {_ORG.format(h='by_host')}, false)"""
)
def anomaly_bogon(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that aren't public on hops between organisations."""
    return _rule(rules.bogon_in_path(_hops(spark, folder, "from_ip", "from_host", "by_host")))


@_query(f"SELECT msg_id, 'hop_count_outlier' AS type, 'low' AS severity, list_aggregate(list_transform(range(count(*)), lambda i: CAST(i AS VARCHAR)), 'string_agg', ',') AS sequences FROM {_UNIQUE} GROUP BY msg_id HAVING count(*) > 5")
def anomaly_hop_count(spark: SparkSession, folder: str) -> DataFrame:
    """Long chains, here of more than five hops."""
    return _rule(rules.hop_count_outlier(_hops(spark, folder), 5))


@_query(
    f"""SELECT msg_id, 'forged_internal_origin' AS type, 'medium' AS severity, string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY sequence) AS sequences FROM {_UNIQUE}
WHERE by_host <> '' GROUP BY msg_id, lower(regexp_replace(by_host, '\\.+$', '')) HAVING count(*) > 1"""
)
def anomaly_duplicate_host(spark: SparkSession, folder: str) -> DataFrame:
    """One receiving host named twice in a chain."""
    return _rule(rules.duplicate_receiver(_hops(spark, folder, "by_host")))


_EVENT_HOPS = """SELECT CAST(user_id AS STRING) AS msg_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS sequence,
 concat('h', CAST(event_id % 5 AS STRING), '.org', CAST(event_id % 3 AS STRING), '.test') AS from_host, concat('H', CAST(user_id % 5 AS STRING), '.org', CAST(event_id % 2 AS STRING), '.test.') AS by_host FROM {events}"""


@_query(
    f"""WITH h AS ({_EVENT_HOPS.format(events='events')}), l AS (SELECT *, lag(by_host) OVER (PARTITION BY msg_id ORDER BY sequence) AS pb FROM h)
SELECT msg_id, 'forged_internal_origin' AS type, 'medium' AS severity, CAST(sequence - 1 AS VARCHAR) || ',' || CAST(sequence AS VARCHAR) AS sequences FROM l WHERE lower(regexp_replace(pb, '\\.+$', '')) <> lower(regexp_replace(from_host, '\\.+$', ''))"""
)
def anomaly_chain_break(spark: SparkSession, folder: str) -> DataFrame:
    """Hops that don't continue the chain, on chains made of events, as no stored chain is broken."""
    hops = spark.sql(_EVENT_HOPS.format(events="{events}"), events=table(spark, folder, "events"))
    return _rule(rules.chain_break(hops))


@_query("SELECT id AS msg_id, 'dkim_signature_expired' AS type, 'medium' AS severity, '' AS sequences FROM analyses WHERE dkim_signature_expired")
def anomaly_dkim_expired(spark: SparkSession, folder: str) -> DataFrame:
    """Expired signatures."""
    return _rule(rules.dkim_expired(table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), "dkim_signature_expired")))


_ISO = "strftime({t} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_DELTA = "((epoch_us(timestamp) - epoch_us(pt)) / 1000000.0)"
_PLAIN_HOST = "lower(regexp_replace({h}, '\\.+$', ''))"


@_query(
    f"""WITH u AS {_UNIQUE},
c AS (SELECT *, lag(sequence) OVER w AS ps, lag(timestamp) OVER w AS pt, lag(by_host) OVER w AS pb, count(*) OVER (PARTITION BY msg_id) AS n, {_PLAIN_HOST.format(h='by_host')} AS host FROM u WINDOW w AS (PARTITION BY msg_id ORDER BY sequence)),
g AS (SELECT msg_id, host, list(sequence ORDER BY sequence) AS places FROM c WHERE host <> '' GROUP BY ALL HAVING count(*) > 1),
a AS (
 SELECT msg_id, 1 AS rule, 'impossible_timestamp' AS type, 'medium' AS severity, [sequence] AS hs, 'Hop ' || sequence || ' timestamp predates the internet email era' AS summary, 'Received timestamp parses to ' || {_ISO.format(t='timestamp')} AS evidence FROM c WHERE timestamp < TIMESTAMPTZ '1990-01-01 00:00:00+00'
 UNION ALL SELECT msg_id, 2, 'negative_time_delta', 'high', [ps, sequence], 'Hop ' || sequence || ' is timestamped before hop ' || ps || ', which received it earlier in the chain',
  'hop ' || ps || ' at ' || {_ISO.format(t='pt')} || ' -> hop ' || sequence || ' at ' || {_ISO.format(t='timestamp')} || ', delta ' || CAST(round_even({_DELTA}, 0) AS BIGINT) || 's' FROM c WHERE timestamp < pt
 UNION ALL SELECT msg_id, 2, 'large_timezone_jump', 'low', [ps, sequence], 'Large ' || printf('%.1f', round_even({_DELTA} / 3600, 1)) || 'h gap between hop ' || ps || ' and ' || sequence, 'hop ' || ps || ' at ' || {_ISO.format(t='pt')} || ' -> hop ' || sequence || ' at ' || {_ISO.format(t='timestamp')} FROM c WHERE {_DELTA} > 21600
 UNION ALL SELECT msg_id, 3, 'bogon_ip_in_path', 'high', [sequence], 'Hop ' || sequence || ' claims a private/non-routable sending address', 'hop ' || sequence || ' from ' || coalesce('''' || from_host || '''', 'None') || ' reports source IP ' || from_ip || ' (by ' || coalesce('''' || by_host || '''', 'None') || ')'
  FROM c WHERE from_ip IS NOT NULL AND {_bogon_sql('from_ip')} AND NOT coalesce({_ORG.format(h='from_host')} = {_ORG.format(h='by_host')}, false)
 UNION ALL SELECT msg_id, 4, 'hop_count_outlier', 'low', range(any_value(n)), 'Unusually long relay chain: ' || any_value(n) || ' hops', any_value(n) || ' Received headers exceeds the 8-hop baseline' FROM c WHERE n > 8 GROUP BY msg_id
 UNION ALL SELECT msg_id, 5, 'forged_internal_origin', 'medium', places, 'Same recipient host ''' || host || ''' claimed by ' || len(places) || ' separate hops', 'hops [' || list_aggregate(list_transform(places, lambda x: CAST(x AS VARCHAR)), 'string_agg', ', ') || '] all name ''' || host || ''' as the receiving server' FROM g
 UNION ALL SELECT msg_id, 6, 'forged_internal_origin', 'medium', [ps, sequence], 'Relay chain break between hop ' || ps || ' and hop ' || sequence, 'hop ' || ps || ' was received ''by ' || pb || ''', but hop ' || sequence || ' claims to be ''from ' || from_host || ''''
  FROM c WHERE pb <> '' AND from_host <> '' AND {_PLAIN_HOST.format(h='pb')} <> {_PLAIN_HOST.format(h='from_host')}
 UNION ALL SELECT id, 7, 'dkim_signature_expired', 'medium', [], 'DKIM signature is expired', 'signature expiration tag is in the past relative to the message Date' FROM analyses WHERE dkim_signature_expired)
SELECT msg_id, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY rule, hs[1], type, summary) - 1 AS INTEGER) AS ordinal, type, severity, coalesce(list_aggregate(list_transform(hs, lambda x: CAST(x AS VARCHAR)), 'string_agg', ','), '') AS sequences, summary, evidence FROM a"""
)
def anomaly_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule over every chain, with summaries and evidence."""
    hops = _hops(spark, folder, "timestamp", "from_ip", "from_host", "by_host")
    messages = table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), "dkim_signature_expired")
    return rules.detect(hops, messages).select("msg_id", "ordinal", "type", "severity", F.array_join(F.col("hop_sequences").cast("array<string>"), ",").alias("sequences"), "summary", "evidence")


@_query("SELECT analysis_id AS msg_id, arg_max(severity, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END) AS highest_severity FROM anomalies GROUP BY 1")
def highest_severity(spark: SparkSession, folder: str) -> DataFrame:
    """The highest severity of each analysis."""
    return rules.highest_severity(_anomalies(spark, folder))


# --- lookalike domains ---------------------------------------------------------------------------------------------

_SKELETON = f"lower(translate(domain, '{CONFUSABLE_FROM}', '{CONFUSABLE_TO}'))"
_PAIRS = f"(SELECT DISTINCT {_DOMAIN} AS domain, position, brand FROM customer, {_BRANDS} WHERE {_DOMAIN} <> brand)"


@_query(f"SELECT DISTINCT domain, {_SKELETON} AS skeleton FROM (SELECT {_DOMAIN} AS domain FROM customer)")
def domain_skeleton(spark: SparkSession, folder: str) -> DataFrame:
    """What domains look like (L1, L3)."""
    domains = _domains(spark, folder).distinct()
    return domains.withColumn("skeleton", lookalike.skeleton(lookalike.normal_domain(F.col("domain"))))


@_query(f"SELECT domain, brand, levenshtein(domain, brand) AS distance FROM {_PAIRS} WHERE levenshtein(domain, brand) BETWEEN 1 AND 2")
def domain_levenshtein(spark: SparkSession, folder: str) -> DataFrame:
    """Domains an edit or two from a brand."""
    pairs = lookalike.against_brands(_domains(spark, folder), "domain")
    return pairs.select("domain", "brand", F.levenshtein("shown", "brand_plain").cast("bigint").alias("distance")).where("distance between 1 and 2")


@_query(f"SELECT domain, brand, round(jaro_winkler_similarity(domain, brand), 6) AS similarity FROM {_PAIRS}")
def domain_jaro_winkler(spark: SparkSession, folder: str) -> DataFrame:
    """Jaro-Winkler similarity of domains and brands."""
    pairs = lookalike.against_brands(_domains(spark, folder), "domain")
    return pairs.select("domain", "brand", F.round(lookalike.jaro_winkler(F.col("shown"), F.col("brand_plain")), 6).alias("similarity"))


_WORDS = f"list_filter(regexp_split_to_array(split_part({_SKELETON}, '.', 1), '[-_]'), lambda w: w <> '')"
_NEAR = f"(CASE WHEN len({_WORDS}) > 1 THEN list_filter({_WORDS}, lambda w: levenshtein(w, split_part(brand, '.', 1)) <= 1 AND length(w) >= length(split_part(brand, '.', 1)) - 1)[1] END)"


@_query(f"SELECT domain, brand, {_NEAR} AS word FROM {_PAIRS} WHERE {_NEAR} IS NOT NULL")
def domain_brand_token(spark: SparkSession, folder: str) -> DataFrame:
    """Brands that stand as a word of a domain."""
    pairs = lookalike.against_brands(_domains(spark, folder), "domain")
    word = lookalike.brand_word(F.col("skeleton"), F.substring_index("brand_plain", ".", 1))
    return pairs.select("domain", "brand", word.alias("word")).where("word is not null")


_METHOD = f"CASE WHEN {_SKELETON} = brand THEN 'homoglyph_skeleton' WHEN levenshtein(domain, brand) BETWEEN 1 AND 2 THEN 'levenshtein' WHEN jaro_winkler_similarity(domain, brand) >= 0.92 THEN 'jaro_winkler' WHEN {_NEAR} IS NOT NULL THEN 'brand_substring' END"


@_query(f"SELECT domain, brand, method FROM (SELECT domain, brand, {_METHOD} AS method FROM {_PAIRS}) WHERE method IS NOT NULL")
def domain_lookalike(spark: SparkSession, folder: str) -> DataFrame:
    """The first rule that makes a domain a lookalike of each brand (L4)."""
    return lookalike.matches(_domains(spark, folder), "domain").select("domain", "brand", "method")


@_query()
def domain_lookalike_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Sender domains of stored analyses against the mail hosts' own domains, punycode resolved (L2, L4)."""
    own = table(spark, folder, "mail_hosts").select(organisation_domain(F.col("host")).alias("brand"))
    domains = _signals(spark, folder).select(F.col("s.sender_domain_lookalike.domain").alias("domain"))
    return lookalike.matches(domains, "domain", own).select("domain", "is_punycode", "decoded_unicode", "brand", "method")


@_query("SELECT id, CASE WHEN contains(from_address, '@') THEN nullif(lower(regexp_extract(from_address, '([^@]*)$', 1)), '') END AS domain FROM analyses")
def sender_domain(spark: SparkSession, folder: str) -> DataFrame:
    """What follows the last @."""
    return table(spark, folder, "analyses").select("id", F.when(F.col("from_address").contains("@"), F.nullif(F.lower(F.substring_index("from_address", "@", -1)), F.lit(""))).alias("domain"))


# --- links -----------------------------------------------------------------------------------------------------------


@_query(
    """WITH f AS (SELECT doc_id, regexp_extract_all(text, 'https?://[^\\s<>"'']+') AS u FROM documents WHERE contains(text, '://')),
p AS (SELECT doc_id, unnest(u) AS raw_url, generate_subscripts(u, 1) AS i FROM f), e AS (SELECT doc_id, raw_url, min(i) AS first FROM p GROUP BY ALL)
SELECT doc_id, raw_url, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS ordinal FROM e"""
)
def url_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Links in texts, each once."""
    return urls.text_links(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "raw_url", "ordinal")


@_query(f"SELECT DISTINCT raw_url, nullif(lower(regexp_extract(raw_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '') AS host, nullif(lower(regexp_extract(raw_url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)), '') AS scheme FROM ({_URLS_SQL})")
def url_host(spark: SparkSession, folder: str) -> DataFrame:
    """Scheme and host of stored links (U4)."""
    links = _stored_urls(spark, folder).select("raw_url").distinct()
    return links.select("raw_url", urls.host_of(F.col("raw_url")).alias("host"), urls.scheme_of(F.col("raw_url")).alias("scheme"))


@_query(f"SELECT DISTINCT raw_url, {_V4_OK.replace('(x,', '(h,')} AS is_ip_literal FROM (SELECT raw_url, regexp_extract(raw_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1) AS h FROM ({_URLS_SQL}))")
def url_ip_literal(spark: SparkSession, folder: str) -> DataFrame:
    """Links to bare addresses."""
    links = _stored_urls(spark, folder).select("raw_url").distinct()
    return links.select("raw_url", F.coalesce(is_ip(urls.host_of(F.col("raw_url"))), F.lit(False)).alias("is_ip_literal"))


_REDIRECT = {
    "spark": "CASE c_custkey % 4 WHEN 0 THEN concat('https://r.test/go?x=1&next=http%3A%2F%2Fp', CAST(c_custkey AS STRING), '.test%2Fs%20a') WHEN 1 THEN concat('https://r.test/go?u=', base64(CAST(concat('http://p', CAST(c_custkey AS STRING), '.test/s') AS BINARY))) WHEN 2 THEN concat('https://r.test/go?to=home&url=', CAST(c_custkey AS STRING)) ELSE concat('https://r.test/', CAST(c_custkey AS STRING)) END",
}


@_query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'http://p' || CAST(c_custkey AS VARCHAR) || '.test/s a' WHEN 1 THEN 'http://p' || CAST(c_custkey AS VARCHAR) || '.test/s' END AS target FROM customer")
def url_redirect(spark: SparkSession, folder: str) -> DataFrame:
    """Targets inside redirecting links, percent- or base64-encoded."""
    links = table(spark, folder, "customer").select("c_custkey", F.expr(_REDIRECT["spark"]).alias("url"))
    return links.select("c_custkey", urls.redirect_target(F.col("url")).alias("target"))


_ANCHOR = "CASE c_custkey % 6 WHEN 0 THEN 'Sign in at PayPal.com now' WHEN 1 THEN 'Click here' WHEN 2 THEN 'www.d1.test' WHEN 3 THEN 'd1.test' WHEN 4 THEN 'mail.d1.test' ELSE NULL END"
_AHOST = "CASE c_custkey % 5 WHEN 0 THEN 'd1.test' WHEN 1 THEN 'www.d1.test' WHEN 2 THEN 'checkout.paypal.com' WHEN 3 THEN 'evil.test' ELSE NULL END"


@_query(
    f"""WITH p AS (SELECT c_custkey, {_ANCHOR} AS anchor, {_AHOST} AS host FROM customer),
c AS (SELECT *, CASE WHEN host IS NOT NULL THEN nullif(lower(regexp_extract(anchor, '\\b([a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\\.[a-zA-Z]{{2,}})\\b', 1)), '') END AS claimed FROM p)
SELECT c_custkey, claimed, coalesce(NOT (claimed = host OR claimed = 'www.' || host OR 'www.' || claimed = host OR ends_with(host, '.' || claimed) OR ends_with(claimed, '.' || host)), false) AS mismatch FROM c"""
)
def anchor_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Anchor texts that claim another domain."""
    links = table(spark, folder, "customer").select("c_custkey", F.expr(_ANCHOR).alias("anchor"), F.expr(_AHOST).alias("host"))
    claimed = links.withColumn("claimed", urls.claimed_domain(F.col("anchor"), F.col("host")))
    return claimed.select("c_custkey", "claimed", urls.mismatch(F.col("claimed"), F.col("host")).alias("mismatch"))


_HTML = "concat('<p>see <a href=\" https://a', CAST(c_custkey % 9 AS STRING), '.test/x?a=1&amp;b=2 \"><b>Go</b> to bank', CAST(c_custkey AS STRING), '.test</a> or <a href=\"mailto:a@b.test\">mail</a> https://b.test/', CAST(c_custkey AS STRING), ' <!-- https://c.test --></p>')"


@_query(
    """SELECT c_custkey, 0 AS ordinal, 'https://a' || CAST(c_custkey % 9 AS VARCHAR) || '.test/x?a=1&b=2' AS raw_url, 'Goto bank' || CAST(c_custkey AS VARCHAR) || '.test' AS anchor_text FROM customer
UNION ALL SELECT c_custkey, 1, 'https://b.test/' || CAST(c_custkey AS VARCHAR), NULL FROM customer"""
)
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of HTML bodies."""
    bodies = table(spark, folder, "customer").select("c_custkey", F.expr(_HTML).alias("body"), F.lit(True).alias("is_html"))
    return urls.body_links(bodies, "c_custkey", "body", "is_html")


@_query(
    """WITH d AS (SELECT DISTINCT lower(regexp_extract(from_address, '([^@]*)$', 1)) AS domain FROM analyses WHERE contains(from_address, '@')),
i AS (SELECT DISTINCT regexp_extract(lower(host), '([^.]+\\.[^.]+)$', 1) AS domain FROM mail_hosts),
j AS (SELECT d.domain, i.domain IS NOT NULL AS known, CAST(75 - length(d.domain) % 60 AS INTEGER) AS age FROM d LEFT JOIN i USING (domain))
SELECT domain, CASE WHEN known THEN age END AS age_days, CASE WHEN known THEN age < 30 END AS is_newly_registered, CASE WHEN known THEN 'cached' ELSE 'unavailable' END AS intel_source FROM j"""
)
def domain_age(spark: SparkSession, folder: str) -> DataFrame:
    """Ages of sender domains from an offline dimension."""
    domains = table(spark, folder, "analyses").where(F.col("from_address").contains("@")).select(F.lower(F.substring_index("from_address", "@", -1)).alias("domain")).distinct()
    org = organisation_domain(F.col("host"))
    intel = table(spark, folder, "mail_hosts").select(org.alias("domain")).distinct().withColumn("registration_date", F.timestamp_seconds(F.lit(1704067200) + (F.length("domain") % 60) * 86400))
    aged = urls.domain_ages(domains, "domain", intel, F.timestamp_seconds(F.lit(1704067200 + 75 * 86400)))
    return aged.select("domain", "age_days", "is_newly_registered", "intel_source")


@_query("SELECT c_custkey, c_custkey % 4 IN (0, 1) AS redirects FROM customer WHERE c_custkey % 4 IN (0, 1) OR c_custkey % 7 = 0")
def flagged_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Links that something is odd about: redirecting ones, and each seventh with a bare address."""
    links = table(spark, folder, "customer").select("c_custkey", F.expr(_REDIRECT["spark"]).alias("raw_url"))
    analysed = links.select("c_custkey", urls.redirect_target(F.col("raw_url")).alias("unwrapped_target"), (F.col("c_custkey") % 7 == 0).alias("is_ip_literal"), F.lit(None).cast("boolean").alias("anchor_text_mismatch"), F.lit(False).alias("has_lookalike"))
    return store.flagged_urls(analysed).select("c_custkey", F.col("unwrapped_target").isNotNull().alias("redirects"))


# --- scoring, attribution, indicators ------------------------------------------------------------------------------------


def _factors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    messages = table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), "spf_result", "dkim_result", "dmarc_result", "dmarc_policy")
    odd = exports.numbered(_anomalies(spark, folder), "msg_id", "anomaly_id")
    found = scoring.union([scoring.auth_factors(messages), scoring.anomaly_factors(odd), scoring.signal_factors(_signals(spark, folder))])
    return messages, found


_FACTORS_SQL = f"""
WITH s AS (SELECT id AS msg_id, {_rec('ai_signals_json')} AS j FROM analyses),
l AS (SELECT * FROM ({_URLS_SQL})),
o AS (SELECT msg_id, json_extract(j, '$.sender_domain_lookalike') AS k, true AS sender, 0 AS n FROM s UNION ALL SELECT msg_id, lookalike, false, ordinal FROM l),
m AS (SELECT msg_id, sender, n, coalesce(CAST(json_extract_string(k, '$.is_punycode') AS BOOLEAN), false) AS puny, json_extract_string(k, '$.matches[' || CAST(i AS VARCHAR) || '].method') AS method
 FROM (SELECT *, unnest(range(CAST(coalesce(json_array_length(k, '$.matches'), 0) AS BIGINT))) AS i FROM o)),
f AS (
 SELECT id AS msg_id, {_case('spf_result', 'spf')} AS weight, 'authentication' AS category FROM analyses
 UNION ALL SELECT id, {_case('dkim_result', 'dkim')}, 'authentication' FROM analyses
 UNION ALL SELECT id, {_case("coalesce(dmarc_policy, 'unknown')", 'dmarc_fail', 5)}, 'authentication' FROM analyses WHERE dmarc_result = 'fail'
 UNION ALL SELECT analysis_id, {_case('severity', 'severity')}, 'relay_chain' FROM anomalies
 UNION ALL SELECT msg_id, 25, 'phishing_classifier' FROM s WHERE json_extract_string(j, '$.phishing.source') = 'onnx-model' AND CAST(json_extract_string(j, '$.phishing.phishing_probability') AS DOUBLE) >= 0.7
 UNION ALL SELECT msg_id, CASE WHEN sender THEN {_case('method', 'sender_lookalike')} ELSE {_case('method', 'url_lookalike')} END, 'lookalike_domain' FROM m
 UNION ALL SELECT msg_id, 10, 'lookalike_domain' FROM (SELECT DISTINCT msg_id, sender, n FROM m WHERE puny)
 UNION ALL SELECT msg_id, 12, 'url_analysis' FROM l WHERE is_ip_literal
 UNION ALL SELECT msg_id, 10, 'url_analysis' FROM l WHERE mismatch
 UNION ALL SELECT msg_id, 15, 'url_analysis' FROM l WHERE is_new
 UNION ALL SELECT msg_id, 5, 'ai_text' FROM s WHERE json_extract_string(j, '$.ai_text.source') = 'onnx-model' AND json_extract_string(j, '$.ai_text.low_perplexity_flag') = 'true')
"""


@_query(_FACTORS_SQL + "SELECT msg_id, category, CAST(weight AS INTEGER) AS weight, count(*) AS n FROM f WHERE weight <> 0 GROUP BY ALL")
def factor_union(spark: SparkSession, folder: str) -> DataFrame:
    """All factors of stored analyses, counted by category and weight."""
    return _factors(spark, folder)[1].groupBy("msg_id", "category", "weight").agg(F.count(F.lit(1)).alias("n"))


@_query(_FACTORS_SQL + f", t AS (SELECT id AS msg_id, CAST(least(100, greatest(0, coalesce(sum(weight), 0))) AS INTEGER) AS score FROM analyses LEFT JOIN f ON f.msg_id = id GROUP BY id) SELECT msg_id, score, {_VERDICT} AS verdict FROM t")
def risk_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of stored analyses."""
    messages, found = _factors(spark, folder)
    return scoring.risk(messages, found).select("msg_id", "score", "verdict")


@_query(_FACTORS_SQL + "SELECT msg_id, CAST(weight AS INTEGER) AS weight, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY weight DESC) AS INTEGER) AS rank FROM f WHERE weight <> 0")
def factor_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Factors, heaviest first."""
    return scoring.ranked(_factors(spark, folder)[1]).select("msg_id", "weight", "rank")


@_query("SELECT spf_result, " + _case("spf_result", "spf") + " AS weight, count(*) AS n FROM analyses WHERE spf_result IS NOT NULL GROUP BY ALL")
def weight_join(spark: SparkSession, folder: str) -> DataFrame:
    """Weights looked up by verdict (F1)."""
    verdicts = table(spark, folder, "analyses").where("spf_result is not null").groupBy("spf_result").agg(F.count(F.lit(1)).alias("n"))
    return verdicts.select("spf_result", F.coalesce(scoring.weight_of("spf", F.col("spf_result")), F.lit(0)).alias("weight"), "n")


_CANDIDATES = f"(SELECT msg_id, arg_min(from_ip, sequence) AS ip, min(sequence) AS sequence, arg_min(enrichment_source, sequence) AS es FROM {_UNIQUE} WHERE from_ip <> '' AND NOT is_bogon GROUP BY msg_id)"


@_query(f"SELECT msg_id, ip AS from_ip, sequence FROM {_CANDIDATES}")
def origin_candidate(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest hop with a public address."""
    return attribution.candidates(_hops(spark, folder, "from_ip", "is_bogon")).select("msg_id", "from_ip", "sequence")


def _attribution(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), "spf_result")
    hops = _hops(spark, folder, "from_ip", "from_host", "is_bogon", "enrichment_source", "asn", "asn_org", "country")
    return attribution.attribute(messages, hops, _anomalies(spark, folder))


@_query(
    f"""WITH c AS {_CANDIDATES}, g AS (SELECT DISTINCT a.analysis_id AS msg_id FROM anomalies a JOIN c ON c.msg_id = a.analysis_id WHERE a.type IN ('forged_internal_origin', 'negative_time_delta') AND list_min(a.hop_sequences) <= c.sequence)
SELECT id AS msg_id, CASE WHEN c.msg_id IS NULL THEN 'unavailable' ELSE 'heuristic' END AS source, c.ip AS origin_ip,
 CASE WHEN c.msg_id IS NULL THEN 'unknown' WHEN g.msg_id IS NOT NULL THEN 'low' WHEN es = 'geolite2-local' THEN 'high' ELSE 'medium' END AS confidence
FROM analyses LEFT JOIN c ON c.msg_id = id LEFT JOIN g ON g.msg_id = id"""
)
def origin_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Where messages come from, and how sure that is."""
    return _attribution(spark, folder).select("msg_id", "source", "origin_ip", "confidence")


@_query(
    f"""WITH c AS (SELECT msg_id, arg_min({{'ip': from_ip, 'sequence': sequence, 'host': from_host, 'es': enrichment_source, 'asn': asn, 'org': asn_org, 'country': country}}, sequence) AS c FROM {_UNIQUE} WHERE from_ip <> '' AND NOT is_bogon GROUP BY msg_id),
g AS (SELECT a.analysis_id AS msg_id, count(*) AS n, string_agg(DISTINCT a.type, ', ' ORDER BY a.type) AS kinds FROM anomalies a JOIN c ON c.msg_id = a.analysis_id WHERE a.type IN ('forged_internal_origin', 'negative_time_delta') AND list_min(a.hop_sequences) <= c.c.sequence GROUP BY 1)
SELECT id AS msg_id, CASE WHEN c.msg_id IS NULL THEN 'unavailable' ELSE 'heuristic' END AS source, c.c.ip AS origin_ip, c.c.sequence AS origin_hop_sequence, c.c.asn AS asn, c.c.org AS asn_org, c.c.country AS country,
 CASE WHEN c.msg_id IS NULL THEN 'unknown' WHEN g.n > 0 THEN 'low' WHEN c.c.es = 'geolite2-local' THEN 'high' ELSE 'medium' END AS confidence,
 CASE WHEN c.msg_id IS NULL THEN 'no hop in the reconstructed relay chain reports a public, non-bogon source IP' ELSE concat_ws(' ',
  'earliest hop reporting a public source IP is hop #' || c.c.sequence || ' (' || c.c.ip || ', claimed sending host ' || coalesce(c.c.host, 'unknown') || ').',
  CASE WHEN c.c.es = 'geolite2-local' THEN 'GeoIP enrichment attributes this address to ' || coalesce(c.c.org, 'an unnamed organization') || ' (AS' || coalesce(CAST(c.c.asn AS VARCHAR), '?') || '), ' || coalesce(c.c.country, 'unknown country') || '.' ELSE 'no GeoIP enrichment is available for this address.' END,
  CASE WHEN g.n > 0 THEN 'confidence is capped at ''low'': ' || g.n || CASE WHEN g.n = 1 THEN ' relay-chain anomaly (' ELSE ' relay-chain anomalies (' END || g.kinds || CASE WHEN g.n = 1 THEN ') affects' ELSE ') affect' END || ' this hop or an earlier one.' END,
  CASE spf_result WHEN 'fail' THEN 'SPF failed for the claimed sending domain.' WHEN 'pass' THEN 'SPF passed, corroborating that this hop''s IP is an authorized sender for the claimed domain.' END) END AS reasoning
FROM analyses LEFT JOIN c ON c.msg_id = id LEFT JOIN g ON g.msg_id = id"""
)
def origin_reasoning(spark: SparkSession, folder: str) -> DataFrame:
    """The same with its reasons."""
    return _attribution(spark, folder)


def _iocs(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), "from_address")
    hops = _hops(spark, folder, "from_ip", "from_host", "by_host")
    attached = iocs.stored_attachments(table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), F.col("meta_json").alias("record")))
    return iocs.extract(messages, hops, attached, _stored_urls(spark, folder))


_URL_HOST = "nullif(lower(regexp_extract(raw_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '')"
_IOC_SQL = f"""
WITH u AS {_UNIQUE}, l AS ({_URLS_SQL}), r(id, prefix, j) AS (SELECT id, '', {whole_record('meta_json')} FROM analyses), a AS (SELECT * FROM {elements('r', 'attachments')} WHERE json_type(e) = 'OBJECT'), i AS (
 SELECT id AS msg_id, 'email' AS type, from_address AS value, 0 AS part, 0 AS o, 'sender (From) address' AS context FROM analyses
 UNION ALL SELECT msg_id, CASE WHEN contains(from_ip, ':') THEN 'ipv6' ELSE 'ipv4' END, from_ip, 1, sequence * 3, 'relay hop #' || CAST(sequence AS VARCHAR) || ' source IP (claimed host: ' || coalesce(from_host, 'unknown') || ')' FROM u
 UNION ALL SELECT msg_id, 'domain', from_host, 1, sequence * 3 + 1, 'relay hop #' || CAST(sequence AS VARCHAR) || ' source hostname' FROM u
 UNION ALL SELECT msg_id, 'domain', by_host, 1, sequence * 3 + 2, 'relay hop #' || CAST(sequence AS VARCHAR) || ' receiving hostname' FROM u
 UNION ALL SELECT id, 'sha256', json_extract_string(e, '$.sha256'), 2, i, 'attachment ''' || coalesce(json_extract_string(e, '$.filename'), '') || ''' (' || coalesce(json_extract_string(e, '$.size_bytes'), '0') || ' bytes, ' || coalesce(json_extract_string(e, '$.content_type'), 'unknown type') || ')' FROM a
 UNION ALL SELECT msg_id, 'url', raw_url, 3, ordinal * 3, 'link found in message body' FROM l
 UNION ALL SELECT msg_id, CASE WHEN is_ip_literal THEN 'ipv4' ELSE 'domain' END, {_URL_HOST}, 3, ordinal * 3 + 1, CASE WHEN is_ip_literal THEN 'IP-literal link host (' || raw_url || ')' ELSE 'host of link ' || raw_url END FROM l),
d AS (SELECT *, row_number() OVER (PARTITION BY msg_id, type, value ORDER BY part, o, context) AS n FROM i WHERE value <> '')
"""


@_query(_IOC_SQL + "SELECT msg_id, type, value, context FROM d WHERE n = 1")
def ioc_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators of stored analyses, each once with its first context."""
    return _iocs(spark, folder).select("msg_id", "type", "value", "context")


@_query(_IOC_SQL + "SELECT type, count(*) AS n, count(DISTINCT value) AS different FROM d WHERE n = 1 GROUP BY type")
def ioc_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators by type."""
    return _iocs(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("different"))


@_query("SELECT id, 'CASE-' || upper(substr(id, 1, 8)) AS case_id FROM analyses")
def case_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Case ids (F18)."""
    return table(spark, folder, "analyses").select("id", iocs.case_id(F.col("id")).alias("case_id"))


# --- store -----------------------------------------------------------------------------------------------------------------


@_query("SELECT id, status, verdict, risk_score FROM analyses WHERE status = 'complete' AND spf_result = 'fail' ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25")
def list_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of complete analyses that failed SPF (Q1)."""
    columns = ["id", "status", "verdict", "risk_score", "created_at", "spf_result"]
    return store.page(table(spark, folder, "analyses"), columns, limit=25, offset=25, status="complete", spf_result="fail").select("id", "status", "verdict", "risk_score")


@_query("SELECT count(*) AS total FROM analyses WHERE status = 'complete' AND spf_result = 'fail'")
def list_total(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows the pages have (Q1)."""
    return store.total(table(spark, folder, "analyses"), status="complete", spf_result="fail")


@_query("SELECT id, verdict FROM analyses ORDER BY created_at DESC, id DESC LIMIT 8")
def recent_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """The eight newest."""
    return store.page(table(spark, folder, "analyses"), ["id", "verdict", "created_at"], limit=8).select("id", "verdict")


@_query(
    " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS key, count(*) AS n FROM analyses WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("status", "verdict", "spf_result", "dkim_result", "dmarc_result"))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'anomaly_{c}', {c}, count(*) FROM anomalies WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("type", "severity"))
)
def stats_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """All breakdowns, one pass over each table (Q2)."""
    of_analyses = store.breakdown(table(spark, folder, "analyses"), ["status", "verdict", "spf_result", "dkim_result", "dmarc_result"])
    of_anomalies = store.breakdown(table(spark, folder, "anomalies"), ["type", "severity"])
    return of_analyses.unionAll(of_anomalies.withColumn("dimension", F.concat(F.lit("anomaly_"), "dimension")))


@_query("SELECT count(*) AS n FROM analyses WHERE created_at >= TIMESTAMPTZ '2026-01-02 00:00:00+00' - INTERVAL 24 HOUR")
def stats_last_24h(spark: SparkSession, folder: str) -> DataFrame:
    """What was created since a day before an instant (Q3)."""
    return store.since(table(spark, folder, "analyses"), F.timestamp_seconds(F.lit(1767312000)))


@_query("SELECT count(*) AS total FROM analyses")
def stats_total(spark: SparkSession, folder: str) -> DataFrame:
    """All analyses (Q4)."""
    return store.total(table(spark, folder, "analyses"))


@_query("SELECT replace(type, '_', ' ') AS type, count(*) AS n FROM anomalies WHERE type IS NOT NULL GROUP BY anomalies.type ORDER BY n DESC, anomalies.type LIMIT 8")
def top_anomaly_types(spark: SparkSession, folder: str) -> DataFrame:
    """The eight most frequent anomalies."""
    return store.top_anomaly_types(table(spark, folder, "anomalies"))


@_query("SELECT count(*) FILTER (spf_result = 'fail') AS spf_fail, count(*) FILTER (dkim_result = 'fail') AS dkim_fail, count(*) FILTER (dmarc_result = 'fail') AS dmarc_fail FROM analyses")
def auth_fail_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Failed verdicts."""
    return store.auth_failures(table(spark, folder, "analyses"))


@_query(
    f"""WITH h AS (SELECT msg_id, string_agg(CAST(sequence AS VARCHAR) || ':' || coalesce(from_host, '-'), '|' ORDER BY sequence) AS hops FROM {_UNIQUE} GROUP BY 1),
a AS (SELECT analysis_id, string_agg(type || '/' || severity, '|' ORDER BY id) AS anomalies FROM anomalies GROUP BY 1)
SELECT id, filename, h.hops, a.anomalies FROM analyses LEFT JOIN h ON h.msg_id = id LEFT JOIN a ON a.analysis_id = id"""
)
def detail_assemble(spark: SparkSession, folder: str) -> DataFrame:
    """Analyses with their children in order (Q5-Q7)."""
    hops = _hops(spark, folder, "from_host", "from_ip", "by_host").withColumnRenamed("msg_id", "analysis_id")
    whole = store.details(table(spark, folder, "analyses").select("id", "filename"), hops, table(spark, folder, "anomalies"))
    h = F.array_join(F.transform("hops", lambda x: F.concat(x["sequence"].cast("string"), F.lit(":"), F.coalesce(x["from_host"], F.lit("-")))), "|")
    a = F.array_join(F.transform("anomalies", lambda x: F.concat(x["type"], F.lit("/"), x["severity"])), "|")
    return whole.select("id", "filename", h.alias("hops"), a.alias("anomalies"))


@_query("SELECT DISTINCT analysis_id, unnest(hop_sequences) AS sequence FROM anomalies")
def anomalous_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Hops named by anomalies (C4)."""
    return store.anomalous_hops(table(spark, folder, "anomalies"))


@_query(
    f"""WITH g AS (SELECT * FROM {_UNIQUE} WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT analysis_id, from_sequence, to_sequence FROM (SELECT msg_id AS analysis_id, lag(sequence) OVER (PARTITION BY msg_id ORDER BY sequence) AS from_sequence, sequence AS to_sequence FROM g) WHERE from_sequence IS NOT NULL"""
)
def geo_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines between neighbouring placed hops (C4)."""
    hops = _hops(spark, folder, "latitude", "longitude").withColumnRenamed("msg_id", "analysis_id")
    return store.geo_segments(hops).select("analysis_id", "from_sequence", "to_sequence")


@_query(
    f"""WITH g AS (SELECT *, min(longitude) OVER w - 5 AS x0, max(longitude) OVER w + 5 AS x1, min(latitude) OVER w - 5 AS y0, max(latitude) OVER w + 5 AS y1 FROM {_UNIQUE} WHERE latitude IS NOT NULL AND longitude IS NOT NULL WINDOW w AS (PARTITION BY msg_id))
SELECT msg_id AS analysis_id, sequence, round((longitude - x0) / (x1 - x0) * 500.0, 3) AS x, round((latitude - y0) / (y1 - y0) * 160.0, 3) AS y FROM g"""
)
def map_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Hops on a map of their chain."""
    return store.map_projection(_hops(spark, folder, "latitude", "longitude").withColumnRenamed("msg_id", "analysis_id"))


def _raw_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), F.coalesce(F.try_validate_utf8(F.col("raw_bytes").cast("string")), F.decode("raw_bytes", "ISO-8859-1"), F.lit("")).alias("raw"))


_FLAT = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


@_query(
    f"""WITH t AS (SELECT id, spf_result = 'fail' OR dkim_result = 'fail' OR dmarc_result = 'fail' AS failed, dkim_signature_expired AS expired, replace(regexp_extract(coalesce(decode(raw_bytes), ''), '(?s)^(.*?)(?:\\r?\\n\\r?\\n|$)', 1), chr(13) || chr(10), chr(10)) AS s FROM analyses),
p AS (SELECT id, failed, expired, list_filter(string_split(regexp_replace(s, '\\n(\\S)', chr(1) || '\\1', 'g'), chr(1)), lambda b: trim(b) <> '') AS blocks FROM t),
b AS (SELECT id, failed, expired, unnest(blocks) AS block, generate_subscripts(blocks, 1) - 1 AS position FROM p),
h AS (SELECT msg_id, list(DISTINCT {_FLAT.format(c='raw_header')}) AS named FROM hops_once JOIN (SELECT DISTINCT analysis_id, unnest(hop_sequences) AS sequence FROM anomalies) a ON a.analysis_id = msg_id AND a.sequence = hops_once.sequence GROUP BY msg_id),
r AS (SELECT b.id, position, block, CASE lower(split_part(block, ':', 1))
  WHEN 'received' THEN CASE WHEN len(list_filter(named, lambda x: contains({_FLAT.format(c='block')}, x) OR contains(x, {_FLAT.format(c='block')}))) > 0 THEN 'Hop flagged by relay-chain analysis' END
  WHEN 'authentication-results' THEN CASE WHEN failed THEN 'SPF, DKIM, or DMARC failed' END WHEN 'dkim-signature' THEN CASE WHEN expired THEN 'DKIM signature expired' END END AS reason FROM b LEFT JOIN h ON h.msg_id = b.id)
SELECT id AS msg_id, CAST(position AS INTEGER) AS position, block, reason IS NOT NULL AS suspicious, reason FROM r""".replace("hops_once JOIN", f"{_UNIQUE} hops_once JOIN")
)
def header_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of raw messages, folded lines together, with what is suspicious about them."""
    blocks = store.header_blocks(_raw_text(spark, folder), "raw")
    named = store.anomalous_hops(table(spark, folder, "anomalies")).withColumnRenamed("analysis_id", "msg_id")
    hops = _hops(spark, folder, "raw_header").join(named, ["msg_id", "sequence"], "left_semi").select("msg_id", "raw_header")
    verdicts = table(spark, folder, "analyses").select(F.col("id").alias("msg_id"), ((F.col("spf_result") == "fail") | (F.col("dkim_result") == "fail") | (F.col("dmarc_result") == "fail")).alias("auth_failed"), "dkim_signature_expired")
    return store.suspicious_headers(blocks, hops, verdicts)


# --- sources ------------------------------------------------------------------------------------------------------------------


@_query("SELECT id, sha256(raw_bytes) AS sha256 FROM analyses")
def message_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the raw bytes (H1)."""
    return table(spark, folder, "analyses").select("id", F.sha2("raw_bytes", 256).alias("sha256"))


@_query("SELECT id, CASE WHEN lower(filename) LIKE '%.msg' OR hex(raw_bytes) LIKE 'D0CF11E0A1B11AE1%' THEN 'msg' ELSE 'eml' END AS source_format FROM analyses")
def source_format(spark: SparkSession, folder: str) -> DataFrame:
    """Format by name or first bytes."""
    return raw.source_format(table(spark, folder, "analyses").select("id", "filename", F.col("raw_bytes").alias("content"))).select("id", "source_format")


@_query("SELECT CASE WHEN coalesce(octet_length(raw_bytes), 0) = 0 THEN 'empty file' WHEN octet_length(raw_bytes) > 400 THEN 'file too large' ELSE 'accepted' END AS reason, count(*) AS n FROM analyses GROUP BY ALL")
def upload_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected contents, here with 400 bytes as the most."""
    accepted, rejected = raw.validated(table(spark, folder, "analyses").select(F.col("raw_bytes").alias("content")), 400)
    return accepted.select(F.lit("accepted").alias("reason")).unionAll(rejected.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@_query()
def parse_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Raw bytes parsed."""
    stored = table(spark, folder, "analyses").select("id", "filename", F.col("raw_bytes").alias("content"))
    return raw.parse(stored, "id").select("msg_id", "source_format", "from_address", "date_raw", "date_parsed", "message_id", "content_type", "parse_confidence", F.size("issues").alias("issues"), F.length("body").alias("body_length"))


@_query("SELECT filename, octet_length(raw_bytes) AS size FROM analyses WHERE id = (SELECT min(id) FROM analyses)")
def raw_export(spark: SparkSession, folder: str) -> DataFrame:
    """The original bytes of an analysis."""
    analyses = table(spark, folder, "analyses")
    first = analyses.agg(F.min("id").alias("id"))
    return analyses.select("id", "filename", "raw_bytes").join(first, "id", "left_semi").select("filename", F.octet_length("raw_bytes").cast("bigint").alias("size"))


# --- models and training data ---------------------------------------------------------------------------------------------------


@_query("SELECT id, 'unavailable' AS phishing_source FROM analyses")
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier scores; without model files every source is unavailable (M1, M3, M4)."""
    texts = table(spark, folder, "analyses").select("id", F.coalesce("subject", F.lit("")).alias("text"))
    return models.phishing(texts, "id", "text", "").select("id", "phishing_source")


@_query("SELECT id, 'unavailable' AS ai_text_source FROM analyses")
def perplexity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity scores, the same way (M2)."""
    texts = table(spark, folder, "analyses").select("id", F.coalesce("subject", F.lit("")).alias("text"))
    return models.machine_text(texts, "id", "text", "").select("id", "ai_text_source")


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "analyses").select("subject", F.when(F.col("verdict") == "malicious", 1).when(F.col("verdict") == "clean", 0).alias("label"), "source_format")
    return dataprep.balanced_sample(labelled, "subject", "label", "source_format", per_class=100)


_SAMPLE_SQL = """
WITH r AS (SELECT DISTINCT subject AS text, CASE verdict WHEN 'malicious' THEN 1 WHEN 'clean' THEN 0 END AS label, coalesce(source_format, '') AS source FROM analyses WHERE length(subject) > 20 AND verdict IN ('malicious', 'clean')),
k AS (SELECT *, md5('42|' || source || '|' || text) AS key FROM r), s AS (SELECT label, count(DISTINCT source) AS sources FROM k GROUP BY label),
q AS (SELECT k.*, row_number() OVER (PARTITION BY label, source ORDER BY key, text) AS r FROM k),
o AS (SELECT q.*, row_number() OVER (PARTITION BY label ORDER BY key, text) AS p FROM q JOIN s USING (label) WHERE q.r <= 100 // sources + 1),
n AS (SELECT least(100, min(c)) AS n FROM (SELECT label, count(*) AS c FROM o GROUP BY label)),
b AS (SELECT text, label, source, key FROM o, n WHERE p <= n.n)
"""


@_query(_SAMPLE_SQL + "SELECT label, text, source FROM b")
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Equally many texts of each class, evenly from its sources (M6)."""
    return _sample(spark, folder).select("label", "text", "source")


@_query(
    _SAMPLE_SQL
    + """, i AS (SELECT *, row_number() OVER (ORDER BY key, label, text) AS i, count(*) OVER () AS n FROM b)
SELECT part, count(*) AS n FROM (SELECT CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS part FROM i) GROUP BY part"""
)
def split_70_15_15(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the parts (M6)."""
    return dataprep.split(_sample(spark, folder)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@_query(
    """WITH c AS (SELECT CASE WHEN verdict = 'malicious' THEN 1 ELSE 0 END AS t, CASE WHEN phishing_probability >= 0.5 THEN 1 ELSE 0 END AS p FROM analyses WHERE verdict IS NOT NULL AND phishing_probability IS NOT NULL),
m AS (SELECT count(*) FILTER (t = p) / count(*) AS a, count(*) FILTER (t = 1 AND p = 1) / count(*) FILTER (p = 1) AS pr, count(*) FILTER (t = 1 AND p = 1) / count(*) FILTER (t = 1) AS re FROM c)
SELECT round(a, 6) AS accuracy, round(pr, 6) AS "precision", round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM m"""
)
def classifier_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the stored probabilities against the stored verdicts (M7)."""
    return dataprep.metrics(table(spark, folder, "analyses"), F.col("verdict") == "malicious", F.col("phishing_probability") >= 0.5)


# --- exports -----------------------------------------------------------------------------------------------------------------------


@_query()
def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as JSON."""
    return reports.json_reports(_reports(spark, folder))


def _reports(spark: SparkSession, folder: str, found_iocs: DataFrame | None = None) -> DataFrame:
    messages, found = _factors(spark, folder)
    complete = table(spark, folder, "analyses").where("status = 'complete'").select(F.col("id").alias("msg_id"), *reports.FLAT_FIELDS, *reports.RECORDS, "created_at")
    odd = exports.numbered(_anomalies(spark, folder), "msg_id", "anomaly_id")
    return reports.assemble(complete, _hops(spark, folder, *reports.HOP_FIELDS), odd, found, scoring.risk(messages, found), _attribution(spark, folder), found_iocs)


@_query()
def report_text(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as text."""
    return reports.text_reports(_reports(spark, folder))


@_query()
def report_pdf(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as PDF."""
    wide = _reports(spark, folder, _iocs(spark, folder)).withColumn("case_id", iocs.case_id(F.col("msg_id")))
    return exports.pdf_reports(reports.case_reports(wide)).select("msg_id", F.octet_length("pdf").alias("size"))


def _uuid_sql(kind: str, text: str) -> str:
    d = f"sha1({text})"
    return f"'{kind}--' || substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-8' || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


_STIX_VALUE = "replace(replace(value, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39))"
_STIX_KINDS = {"ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "domain": "domain-name:value", "url": "url:value", "sha256": "file:hashes.''SHA-256''", "email": "email-addr:value"}
_STIX_PATTERN = "CASE type " + " ".join(f"WHEN '{k}' THEN '[{p} = ''' || {_STIX_VALUE} || ''']'" for k, p in _STIX_KINDS.items()) + " END"
_STIX_TIME = "'2026-01-01T00:00:00.000Z'"


@_query(
    _IOC_SQL
    + f"""SELECT msg_id, CAST(json_object('type', 'bundle', 'id', {_uuid_sql('bundle', "'bundle|' || msg_id")}, 'objects', list(json_object('type', 'indicator', 'spec_version', '2.1', 'id', {_uuid_sql('indicator', "'indicator|' || msg_id || '|' || type || '|' || value")},
 'created', {_STIX_TIME}, 'modified', {_STIX_TIME}, 'name', type || ': ' || value, 'description', '[CASE-' || upper(substr(msg_id, 1, 8)) || '] ' || context, 'indicator_types', ['malicious-activity'], 'pattern', {_STIX_PATTERN}, 'pattern_type', 'stix', 'valid_from', {_STIX_TIME}) ORDER BY part, o)) AS VARCHAR) AS bundle
FROM d WHERE n = 1 GROUP BY msg_id"""
)
def stix_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators as STIX 2.1 bundles."""
    return exports.stix_bundles(_iocs(spark, folder), iocs.case_id(F.col("msg_id")), F.timestamp_seconds(F.lit(1767225600)))


def _csv_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@_query(_IOC_SQL + f"SELECT msg_id, 'type,value,context' || chr(13) || chr(10) || string_agg({_csv_sql('type')} || ',' || {_csv_sql('value')} || ',' || {_csv_sql('context')}, chr(13) || chr(10) ORDER BY part, o) || chr(13) || chr(10) AS csv FROM d WHERE n = 1 GROUP BY msg_id")
def ioc_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators as CSV."""
    return exports.csv_texts(_iocs(spark, folder))
