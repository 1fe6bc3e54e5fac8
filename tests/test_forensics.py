import datetime as dt
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from relayscope.functions.net import is_bogon, is_ip, organisation_domain
from relayscope.operators import anomalies, attribution, auth, geo, iocs, lookalike, relay, scoring, urls
from relayscope.plans import forensics


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def at(*x):
    return dt.datetime(*x)


HEADER = "mx.a.test;\r\n\tspf=SoftFail (not ok) smtp.mailfrom=u@m.test; dkim=bogus header.d=d.test; SPF=pass; dmarc=fail (p=reject sp=none) header.from=f.test; dmarc=pass"


def test_auth(spark):
    df = spark.createDataFrame([(HEADER, 1), (None, 2), ("", 3)], "h string, source int")
    rows = auth.parse(df.drop("source"), "h").collect()
    r = rows[0]
    assert (r["spf_result"], r["dkim_result"], r["dmarc_result"], r["dmarc_policy"]) == ("softfail", "unknown", "fail", "reject")
    assert (r["spf_reason"], r["spf_domain"], r["dkim_domain"], r["dmarc_domain"]) == ("not ok", "m.test", "d.test", "f.test")
    assert (rows[1]["source"], rows[1]["spf_result"], rows[1]["dmarc_policy"]) == ("unavailable", None, "unknown")
    assert rows[2]["spf_result"] is None


def test_dkim_tags_and_expiry(spark):
    df = spark.createDataFrame([("a=1; x=100; X = 200 ;b=c=d", at(2024, 1, 1)), ("x=soon", at(2024, 1, 1)), (None, None), ("x=99999999999", None)], "s string, t timestamp")
    rows = auth.dkim_expiry(df, "s", "t").collect()
    assert [r["dkim_signature_expired"] for r in rows] == [True, False, False, False]
    assert [r["dkim_signature_present"] for r in rows] == [True, True, False, True]
    assert one(spark, "a=1; x=100; X = 200 ;b=c=d", auth.dkim_tags) == {"a": "1", "x": "200", "b": "c=d"}


def test_hops(spark):
    heads = ["from b.test (b.test [198.51.100.7]) by c.test with ESMTP; Tue, 2 Jan 2024 10:00:05 +0000", "FROM a.test, (10.0.0.1 999.1.1.1)\r\n\tby b.test;;  bad date", "by x.test", "nothing"]
    df = spark.createDataFrame([("m", heads), ("e", []), ("n", None)], "msg_id string, received array<string>")
    rows = {r["sequence"]: r for r in relay.parse_hops(relay.chain(df, "received")).collect()}
    assert len(rows) == 4 and rows[3]["from_ip"] == "198.51.100.7" and rows[3]["protocol"] == "ESMTP"
    assert rows[3]["timestamp"] == at(2024, 1, 2, 10, 0, 5) and rows[3]["parse_confidence"] == 1.0
    assert (rows[2]["from_host"], rows[2]["from_ip"], rows[2]["timestamp_raw"], rows[2]["timestamp"], rows[2]["parse_confidence"]) == ("a.test", "10.0.0.1", "bad date", None, 0.67)
    assert (rows[1]["by_host"], rows[1]["parse_confidence"]) == ("x.test", 0.33)
    assert rows[0]["parse_confidence"] == 0.0


@pytest.mark.parametrize(("ip", "want"), [("10.1.2.3", True), ("172.32.0.1", False), ("198.51.100.1", False), ("169.254.1.1", True), ("100.64.0.1", False), ("224.0.0.1", True), ("255.255.255.255", True), ("8.8.8.8", False), ("::1", True), ("fe80::1", True), ("2001:db8::1", False), ("2606:4700::1", False), ("1.2.3", False), ("01.2.3.4", False), (None, False), ("", False), ("x:y", False)])
def test_bogons(spark, ip, want):
    assert one(spark, ip, is_bogon) is want


def test_hosts_and_ips(spark):
    assert one(spark, "A.B.Example.COM..", organisation_domain) == "example.com"
    assert one(spark, "localhost", organisation_domain) == "localhost"
    assert one(spark, "::1", is_ip) and one(spark, "1.2.3.4", is_ip) and not one(spark, "a.b", is_ip)


HOPS = [
    ("m", 0, at(2024, 1, 1, 10), "10.0.0.1", "a.x.test", "b.x.test"),
    ("m", 1, at(2024, 1, 1, 9), "10.0.0.1", "B.X.test.", "c.y.test"),
    ("m", 2, None, None, None, "c.y.test"),
    ("m", 3, at(2024, 1, 1, 20), "198.51.100.1", "z.test", "C.Y.test."),
    ("m", 4, at(1980, 1, 1), "198.51.100.1", "c.y.test", None),
]
HOP_SCHEMA = "msg_id string, sequence int, timestamp timestamp, from_ip string, from_host string, by_host string"


def test_anomaly_rules(spark):
    rows = anomalies.detect(spark.createDataFrame(HOPS, HOP_SCHEMA)).orderBy("ordinal").collect()
    assert [(r["type"], r["hop_sequences"]) for r in rows] == [
        ("impossible_timestamp", [4]),
        ("negative_time_delta", [0, 1]),
        ("negative_time_delta", [3, 4]),
        ("bogon_ip_in_path", [1]),
        ("forged_internal_origin", [1, 2, 3]),
        ("forged_internal_origin", [2, 3]),
    ]
    assert all(r["evidence"] and r["summary"] for r in rows)


def test_long_chain_and_gap(spark):
    hops = [("l", i, at(2024, 1, 1 + i), None, None, None) for i in range(9)]
    rows = anomalies.detect(spark.createDataFrame(hops, HOP_SCHEMA)).collect()
    assert sorted({r["type"] for r in rows}) == ["hop_count_outlier", "large_timezone_jump"] and len(rows) == 9
    exact = [("g", 0, at(2024, 1, 1, 0), None, None, None), ("g", 1, at(2024, 1, 1, 6), None, None, None)]
    assert anomalies.large_gap(spark.createDataFrame(exact, HOP_SCHEMA)).count() == 0


def test_times_do_not_depend_on_the_session_zone(spark):
    heads = spark.createDataFrame([("by a; Sun, 31 Dec 1989 23:30:00 -0100",), ("by a; Mon, 1 Jan 1990 00:30:00 +0100",), ("by a; Fri, 1 Jan 1601 00:00:00 +0000",)], "raw_header string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    got = []
    try:
        for z in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", z)
            hops = relay.parse_hops(heads).select(F.lit("m").alias("msg_id"), F.lit(0).alias("sequence"), "timestamp")
            got.append([(r["u"]) for r in hops.select(F.unix_seconds("timestamp").alias("u")).collect()] + sorted(r["evidence"] for r in anomalies.impossible_timestamp(hops).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got[0] == got[1] == got[2] and got[0][:2] == [631153800, 631150200] and len(got[0]) == 5


def test_no_rule_fires_on_nothing(spark):
    assert anomalies.detect(spark.createDataFrame([], HOP_SCHEMA)).count() == 0


def test_highest_severity(spark):
    df = spark.createDataFrame([("a", "low"), ("a", "critical"), ("b", "info"), ("c", None)], "msg_id string, severity string")
    assert {r[0]: r[1] for r in anomalies.highest_severity(df).collect()} == {"a": "critical", "b": "info", "c": None}


def test_lookalikes(spark):
    names = ["paypai.com", "PayPal.com.", "micr0soft-online.com", "g00gle.com", "xn--pypal-4ve.com", "apple.test", "paypal-login.net", "github.community", None, "", "paypai.com"]
    df = spark.createDataFrame([(n,) for n in names], "d string")
    got = {(r["domain"], r["brand"], r["method"]) for r in lookalike.matches(df, "d").collect()}
    assert ("paypai.com", "paypal.com", "levenshtein") in got
    assert ("micr0soft-online.com", "microsoft.com", "brand_substring") in got
    assert ("g00gle.com", "google.com", "homoglyph_skeleton") in got
    assert ("xn--pypal-4ve.com", "paypal.com", "homoglyph_skeleton") in got
    assert ("paypal-login.net", "paypal.com", "brand_substring") in got
    assert ("github.community", "github.com", "jaro_winkler") in got
    assert not [g for g in got if g[0] in ("paypal.com", "apple.test")]


def test_jaro_winkler():
    jw = lookalike.jaro_winkler_similarity
    assert round(jw("MARTHA", "MARHTA"), 4) == 0.9611 and round(jw("abcd", "abxyzq"), 4) == 0.6111
    assert jw("", "") == 1.0 and jw("", "a") == 0.0 and jw("ab", "cd") == 0.0


def test_html_links():
    text = '<a href=" HTTP://a.test/x ">Sign <b>in</b></a><a href="mailto:q@t">m</a> https://b.test/y. <a href="HTTP://a.test/x">again</a><script>var</script>'
    assert urls.html_links(text) == [("HTTP://a.test/x", "Signin"), ("https://b.test/y.", None)]
    assert urls.html_links("") == [] and urls.html_links("<a href>") == []
    assert urls.html_links("<A HREF='http://q.test/?a=1&amp;b=2'>x</A><script>https://s.test</script><!-- https://c.test") == [("http://q.test/?a=1&b=2", "x")]
    assert urls.html_links('<a title="a>b" href=https://u.test/p>t</a> 1 < 2 https://v.test') == [("https://u.test/p", "t"), ("https://v.test", None)]
    for part in ("<", "<a ", '<a "', "<!--", "<script>", '<a href="http://x.t/'):
        urls.html_links((part * 100_000)[:200_000])


def test_url_parts(spark):
    rows = [("https://u:p@Host.Test:8/x", None), ("http://[::1]/", None), ("http://185.1.1.1/x?next=aHR0cDovL2EudGVzdC9z", "see www.b.test"), ("https://a.test/?u=http%3A%2F%2Fz.test", "a.test"), (None, None), ("https://pay.b.test/", "b.test here")]
    got = urls.analyse(spark.createDataFrame(rows, "raw_url string, anchor_text string")).collect()
    assert [r["host"] for r in got] == ["host.test", "::1", "185.1.1.1", "a.test", None, "pay.b.test"]
    assert [r["is_ip_literal"] for r in got] == [False, True, True, False, False, False]
    assert [r["unwrapped_target"] for r in got] == [None, None, "http://a.test/s", "http://z.test", None, None]
    assert [r["anchor_text_mismatch"] for r in got] == [False, False, True, False, False, False]


def test_domain_age_is_three_valued(spark):
    intel = spark.createDataFrame([("New.test", at(2024, 1, 1)), ("old.test", at(2000, 1, 1)), (None, None)], "domain string, registration_date timestamp")
    df = spark.createDataFrame([("new.test.",), ("old.test",), ("none.test",), (None,)], "d string")
    got = {r["d"]: (r["is_newly_registered"], r["intel_source"]) for r in urls.domain_ages(df, "d", intel, F.lit("2024-01-20").cast("timestamp")).collect()}
    assert got == {"new.test.": (True, "cached"), "old.test": (False, "cached"), "none.test": (None, "unavailable"), None: (None, "unavailable")}


def test_scoring(spark):
    m = spark.createDataFrame([("a", "fail", "fail", "fail", "reject"), ("b", "pass", "pass", "pass", "unknown"), ("c", None, None, None, None), ("d", "fail", "none", "fail", "reject")], "msg_id string, spf_result string, dkim_result string, dmarc_result string, dmarc_policy string")
    odd = spark.createDataFrame([("a", i, "critical", "s", "e") for i in range(3)] + [("b", 0, "info", "s", "e"), ("b", 1, None, "s", "e")], "msg_id string, ordinal int, severity string, summary string, evidence string")
    factors = scoring.union([scoring.auth_factors(m), scoring.anomaly_factors(odd)])
    got = {r["msg_id"]: (r["score"], r["verdict"], r["factors"]) for r in scoring.risk(m, factors).collect()}
    assert got == {"a": (100, "malicious", 6), "b": (0, "clean", 0), "c": (0, "clean", 0), "d": (63, "suspicious", 3)}
    ranks = scoring.ranked(factors).where("msg_id = 'a'").orderBy("rank").collect()
    assert [r["weight"] for r in ranks] == [35, 30, 30, 30, 20, 20] and [r["name"] for r in ranks][-2:] == ["SPF fail", "DKIM fail"]


def test_content_factors(spark):
    s = spark.createDataFrame([("a", "onnx-model", 0.7, "onnx-model", True), ("b", "onnx-model", 0.69, "text-too-short", True), ("c", "unavailable", None, "unavailable", None)], "msg_id string, phishing_source string, phishing_probability double, ai_text_source string, low_perplexity_flag boolean")
    assert {(r["msg_id"], r["weight"]) for r in scoring.phishing_factors(s).unionAll(scoring.ai_text_factors(s)).collect()} == {("a", 25), ("a", 5)}
    like = spark.createDataFrame([("a", 0, "xn--x", True, "p", "levenshtein", "d"), ("a", 1, "xn--x", True, "q", "jaro_winkler", "d"), ("b", 0, "y", False, "p", "other", "d")], "msg_id string, ordinal int, domain string, is_punycode boolean, brand string, method string, detail string")
    assert sorted(r["weight"] for r in scoring.lookalike_factors(like, "sender").collect()) == [10, 15, 20]


def test_attribution(spark):
    hops = spark.createDataFrame([("a", 0, "10.0.0.1", "x", True, "unavailable", None, None, None), ("a", 1, "8.8.8.8", None, False, "geolite2-local", 1, "Net", "US"), ("b", 0, "9.9.9.9", "h", False, "unavailable", None, None, None), ("c", 0, None, None, False, None, None, None, None)], "msg_id string, sequence int, from_ip string, from_host string, is_bogon boolean, enrichment_source string, asn int, asn_org string, country string")
    odd = spark.createDataFrame([("a", "forged_internal_origin", [2, 3]), ("b", "negative_time_delta", [0, 1]), ("b", "bogon_ip_in_path", [0])], "msg_id string, type string, hop_sequences array<int>")
    m = spark.createDataFrame([("a", "fail"), ("b", "pass"), ("c", None), ("d", None)], "msg_id string, spf_result string")
    got = {r["msg_id"]: r for r in attribution.attribute(m, hops, odd).collect()}
    assert {k: (r["confidence"], r["origin_ip"]) for k, r in got.items()} == {"a": ("high", "8.8.8.8"), "b": ("low", "9.9.9.9"), "c": ("unknown", None), "d": ("unknown", None)}
    assert "SPF failed" in got["a"]["reasoning"] and "capped" in got["b"]["reasoning"] and got["c"]["source"] == "unavailable"


def test_iocs_first_context_wins(spark):
    m = spark.createDataFrame([("a", "x@t"), ("b", None)], "msg_id string, from_address string")
    hops = spark.createDataFrame([("a", 0, "1.1.1.1", "h.test", "r.test"), ("a", 1, "1.1.1.1", "r.test", ""), ("a", 2, "::1", None, "H.test")], "msg_id string, sequence int, from_ip string, from_host string, by_host string")
    links = spark.createDataFrame([("a", 0, "http://r.test/", "r.test", False, "http://z.test"), ("a", 1, "http://1.1.1.1/", "1.1.1.1", True, None)], "msg_id string, ordinal int, raw_url string, host string, is_ip_literal boolean, unwrapped_target string")
    files = spark.createDataFrame([("a", 0, "f.pdf", "application/pdf", 3, "abc")], "msg_id string, ordinal int, filename string, content_type string, size_bytes long, sha256 string")
    rows = iocs.extract(m, hops, files, links).orderBy("part", "ordinal").collect()
    assert [(r["type"], r["value"]) for r in rows] == [("email", "x@t"), ("ipv4", "1.1.1.1"), ("domain", "h.test"), ("domain", "r.test"), ("ipv6", "::1"), ("domain", "H.test"), ("sha256", "abc"), ("url", "http://r.test/"), ("url", "http://z.test"), ("url", "http://1.1.1.1/")]
    assert rows[3]["context"] == "relay hop #0 receiving hostname"


def test_range_join(spark):
    ranges = spark.createDataFrame([(0, 2**32 - 1, "all"), (16777216, 33554431, "one"), (16843008, 16843263, "inner"), (5, 1, "empty")], "low long, high long, network string")
    df = spark.createDataFrame([(x, "clash") for x in ("1.1.1.5", "1.1.1.5", "1.9.9.9", "9.9.9.9", "bad", None)], "ip string, network string")
    rows = [(r["ip"], r["network"]) for r in geo.range_join(df, "ip", ranges, ["network"]).collect()]
    assert sorted(rows, key=str) == sorted([("1.1.1.5", "inner"), ("1.1.1.5", "inner"), ("1.9.9.9", "one"), ("9.9.9.9", "all"), ("bad", None), (None, None)], key=str)


def test_enrichment_leaves_bogons_alone(spark):
    hops = spark.createDataFrame([("1.1.1.1", False), ("10.0.0.1", True), (None, False)], "from_ip string, is_bogon boolean")
    nets = spark.createDataFrame([(0, 2**32 - 1, 7, "Net")], "low long, high long, asn int, asn_org string")
    got = {r["from_ip"]: (r["asn"], r["enrichment_source"]) for r in geo.enrich(hops, None, nets).collect()}
    assert got == {"1.1.1.1": (7, "geolite2-local"), "10.0.0.1": (None, "unavailable"), None: (None, "unavailable")}


def test_expiry_of_any_length(spark):
    rows = [("a", "v=1; x=17000000000000"), ("b", "v=1; x=" + "9" * 60), ("c", "v=1; x=00000000000000000001"), ("d", "v=1; x=-5"), ("e", "v=1; x=")]
    df = spark.createDataFrame(rows, "id string, s string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = {r["id"]: (r["dkim_signature_expired"], r["e"]) for r in auth.dkim_expiry(df, "s", "at").withColumn("e", F.unix_seconds("dkim_expiry")).collect()}
    assert got == {"a": (False, 253402300799), "b": (False, 253402300799), "c": (True, 1), "d": (False, None), "e": (False, None)}


def test_links_of_stored_signals_are_scored_with_their_lookalikes(spark):
    link = {"raw_url": "https://paypai.com/x", "host": "paypai.com", "anchor_claimed_domain": "paypal.com", "anchor_text_mismatch": True, "is_newly_registered": True, "domain_intel": {"age_days": 3}, "lookalike": {"domain": "paypai.com", "is_punycode": True, "matches": [{"matched_brand": "paypal.com", "method": "levenshtein", "detail": "d"}, {"matched_brand": "x.com", "method": "brand_substring", "detail": "e"}]}}
    signals = {"urls": {"urls": [{"raw_url": "http://1.1.1.1/", "is_ip_literal": True}, link]}}
    df = spark.createDataFrame([("m", json.dumps(signals)), ("n", None), ("o", "{}")], "msg_id string, j string").select("msg_id", F.from_json("j", forensics._SIGNALS).alias("s"))
    got = scoring.ranked(scoring.signal_factors(df)).orderBy("part", "ordinal").collect()
    assert [(r["msg_id"], r["part"], r["name"], r["weight"], r["evidence"]) for r in got] == [
        ("m", 6, "Link uses a bare IP address instead of a domain", 12, "http://1.1.1.1/"),
        ("m", 6, "Link text claims a different domain than its destination", 10, "anchor text claims 'paypal.com', actual destination is 'paypai.com' (https://paypai.com/x)"),
        ("m", 6, "Link points to a newly registered domain", 15, "paypai.com registered 3 days ago"),
        ("m", 7, "Link to paypai.com looks like paypal.com", 12, "d"),
        ("m", 7, "Link to paypai.com looks like x.com", 12, "e"),
        ("m", 7, "Link to paypai.com uses punycode/IDN encoding", 10, "paypai.com"),
    ]


def test_brands_from_a_file_and_a_table(spark, tmp_path):
    (tmp_path / "brands.yaml").write_text("# trusted\n- PayPal.com\n- 'docusign.com'  # signing\n\nzoom.us\n")
    brands = lookalike.read_brands(spark, str(tmp_path / "brands.yaml"))
    assert lookalike.brand_list(brands) == ["docusign.com", "paypal.com", "zoom.us"]
    domains = spark.createDataFrame([("paypai.com",), (None,), ("zoom.us",)], "domain string")
    assert [(r["domain"], r["brand"]) for r in lookalike.matches(domains, "domain", brands).collect()] == [("paypai.com", "paypal.com")]
    with pytest.raises(ValueError):
        lookalike.brand_list(spark.range(10_001).selectExpr("concat(id, '.t') AS b"))


def test_ranges_of_ipv6(spark):
    rng = random.Random(4)
    ranges = [("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "doc"), ("2001:db8:1::", "2001:db8:1:ffff:ffff:ffff:ffff:ffff", "one"), ("2001:db8:1::5", "2001:db8:1::5", "host"), ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "all"), ("1.2.0.0", "1.2.255.255", "four"), ("::", "1.2.3.4", "no"), ("x", "y", "no"), (None, None, "no")]
    ranges += [(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(a + (1 << k) - 1)), f"r{i}") for i in range(60) for k in [rng.randrange(20, 110)] for a in [((0x2600 << 112) | rng.getrandbits(108)) >> k << k]]
    ips = ["2001:db8::1", "2001:DB8:1::5", "2001:db8:1::6", "2a00::1", "fe80::1%eth0", "1.2.3.4", "9.9.9.9", None, "", "::ffff:1.2.3.4", "zz::"] + [str(ipaddress.IPv6Address((0x2600 << 112) | rng.getrandbits(108))) for _ in range(200)] + [r[0] for r in ranges[8:]]

    def brute(ip):
        try:
            at = ipaddress.ip_address((ip or "").split("%")[0])
        except ValueError:
            return None
        inside = []
        for low, high, name in ranges:
            try:
                low, high = ipaddress.ip_address(low or ""), ipaddress.ip_address(high or "")
            except ValueError:
                continue
            if low.version == high.version == at.version and low <= at <= high:
                inside.append((int(high) - int(low), int(low), name))
        return min(inside)[2] if inside else None

    df = spark.createDataFrame([(i, ip, "clash") for i, ip in enumerate(ips)], "i int, ip string, name string")
    got = {r["i"]: r["name"] for r in geo.range_join(df, "ip", spark.createDataFrame(ranges, "low string, high string, name string"), ["name"]).collect()}
    assert got == {i: brute(ip) for i, ip in enumerate(ips)}


def test_no_similar_domain_is_left_out(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abpyl.-", k=rng.randrange(3, 14))) for _ in range(40)] + ["paypal.com", "apypal.com", "paypla.com", "payapl.com", "moc.lapyap"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    rows = pairs.select("a", "b", lookalike._most_similar("a", "b").alias("most")).collect()
    assert all(lookalike.jaro_winkler_similarity(r["a"], r["b"]) <= r["most"] + 1e-9 for r in rows) and sum(r["most"] < 0.92 for r in rows) > 500
