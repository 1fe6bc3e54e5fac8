import json

import __spark_entry__ as entry
from relayscope.operators import reports

PARTS = ["filename", "meta", "authentication", "hops", "anomalies", "hop_count", "risk", "sender_domain_intel", "ai_signals", "attribution", "generated_at"]


def test_json_reports_hold_the_whole_report(spark, small):
    analyses = {r["id"]: r for r in spark.read.parquet(f"{small}/analyses.parquet").where("status = 'complete'").collect()}
    hops = {r["analysis_id"]: r["n"] for r in spark.read.parquet(f"{small}/hops.parquet").selectExpr("id", "analysis_id").distinct().groupBy("analysis_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    odd = {r["analysis_id"]: r["count"] for r in spark.read.parquet(f"{small}/anomalies.parquet").groupBy("analysis_id").count().collect()}
    risk = {r["msg_id"]: r for r in entry.queries()["risk_score"](spark, small).collect()}
    got = {r["msg_id"]: json.loads(r["report"]) for r in entry.queries()["report_json"](spark, small).collect()}
    assert set(got) == set(analyses)
    for i, r in got.items():
        assert list(r) == PARTS
        assert (len(r["hops"]), len(r["anomalies"])) == (hops.get(i, 0), odd.get(i, 0))
        assert (r["risk"]["score"], r["risk"]["verdict"]) == (risk[i]["score"], risk[i]["verdict"])
        assert min(100, sum(f["weight"] for f in r["risk"]["factors"])) == r["risk"]["score"]
        assert r["attribution"]["reasoning"] and r["meta"]["sha256"] and [h["sequence"] for h in r["hops"]] == sorted(h["sequence"] for h in r["hops"])


def test_text_reports_have_all_sections(spark, small):
    made = {r["msg_id"]: json.loads(r["report"]) for r in entry.queries()["report_json"](spark, small).collect()}
    texts = {r["msg_id"]: r["report"] for r in entry.queries()["report_text"](spark, small).collect()}
    assert set(texts) == set(made)
    for i, r in made.items():
        for title in ("TVA FORENSIC REPORT", "MESSAGE", "AUTHENTICATION", "RELAY CHAIN", "ANOMALIES", "RISK SCORE", "AI & CONTENT SIGNALS"):
            assert f"\n== {title}" in texts[i]
        assert ("== SENDER DOMAIN INTEL" in texts[i]) == bool(r["sender_domain_intel"])
        assert texts[i].count("evidence: ") >= len(r["anomalies"]) + len(r["risk"]["factors"])
        assert all(str(x) in texts[i] for x in [*r["meta"]["to_addresses"], *r["meta"]["attachment_names"]] if r["meta"]["has_attachments"] or "@" in str(x))


def test_broken_and_odd_records():
    row = dict.fromkeys(["msg_id", "created_at", "score", "verdict", "hops", "anomalies", "factors", "attribution", "iocs", "case_id", *reports.FLAT_FIELDS, *reports.RECORDS])
    row |= {"from_address": "x@t", "spf_result": "fail", "meta_json": "{", "created_at": 0}
    r = reports.report(row)
    assert r["meta"]["from_address"] == "x@t" and r["authentication"]["spf"]["result"] == "fail" and r["generated_at"] == "1970-01-01T00:00:00+00:00"
    assert "<x@t>" in reports.text(r) and "SPF    FAIL" in reports.text(r)
    a = {"filename": "a.pdf", "sha256": "aa"}
    row["meta_json"] = json.dumps(json.dumps({"attachments": json.dumps([a]), "to_addresses": "y@t", "issues": {"field": "f", "detail": "d"}, "parse_confidence": "odd"}))
    row["authentication_json"] = json.dumps({"source": "authentication-results-header", "dkim": [{"result": "fail", "reason": "bad"}, None, {"result": "none"}]})
    row["ai_signals_json"] = json.dumps({"urls": {"urls": [{"raw_url": "http://u", "is_ip_literal": True, "unwrapped_target": "http://v"}]}, "phishing": None})
    row["analyst_notes"], row["iocs"] = "note", [{"type": "url", "value": "http://u", "context": "c"}]
    text = reports.case_text(reports.report(row), row)
    for part in ("to:          y@t", "attachments: a.pdf", "[f] d", "DKIM   FAIL -- bad", "DKIM   NONE", "http://u  [IP-literal, unwraps to http://v]", "INDICATORS OF COMPROMISE (1)", "url  http://u  c", "note", "ORIGIN ATTRIBUTION"):
        assert part in text


def test_deep_records_are_written():
    row = dict.fromkeys([*reports.FLAT_FIELDS, *reports.RECORDS, "created_at", "hops", "anomalies", "factors", "score", "verdict", "attribution", "iocs", "msg_id"])
    for end in ("1", "1e999"):
        row["meta_json"] = '{"a":' * 3000 + end + "}" * 3000
        assert '{"a": {"a": ' in reports._dumped(reports.report(row))
