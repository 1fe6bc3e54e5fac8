"""Whole reports of stored analyses: one nested record, as JSON or as readable text.

A stored record that is missing, broken or lacks a field is filled from the flat columns of the analysis.
Lists, and records stored as JSON text, are read as ``nested`` reads them; null elements are left out.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayscope.operators.nested import _DEPTH, AUTH_CHILDREN, META_CHILDREN, parse_record, unwrap

HOP_FIELDS = "sequence raw_header from_host from_ip by_host protocol timestamp_raw timestamp parse_confidence asn asn_org country city latitude longitude enrichment_source is_bogon".split()
META_FIELDS = "from_display_name from_address to_addresses subject date_raw date_parsed message_id return_path content_type has_attachments attachment_names attachments parse_confidence issues source_format sha256".split()
FLAT_FIELDS = "filename sha256 source_format parse_confidence from_display_name from_address subject spf_result dkim_result dmarc_result dmarc_policy dkim_signature_expired hop_count analyst_notes".split()
RECORDS = ("meta_json", "authentication_json", "sender_domain_intel_json", "ai_signals_json")
_RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def _grouped(df: DataFrame, name: str, order: list, *columns) -> DataFrame:
    shown = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*columns).alias("x"))
    return df.select("msg_id", shown.alias("s")).groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias(name))


def assemble(analyses: DataFrame, hops: DataFrame, anomalies: DataFrame, factors: DataFrame, risk: DataFrame, attribution: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    """One row per analysis with all that its report holds. ``analyses``: msg_id, FLAT_FIELDS, RECORDS, created_at."""
    fields = [F.unix_micros(c).alias(c) if c == "timestamp" else F.col(c) for c in HOP_FIELDS]
    wide = analyses.withColumn("created_at", F.unix_micros("created_at")).join(risk.select("msg_id", "score", "verdict"), "msg_id", "left")
    parts = [
        _grouped(hops, "hops", [F.col("sequence"), F.col("id")], *fields),
        _grouped(anomalies, "anomalies", [F.col("ordinal")], "type", "severity", "hop_sequences", "summary", "evidence"),
        _grouped(factors, "factors", [-F.col("weight"), F.col("part"), F.col("ordinal"), F.col("name")], "name", "weight", "evidence", "category"),
        attribution.select("msg_id", F.struct(*[c for c in attribution.columns if c != "msg_id"]).alias("attribution")),
    ]
    if iocs is not None:
        parts.append(_grouped(iocs, "iocs", [F.col("part"), F.col("ordinal")], "type", "value", "context"))
    for part in parts:
        wide = wide.join(part, "msg_id", "left")
    return wide


def _iso(micros: int | None) -> str | None:
    return None if micros is None else (_EPOCH + dt.timedelta(microseconds=micros)).isoformat()


def _clean(value: object) -> object:
    """Without numbers that JSON can't hold."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def _dumped(value: object) -> str:
    """As JSON, however deep the value is."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, _DEPTH))
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except ValueError:
        return json.dumps(_clean(value), ensure_ascii=False)
    finally:
        sys.setrecursionlimit(limit)


def _listed(value: object) -> list:
    value = unwrap(value)
    found = [unwrap(v) for v in (value if isinstance(value, list) else [value])]
    return [v for v in found if v is not None]


def _dict(value: object) -> dict:
    value = unwrap(value)
    return value if isinstance(value, dict) else {}


def _meta(row: dict) -> dict:
    held = {k: v for k, v in (parse_record(row["meta_json"]) or {}).items() if v is not None}
    meta = dict.fromkeys(META_FIELDS) | {k: row[k] for k in META_FIELDS if k in row} | held
    for key in (*META_CHILDREN, "attachment_names"):
        meta[key] = _listed(meta[key])
    meta["attachment_names"] = meta["attachment_names"] or [a["filename"] for a in meta["attachments"] if isinstance(a, dict) and a.get("filename")]
    if meta["has_attachments"] is None:
        meta["has_attachments"] = bool(meta["attachments"])
    return meta


def _authentication(row: dict) -> dict:
    held = parse_record(row["authentication_json"])
    if held is None:
        said = {m: row[f"{m}_result"] and {"mechanism": m, "result": row[f"{m}_result"], "reason": None, "domain": None, "raw_segment": None} for m in AUTH_CHILDREN}
        held = {**said, "source": "authentication-results-header" if any(said.values()) else "unavailable", "dmarc_policy": row["dmarc_policy"], "dkim_signature_expired": row["dkim_signature_expired"]}
    held = {k: v for k, v in held.items() if v is not None}
    for m in AUTH_CHILDREN:  # several results stay a list
        results = [r for r in _listed(held.get(m)) if isinstance(r, dict)]
        held[m] = results if len(results) > 1 else results[0] if results else None
    return {"raw_header": None, "dkim_signature_present": False, "dkim_signature_expired": False, "dkim_expiry": None, "dmarc_policy": "unknown", "source": "unavailable"} | held


def report(row: dict) -> dict:
    """The nested report of a row of ``assemble``."""
    signals = parse_record(row["ai_signals_json"])
    if signals is None:
        missing = {"source": "unavailable", "detail": "no signals stored"}
        signals = {"sender_domain_lookalike": None, "urls": {"urls": []}, "phishing": missing, "ai_text": missing}
    hops = [{**h, "timestamp": _iso(h["timestamp"])} for h in row["hops"] or []]
    return {
        "filename": row["filename"],
        "meta": _meta(row),
        "authentication": _authentication(row),
        "hops": hops,
        "anomalies": row["anomalies"] or [],
        "hop_count": len(hops) if row["hop_count"] is None else row["hop_count"],
        "risk": {"score": row["score"], "verdict": row["verdict"], "factors": row["factors"] or []},
        "sender_domain_intel": parse_record(row["sender_domain_intel_json"]),
        "ai_signals": signals,
        "attribution": row["attribution"],
        "generated_at": _iso(row["created_at"]),
    }


def _percent(value: object) -> str:
    return f"{value:.0%}" if isinstance(value, (int, float)) and math.isfinite(value) else "unknown"


def _section(lines: list[str], title: str) -> None:
    lines.append(f"\n== {title} " + "=" * max(0, 70 - len(title)))


def _named(*values: object) -> str:
    return ", ".join(str(v) for v in values)


def text(r: dict) -> str:
    """A report as text, section by section."""
    lines: list[str] = []
    m, a, risk = r["meta"], r["authentication"], r["risk"]
    verdict = str(risk["verdict"] or "unknown").upper()
    _section(lines, "TVA FORENSIC REPORT")
    lines += [f"file:              {r['filename']}", f"sha256:            {m['sha256']}", f"verdict:           {verdict}  (risk score {risk['score'] or 0}/100)", f"parse confidence:  {_percent(m['parse_confidence'])}"]
    if m["issues"]:
        lines.append(f"parse issues:      {len(m['issues'])}")
        lines += [f"  - [{i.get('field')}] {i.get('detail')}" if isinstance(i, dict) else f"  - {i}" for i in m["issues"]]

    _section(lines, "MESSAGE")
    lines += [f"from:        {m['from_display_name'] or ''} <{m['from_address'] or 'unknown'}>", f"to:          {_named(*m['to_addresses']) or 'unknown'}", f"subject:     {m['subject'] or ''}", f"date:        {m['date_raw'] or 'unknown'}"]
    lines += [f"message-id:  {m['message_id'] or 'unknown'}", f"attachments: {_named(*m['attachment_names']) if m['has_attachments'] else 'none'}"]

    _section(lines, "AUTHENTICATION (SPF / DKIM / DMARC)")
    if a["source"] == "unavailable":
        lines.append("no Authentication-Results header present -- unable to determine SPF/DKIM/DMARC")
    else:
        for mechanism in AUTH_CHILDREN:
            results = _listed(a[mechanism])
            for x in results:
                lines.append(f"{mechanism.upper():6s} {str(x.get('result') or 'unknown').upper()}" + (f" -- {x['reason']}" if x.get("reason") else ""))
            if not results:
                lines.append(f"{mechanism.upper():6s} unknown (not reported by boundary MTA)")
        lines.append(f"dmarc policy published: {a['dmarc_policy']}")
    if a["dkim_signature_present"]:
        lines.append(f"dkim signature:    present, {'EXPIRED' if a['dkim_signature_expired'] else 'not expired'}")

    _section(lines, f"RELAY CHAIN ({r['hop_count']} hops, earliest -> latest)")
    for h in r["hops"]:
        place = f"  [{h['city'] or '?'}, {h['country'] or '?'} | AS{h['asn'] or '?'} {h['asn_org'] or ''}]" if h["enrichment_source"] == "geolite2-local" else ""
        lines.append(f"  #{h['sequence']}  from={h['from_host'] or '?'} ({h['from_ip'] or 'no-ip'})  by={h['by_host'] or '?'}  with={h['protocol'] or '?'}  at={h['timestamp'] or h['timestamp_raw'] or 'unknown'}  conf={_percent(h['parse_confidence'])}{place}{'  [BOGON]' if h['is_bogon'] else ''}")
    if not r["hops"]:
        lines.append("no Received headers found")

    _section(lines, f"ANOMALIES ({len(r['anomalies'])})")
    for x in sorted(r["anomalies"], key=lambda x: _RANKS.get(x["severity"], 9)):
        lines += [f"  [{str(x['severity'] or 'unknown').upper():8s}] {x['type']}: {x['summary']}", f"             evidence: {x['evidence']}"]
    if not r["anomalies"]:
        lines.append("none detected")

    _section(lines, f"RISK SCORE: {risk['score'] or 0}/100 -- {verdict}")
    for x in risk["factors"]:
        lines += [f"  +{x['weight']:<3d} [{x['category']}] {x['name']}", f"             evidence: {x['evidence']}"]
    if not risk["factors"]:
        lines.append("no contributing factors -- nothing raised the score above zero")

    if di := r["sender_domain_intel"]:
        _section(lines, "SENDER DOMAIN INTEL")
        if di.get("source") in ("cached", "live"):
            lines.append(f"domain: {di.get('domain')}  age: {di.get('age_days')} days [{di['source']}]")
        else:
            lines.append(f"domain: {di.get('domain')}  age: unavailable ({di.get('detail') or 'no data'})")

    _section(lines, "AI & CONTENT SIGNALS (Phase 4)")
    phishing, sender, ai_text = (_dict(r["ai_signals"].get(k)) for k in ("phishing", "sender_domain_lookalike", "ai_text"))
    if phishing.get("source") == "onnx-model":
        lines.append(f"phishing classifier: {str(phishing.get('label') or '?').upper()} (p={_percent(phishing.get('phishing_probability') or 0.0)})")
    else:
        lines.append(f"phishing classifier: unavailable ({phishing.get('detail') or 'no model'})")
    matches = [_dict(x) for x in _listed(sender.get("matches"))]
    lines.append(f"sender domain lookalike matches ({sender.get('domain')}):" if matches else "sender domain lookalike: no matches")
    lines += [f"  - {x.get('matched_brand')} via {x.get('method')}: {x.get('detail')}" for x in matches]
    links = [_dict(u) for u in _listed(_dict(r["ai_signals"].get("urls")).get("urls"))]
    lines.append(f"links found: {len(links) or 'none'}")
    for u in links:
        like = [_dict(x) for x in _listed(_dict(u.get("lookalike")).get("matches"))]
        flags = ["IP-literal"] * bool(u.get("is_ip_literal")) + [f"anchor claims {u.get('anchor_claimed_domain')!r}"] * bool(u.get("anchor_text_mismatch"))
        flags += [f"unwraps to {u.get('unwrapped_target')}"] * bool(u.get("unwrapped_target")) + [f"lookalike for {x.get('matched_brand')}" for x in like[:1]]
        lines.append(f"  - {u.get('raw_url')}" + (f"  [{', '.join(flags)}]" if flags else ""))
    if ai_text.get("source") == "onnx-model":
        perplexity = ai_text.get("perplexity")
        shown = f"{perplexity:.1f}" if isinstance(perplexity, (int, float)) else "unknown"
        lines.append(f"ai-text perplexity: {shown}{' [worth a second look]' if ai_text.get('low_perplexity_flag') else ''} (weak, informational signal only)")
    else:
        lines.append(f"ai-text scoring: unavailable ({ai_text.get('detail') or 'no model'})")
    return "\n".join([*lines, ""])


def case_text(r: dict, row: dict) -> str:
    """The text with what the PDF has besides: custody, origin, indicators, notes."""
    lines: list[str] = []
    _section(lines, "CASE")
    lines += [f"case id:           {row['case_id']}", f"generated:         {r['generated_at']}", f"source format:     {r['meta']['source_format']}"]
    lines.append(text(r))
    o = r["attribution"] or {}
    _section(lines, "ORIGIN ATTRIBUTION")
    lines.append(f"confidence: {str(o.get('confidence') or 'unknown').upper()}")
    if o.get("origin_ip"):
        lines.append(f"candidate origin ip: {o['origin_ip']} (relay hop #{o['origin_hop_sequence']})")
    if o.get("asn_org"):
        lines.append(f"network: {o['asn_org']} (AS{o['asn']}), {o['country'] or 'unknown country'}")
    lines.append(f"reasoning: {o.get('reasoning')}")
    found = row["iocs"] or []
    _section(lines, f"INDICATORS OF COMPROMISE ({len(found)})")
    lines += [f"  {x['type']}  {x['value']}  {x['context']}" for x in found] or ["no indicators extracted"]
    _section(lines, "ANALYST NOTES")
    return "\n".join([*lines, row["analyst_notes"] or "no notes recorded", ""])


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, as a report takes up far more room in Python than its row."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _rendered(wide: DataFrame, render: Callable[[dict], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            rows = part.to_pylist()
            made = [render(r).encode("utf-8", "replace").decode() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["msg_id"] for r in rows], pa.string()), pa.array(made, pa.string())], names=["msg_id", "report"])

    return wide.mapInArrow(run, "msg_id string, report string")


def json_reports(wide: DataFrame) -> DataFrame:
    """msg_id and the report as JSON."""
    return _rendered(wide, lambda row: _dumped(report(row)))


def text_reports(wide: DataFrame) -> DataFrame:
    """msg_id and the report as text."""
    return _rendered(wide, lambda row: text(report(row)))


def case_reports(wide: DataFrame) -> DataFrame:
    """msg_id and the text of the PDF. Of rows with ``iocs`` and ``case_id``."""
    return _rendered(wide, lambda row: case_text(report(row), row))
