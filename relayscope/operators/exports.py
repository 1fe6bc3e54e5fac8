"""Reports and indicators in forms to hand on. Identifiers and times are derived, so equal input gives equal output."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayscope.operators.reports import parts_of

# fixed values: STIX patterns of the kinds of indicators
_PATTERNS = {
    "ipv4": "[ipv4-addr:value = '{}']",
    "ipv6": "[ipv6-addr:value = '{}']",
    "domain": "[domain-name:value = '{}']",
    "url": "[url:value = '{}']",
    "sha256": "[file:hashes.'SHA-256' = '{}']",
    "email": "[email-addr:value = '{}']",
}
_SEVERITIES = ("critical", "high", "medium", "low", "info")


def report_json(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and the report as one JSON text; nulls are kept."""
    return df.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("report"))


def _uuid(kind: str, *parts: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", F.lit(kind), *parts))
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit(kind + "--"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12))


def stix_pattern(kind: Column, value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    out = F.lit(None).cast("string")
    for name, pattern in _PATTERNS.items():
        head, tail = pattern.split("{}")
        out = F.when(kind == name, F.concat(F.lit(head), escaped, F.lit(tail))).otherwise(out)
    return out


def stix_bundles(iocs: DataFrame, case: Column, created: Column) -> DataFrame:
    """msg_id and a STIX 2.1 bundle of its indicators as JSON."""
    stamp = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    indicator = F.struct(
        F.lit("indicator").alias("type"),
        F.lit("2.1").alias("spec_version"),
        _uuid("indicator", F.col("msg_id"), F.col("type"), F.col("value")).alias("id"),
        stamp.alias("created"),
        stamp.alias("modified"),
        F.concat_ws(": ", "type", "value").alias("name"),
        F.concat(F.lit("["), case, F.lit("] "), F.col("context")).alias("description"),
        F.array(F.lit("malicious-activity")).alias("indicator_types"),
        stix_pattern(F.col("type"), F.col("value")).alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        stamp.alias("valid_from"),
    )
    grouped = iocs.select("msg_id", F.struct("part", "ordinal", indicator.alias("o")).alias("x")).groupBy("msg_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("msg_id", F.to_json(F.struct(F.lit("bundle").alias("type"), _uuid("bundle", F.col("msg_id")).alias("id"), F.transform("xs", lambda x: x["o"]).alias("objects"))).alias("bundle"))


def _csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_texts(iocs: DataFrame) -> DataFrame:
    """msg_id and its indicators as CSV with a header line, minimal quoting and CRLF."""
    line = F.concat_ws(",", *[_csv_field(F.col(c)) for c in ("type", "value", "context")])
    grouped = iocs.select("msg_id", F.struct("part", "ordinal", line.alias("line")).alias("x")).groupBy("msg_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("msg_id", F.concat(F.array_join(F.concat(F.array(F.lit("type,value,context")), F.transform("xs", lambda x: x["line"])), "\r\n"), F.lit("\r\n")).alias("csv"))


def text_reports(messages: DataFrame, hops: DataFrame, anomalies: DataFrame, factors: DataFrame) -> DataFrame:
    """msg_id and a readable report: message, verdicts, chain, anomalies by severity, factors by weight.

    ``messages``: msg_id, filename, sha256, from_address, subject, score, verdict, spf_result, dkim_result, dmarc_result, dmarc_policy.
    """
    shown = lambda c, other="unknown": F.coalesce(F.col(c).cast("string"), F.lit(other))
    hop_line = F.concat(F.lit("  #"), shown("sequence"), F.lit("  from="), shown("from_host", "?"), F.lit(" ("), shown("from_ip", "no-ip"), F.lit(")  by="), shown("by_host", "?"))
    rank = F.array_position(F.array(*[F.lit(s) for s in _SEVERITIES]), F.col("severity"))
    anomaly_line = F.concat(F.lit("  ["), F.rpad(F.upper("severity"), 8, " "), F.lit("] "), F.col("type"), F.lit(": "), F.col("summary"))
    factor_line = F.concat(F.lit("  +"), F.rpad(F.col("weight").cast("string"), 3, " "), F.lit(" ["), F.col("category"), F.lit("] "), F.col("name"))

    def lines(df: DataFrame, name: str, line: Column, *order: Column) -> DataFrame:
        picked = df.select("msg_id", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")).alias("x"))
        return picked.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias(name))

    joined = (
        messages.join(lines(hops, "hop_lines", hop_line, F.col("sequence")), "msg_id", "left")
        .join(lines(anomalies, "anomaly_lines", anomaly_line, rank, F.col("ordinal")), "msg_id", "left")
        .join(lines(factors, "factor_lines", factor_line, -F.col("weight"), F.col("part"), F.col("ordinal")), "msg_id", "left")
    )

    def section(title: Column, body: Column, empty: str) -> Column:
        return F.concat(F.array(F.lit(""), F.concat(F.lit("== "), title, F.lit(" =="))), F.when(body.isNull(), F.array(F.lit(empty))).otherwise(body))

    n = lambda c: F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.size(F.col(c)).cast("string"))
    head = F.array(F.lit("FORENSIC REPORT"), F.concat(F.lit("file:     "), shown("filename")), F.concat(F.lit("sha256:   "), shown("sha256")), F.concat(F.lit("verdict:  "), F.upper(shown("verdict")), F.lit("  (risk score "), shown("score", "0"), F.lit("/100)")), F.concat(F.lit("from:     "), shown("from_address")), F.concat(F.lit("subject:  "), shown("subject", "")))
    auth = F.array(*[F.concat(F.lit(f"{m.upper():6s} "), F.upper(shown(f"{m}_result"))) for m in ("spf", "dkim", "dmarc")], F.concat(F.lit("dmarc policy published: "), shown("dmarc_policy")))
    text = F.concat(
        head,
        section(F.lit("AUTHENTICATION"), auth, ""),
        section(F.concat(F.lit("RELAY CHAIN ("), n("hop_lines"), F.lit(" hops)")), F.col("hop_lines"), "no Received headers found"),
        section(F.concat(F.lit("ANOMALIES ("), n("anomaly_lines"), F.lit(")")), F.col("anomaly_lines"), "none detected"),
        section(F.concat(F.lit("RISK SCORE: "), shown("score", "0"), F.lit("/100")), F.col("factor_lines"), "no contributing factors"),
    )
    return joined.select("msg_id", F.array_join(text, "\n").alias("report"))


def _pdf(text: str, per_page: int = 60) -> bytes:
    """A plain PDF of the text, in one typewriter face."""
    lines = [part for line in text.split("\n") for part in ([line[i : i + 95] for i in range(0, len(line), 95)] or [""])]
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        shown = [line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in page]
        stream = b"BT /F1 9 Tf 40 800 Td 12 TL\n" + b"".join(b"(%s) Tj T*\n" % s for s in shown) + b"ET"
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start))


def pdf_reports(texts: DataFrame) -> DataFrame:
    """msg_id and the report of ``text_reports`` as PDF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_pdf(t or "") for t in batch.column(1).to_pylist()], pa.binary())], names=["msg_id", "pdf"])

    return texts.select("msg_id", "report").mapInArrow(run, "msg_id string, pdf binary")


def raw_message(analyses: DataFrame, row_id: str) -> DataFrame:
    """The original bytes of one analysis, whatever its status."""
    return analyses.where(F.col("id") == row_id).select("filename", "raw_bytes")


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``df`` with ``ordinal`` in each ``by``, from 0."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
