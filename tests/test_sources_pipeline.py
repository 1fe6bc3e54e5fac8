import csv
import io
import json
import os
import tarfile

from pyspark.sql import functions as F

from relayscope import pipeline
from relayscope.operators import dataprep, exports, models, store
from relayscope.plans import forensics, records
from relayscope.session import materialize
from relayscope.sources import messages
from relayscope.streaming import ingest

CLEAN = b"Received: from mail.good.test (mail.good.test [198.51.100.9]) by mx.us.test with ESMTPS; Mon, 6 May 2024 10:00:09 +0000\r\nReceived: from desk.good.test (desk.good.test [198.51.100.8]) by mail.good.test with ESMTP; Mon, 6 May 2024 10:00:05 +0000\r\nAuthentication-Results: mx.us.test; spf=pass smtp.mailfrom=a@good.test; dkim=pass header.d=good.test; dmarc=pass header.from=good.test\r\nFrom: A B <a@good.test>\r\nTo: c@us.test, D <d@us.test>\r\nSubject: Hello\r\nDate: Mon, 6 May 2024 10:00:00 +0000\r\nMessage-ID: <1@good.test>\r\n\r\nSee https://good.test/x\r\n"
FORGED = b"Received: from relay.bad.test (relay.bad.test [203.0.113.6]) by mx.us.test; Mon, 6 May 2024 09:00:00 +0000\r\nReceived: from inner (inner [10.0.0.5]) by mx.us.test; Mon, 6 May 2024 10:00:00 +0000\r\nAuthentication-Results: mx.us.test; spf=fail; dkim=none;\r\n dmarc=fail (p=reject)\r\nDKIM-Signature: v=1; d=x.test; x=1000\r\nFrom: PayPal <x@paypai.com>\r\nSubject: act now\r\nDate: Mon, 6 May 2024 10:00:00 +0000\r\nMessage-ID: <2@bad.test>\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<a href=\"http://185.1.1.1/l?next=http%3A%2F%2Fz.test\">www.paypal.com</a>"
MIME = b"From: a@t.test\r\nSubject: f\r\nDate: bad\r\nMessage-ID: <3@t>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nhi\r\n--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=\"invoice.pdf.exe\"\r\nContent-Transfer-Encoding: base64\r\n\r\nYWJj\r\n--b\r\nContent-Disposition: attachment\r\n\r\nx\r\n--b--\r\n"


def frame(spark, *items):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in items], "filename string, content binary")


def test_parse_never_raises(spark):
    df = frame(spark, ("clean.eml", CLEAN), ("m.eml", MIME), ("empty.eml", b""), ("null.eml", None), ("all.eml", bytes(range(256)) * 4), ("o.bin", bytes.fromhex("D0CF11E0A1B11AE1")), ("x.MSG", b"zz"), ("no.eml", b"just text"))
    rows = {r["filename"]: r for r in messages.parse(df).collect()}
    assert len(rows) == 8
    clean = rows["clean.eml"]
    assert (clean["from_display_name"], clean["from_address"], clean["to_addresses"]) == ("A B", "a@good.test", ["c@us.test", "d@us.test"])
    assert clean["parse_confidence"] == 1.0 and len(clean["received"]) == 2 and clean["issues"] == []
    mime = rows["m.eml"]
    assert [(a["filename"], a["size_bytes"]) for a in mime["attachments"]] == [("invoice.pdf.exe", 3), ("(unnamed attachment)", 1)]
    assert mime["attachments"][0]["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert mime["date_parsed"] is None and "Date" in [i["field"] for i in mime["issues"]]
    assert rows["o.bin"]["source_format"] == rows["x.MSG"]["source_format"] == "msg"
    assert abs(rows["empty.eml"]["parse_confidence"] - 0.22) < 1e-9 and len(rows["empty.eml"]["issues"]) == 4


def test_validation_and_format(spark):
    df = frame(spark, ("a.eml", b"x"), ("b.eml", b""), ("c.eml", b"x" * 11), ("d.eml", None), ("e.MSG", b"y"))
    good, bad = messages.validated(df, 10)
    assert sorted(r["filename"] for r in good.collect()) == ["a.eml", "e.MSG"]
    assert {r["filename"]: r["reason"] for r in bad.collect()} == {"b.eml": "empty file", "c.eml": "file too large", "d.eml": "empty file"}
    assert {r["filename"]: r["source_format"] for r in messages.source_format(df).collect()}["e.MSG"] == "msg"


def test_reports(spark):
    r = pipeline.from_bytes(frame(spark, ("clean", CLEAN), ("forged", FORGED)), as_of=F.lit("2024-06-01").cast("timestamp"))
    risk = {x["msg_id"]: (x["score"], x["verdict"]) for x in r.risk.collect()}
    # forged: spf 20, dkim none 8, dmarc reject 35, earlier time 20, bogon 20, same host 10, break 10, expired 10, edit from a brand 20, bare address 12, anchor 10
    assert risk == {"clean": (0, "clean"), "forged": (100, "malicious")}
    assert r.factors.where("msg_id = 'forged'").agg(F.sum("weight")).first()[0] == 175
    where = {x["msg_id"]: (x["origin_ip"], x["confidence"]) for x in r.attribution.collect()}
    assert where == {"clean": ("198.51.100.8", "medium"), "forged": ("203.0.113.6", "low")}
    found = [(x["msg_id"], x["type"], x["value"]) for x in r.iocs.collect()]
    assert ("forged", "url", "http://z.test") in found and len(found) == len(set(found))
    text = exports.text_reports(r.messages.join(r.risk.drop("factors"), "msg_id"), r.hops, r.anomalies, r.factors).where("msg_id = 'forged'").first()["report"]
    assert "MALICIOUS" in text and "#1" in text and text.index("+35") < text.index("+8 ")
    pdf = exports.pdf_reports(exports.text_reports(r.messages.join(r.risk.drop("factors"), "msg_id"), r.hops, r.anomalies, r.factors)).first()["pdf"]
    assert bytes(pdf).startswith(b"%PDF-1.4") and bytes(pdf).endswith(b"%%EOF")


def test_exports(spark):
    rows = [("m", 0, 0, "url", "http://a'b\\c", 'say "hi", now'), ("m", 1, 0, "ipv4", "1.1.1.1", "plain")]
    df = spark.createDataFrame(rows, "msg_id string, part int, ordinal int, type string, value string, context string")
    bundle = json.loads(exports.stix_bundles(df, F.lit("CASE-1"), F.lit("2024-01-01").cast("timestamp")).first()["bundle"])
    assert bundle["type"] == "bundle" and bundle["objects"][0]["pattern"] == "[url:value = 'http://a\\'b\\\\c']"
    assert bundle["objects"][1]["created"] == "2024-01-01T00:00:00.000Z" and bundle["objects"][0]["id"].startswith("indicator--")
    again = exports.stix_bundles(df, F.lit("CASE-1"), F.lit("2024-01-01").cast("timestamp")).first()["bundle"]
    assert json.loads(again) == bundle
    text = exports.csv_texts(df).first()["csv"]
    assert text.endswith("\r\n") and list(csv.reader(io.StringIO(text)))[1] == ["url", "http://a'b\\c", 'say "hi", now']


def test_pages_and_counts(spark):
    rows = [(f"{i:02d}", "complete" if i % 3 else "failed", "fail" if i % 2 else None, None if i == 5 else f"2024-01-{1 + i // 4:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, status string, spf_result string, day string").withColumn("created_at", F.col("day").cast("timestamp"))
    pages = [[r["id"] for r in store.page(df, ["id", "created_at"], limit=15, offset=o).collect()] for o in (0, 15, 30)]
    assert len({x for p in pages for x in p}) == 40 and pages[0][:2] == ["39", "38"]
    assert store.total(df, status="complete").first()[0] == sum(r[1] == "complete" for r in rows)
    counted = {(r["dimension"], r["key"]): r["n"] for r in store.breakdown(df, ["status", "spf_result"]).collect()}
    assert counted["status", "complete"] + counted["status", "failed"] == 40 and counted["spf_result", "fail"] == 20
    assert store.since(df, F.lit("2024-01-10").cast("timestamp")).first()[0] == 8


def test_header_blocks(spark):
    df = spark.createDataFrame([("m", "A: 1\r\n b\r\nReceived: from x\r\n\tby y\r\n\r\nBody: no"), ("e", "")], "msg_id string, raw string")
    blocks = store.header_blocks(df, "raw")
    assert [(r["position"], r["block"]) for r in blocks.where("msg_id = 'm'").collect()] == [(0, "A: 1\n b"), (1, "Received: from x\n\tby y")]
    hops = spark.createDataFrame([("m", "FROM x\r\n by y")], "msg_id string, raw_header string")
    verdicts = spark.createDataFrame([("m", True, False)], "msg_id string, auth_failed boolean, dkim_signature_expired boolean")
    assert [r["suspicious"] for r in store.suspicious_headers(blocks, hops, verdicts).where("msg_id = 'm'").orderBy("position").collect()] == [False, True]


def test_geo_segments_skip_unplaced_hops(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, None, 2.0), ("a", 2, 3.0, 4.0)], "analysis_id string, sequence int, latitude double, longitude double")
    assert [(r["from_sequence"], r["to_sequence"]) for r in store.geo_segments(df).collect()] == [(0, 2)]
    assert [(r["x"], r["y"]) for r in store.map_projection(df).orderBy("sequence").collect()] == [(208.333, 66.667), (291.667, 93.333)]


def test_balanced_sample_and_split(spark):
    rows = [(f"text number {i} is long enough", i % 4 == 0, f"s{i % 3}" if i % 4 else "p") for i in range(400)] + [("short", True, "p"), (None, True, "p"), ("a long text without a label", None, "p")]
    df = spark.createDataFrame(rows, "t string, y boolean, s string")
    sample = dataprep.balanced_sample(df, "t", "y", "s", per_class=60)
    count = {(r["label"], r["source"]): r["n"] for r in sample.groupBy("label", "source").agg(F.count("*").alias("n")).collect()}
    assert sum(n for (y, _), n in count.items() if y) == 60 == sum(n for (y, _), n in count.items() if not y)
    assert max(n for (y, _), n in count.items() if not y) <= 21
    parts = {r["part"]: r["n"] for r in dataprep.split(sample).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 84, "validation": 18, "test": 18}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "t int, p int")
    assert tuple(dataprep.metrics(df, F.col("t"), F.col("p")).first()) == (0.5, 0.5, 0.5, 0.5)
    assert tuple(dataprep.metrics(df.where("t = 0"), F.col("t"), F.col("p"))  .first()) == (0.5, 0.0, 0.0, 0.0)


def test_models_without_files(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string")
    assert {r["phishing_source"] for r in models.phishing(df, "id", "text", "/nowhere").collect()} == {"unavailable"}
    assert {r["detail"] for r in models.machine_text(df, "id", "text", "").collect()} == {"model files not found"}


def test_corpus_archives(spark):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:bz2") as tar:
        info = tarfile.TarInfo("x/1")
        info.size = len(CLEAN)
        tar.addfile(info, io.BytesIO(CLEAN))
    box = b"From a@t Mon May  6 10:00:00 2024\n" + MIME.replace(b"\r\n", b"\n") + b"\n"
    got = {r["filename"]: r["text"] for r in messages.corpus_texts(frame(spark, ("h.tar.bz2", buffer.getvalue()), ("p.mbox", box))).collect()}
    assert got["h.tar.bz2"].startswith("Hello\n\nSee https") and got["p.mbox"].startswith("f\n\nhi")


def test_folder_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, content in (("a.eml", CLEAN), ("b.eml", FORGED), ("c.eml", b"x" * 5000)):
        (inbox / name).write_bytes(content)
    seen = []
    stream = ingest.incoming(spark, str(inbox), files_per_batch=1)
    ingest.analyse(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda df, n: seen.append(df.count()), most=4000).awaitTermination()
    streamed = {r["filename"]: r["sha256"] for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()}
    batch = {r["filename"]: r["sha256"] for r in messages.parse(messages.validated(messages.files(spark, str(inbox)), 4000)[0]).collect()}
    assert streamed == batch and len(batch) == 2 and sum(seen) == 2
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1
    assert os.path.isdir(tmp_path / "ck")


def test_a_running_stream_finds_new_files(spark, tmp_path):
    inbox = tmp_path / "live"
    inbox.mkdir()
    (inbox / "a.eml").write_bytes(CLEAN)
    query = ingest.analyse(ingest.incoming(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "ck"), every="1 second")
    try:
        query.processAllAvailable()
        (inbox / "b.eml").write_bytes(FORGED)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["filename"] for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()) == ["a.eml", "b.eml"]


def test_pasted(spark):
    assert messages.parse(messages.pasted(spark, ["From: a@b.test\n\n"])).first()["from_address"] == "a@b.test"


def stored(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def made(spark, *mails):
    return pipeline.generate(materialize(messages.parse(frame(spark, *mails)).coalesce(1), "parsed"), as_of=F.lit("2024-06-01").cast("timestamp"), keep=True)


def test_store_keeps_what_it_has_and_replaces_what_comes_again(spark, tmp_path):
    folder, then = str(tmp_path / "store"), F.lit("2024-06-01").cast("timestamp")
    save = lambda *mails, **kw: pipeline.save(made(spark, *mails), folder, buckets=4, **kw)
    save(("clean", CLEAN), ("forged", FORGED), raw=frame(spark, ("clean", CLEAN)).withColumnRenamed("filename", "msg_id"), created_at=then)
    save(("none", None), ("mime", MIME))
    rows = {r["id"]: r for r in stored(spark, folder, "analyses").collect()}
    assert set(rows) == {"clean", "forged", "none", "mime"} and set(pipeline.ANALYSIS_COLUMNS) <= set(stored(spark, folder, "analyses").columns)
    assert (rows["none"]["hop_count"], rows["none"]["anomaly_count"], rows["forged"]["highest_anomaly_severity"], rows["forged"]["hop_count"]) == (0, 0, "high", 2)
    assert bytes(rows["clean"]["raw_bytes"]) == CLEAN and rows["forged"]["raw_bytes"] is None
    assert stored(spark, folder, "hops").count() == 4 and stored(spark, folder, "anomalies").where("analysis_id = 'forged'").count() == rows["forged"]["anomaly_count"] > 3
    # the forged one comes again as the clean one: its hops are replaced, its anomalies go, its time stays
    save(("forged", CLEAN))
    again = {r["id"]: r for r in stored(spark, folder, "analyses").collect()}
    assert len(again) == 4 and again["forged"]["verdict"] == "clean" and again["forged"]["created_at"] == rows["forged"]["created_at"]
    assert again["clean"] == rows["clean"]
    assert stored(spark, folder, "anomalies").where("analysis_id = 'forged'").count() == 0
    assert sorted(r["from_host"] for r in stored(spark, folder, "hops").where("analysis_id = 'forged'").collect()) == ["desk.good.test", "mail.good.test"]
    assert [r["id"] for r in store.page(stored(spark, folder, "analyses"), ["id", "created_at"], limit=9, status="complete").collect()][-2:] == ["forged", "clean"]


def test_stored_reports_are_read_as_they_were_made(spark, tmp_path):
    folder = str(tmp_path / "store")
    new = made(spark, ("clean", CLEAN), ("forged", FORGED), ("mime", MIME))
    pipeline.save(new, folder)
    entry = forensics.QUERIES
    assert {tuple(r) for r in entry["risk_score"](spark, folder).collect()} == {(r["msg_id"], r["score"], r["verdict"]) for r in new.risk.collect()}
    shown = lambda df: sorted((r["msg_id"], r["name"], r["weight"]) for r in df.collect())
    assert shown(forensics._factors(spark, folder)[1]) == shown(new.factors)
    assert sorted(map(tuple, entry["ioc_extract"](spark, folder).collect())) == sorted((r["msg_id"], r["type"], r["value"], r["context"]) for r in new.iocs.collect())
    assert {(r["msg_id"], r["origin_ip"]) for r in entry["origin_confidence"](spark, folder).collect()} == {(r["msg_id"], r["origin_ip"]) for r in new.attribution.collect()}
    assert {(r["id"], r["path"]) for r in records.p1_found(spark, folder).collect()} >= {("mime", "attachments/1"), ("clean", "to_addresses/1"), ("forged", "spf/0")}
    report = json.loads(entry["report_json"](spark, folder).where("msg_id = 'forged'").first()["report"])
    assert report["risk"]["verdict"] == "malicious" and report["meta"]["message_id"] == "<2@bad.test>" and len(report["hops"]) == 2


def test_parts_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(f'a "long" text, number {i}', i % 2, "s") for i in range(100)], "t string, y int, s string")
    dataprep.write_parts(dataprep.split(dataprep.balanced_sample(df, "t", "y", "s", per_class=20)), str(tmp_path))
    read = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "train"))
    assert read.count() == 28 and read.where("text rlike '^a .long. text, number'").count() == 28


def test_command_line(spark, tmp_path, capsys):
    from relayscope.__main__ import main

    assert main([str(tmp_path / "missing.eml")]) == 1
    (tmp_path / "a.eml").write_bytes(FORGED)
    assert main([str(tmp_path / "a.eml")]) == 0 and "MALICIOUS" in capsys.readouterr().out
    assert main([str(tmp_path), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out.strip())["risk"]["verdict"] == "malicious"
