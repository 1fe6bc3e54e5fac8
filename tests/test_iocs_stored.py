import json
import shutil

import pytest

import __spark_entry__ as entry

A, B, C = ({"filename": f"{x}.pdf", "content_type": kind, "size_bytes": n, "sha256": x * 4} for x, kind, n in (("a", "application/pdf", 3), ("b", None, 5), ("c", "text/plain", 7)))


def test_attachments_of_stored_analyses_are_indicators(spark, small, tmp_path):
    folder = str(tmp_path / "t")
    shutil.copytree(small, folder)
    records = {
        "list": json.dumps({"attachments": [None, A, json.dumps(B), {**A, "filename": "again.pdf"}]}),
        "single": json.dumps({"attachments": {**C, "embedded": {"attachments": [A]}}}),
        "text": json.dumps({"attachments": json.dumps([B, C])}),
        "record": json.dumps(json.dumps({"attachments": [C]})),
        "none": json.dumps({"attachments": None}),
        "odd": json.dumps({"attachments": ["x", 1, {"filename": "n.pdf"}, {"filename": "\ud800", "size_bytes": "many", "sha256": "dd"}]}),
        "broken": '{"attachments": [',
        "null": None,
    }
    analyses = spark.read.parquet(f"{small}/analyses.parquet")
    rows = spark.createDataFrame(list(records.items()), "id string, meta_json string")
    shutil.rmtree(f"{folder}/analyses.parquet", ignore_errors=True) or (tmp_path / "t/analyses.parquet").unlink(missing_ok=True)
    analyses.drop("id", "meta_json").limit(1).crossJoin(rows).write.parquet(f"{folder}/analyses.parquet")
    got = entry.queries()["ioc_extract"](spark, folder).where("type = 'sha256'").collect()
    assert sorted((r["msg_id"], r["value"], r["context"]) for r in got) == [
        ("list", "aaaa", "attachment 'a.pdf' (3 bytes, application/pdf)"),
        ("list", "bbbb", "attachment 'b.pdf' (5 bytes, unknown type)"),
        ("odd", "dd", "attachment '?' (0 bytes, unknown type)"),
        ("record", "cccc", "attachment 'c.pdf' (7 bytes, text/plain)"),
        ("single", "cccc", "attachment 'c.pdf' (7 bytes, text/plain)"),
        ("text", "bbbb", "attachment 'b.pdf' (5 bytes, unknown type)"),
        ("text", "cccc", "attachment 'c.pdf' (7 bytes, text/plain)"),
    ]
    assert '"type":"indicator"' in entry.queries()["stix_bundle"](spark, folder).where("msg_id = 'single'").first()["bundle"]
    assert "sha256,cccc," in entry.queries()["ioc_csv"](spark, folder).where("msg_id = 'single'").first()["csv"]


def test_all_is_as_the_twin_says(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("analyses", "hops"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    want = con.execute(f"SELECT msg_id, type, value, context FROM ({entry.oracle_sql()['ioc_extract']})").fetchall()
    got = entry.queries()["ioc_extract"](spark, small)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("msg_id", "type", "value", "context").collect())
