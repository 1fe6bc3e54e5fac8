import glob
import math
import os

import pytest

import __spark_entry__ as entry


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 3, 4):
        assert f"p{n}_found" in entry.queries()


def test_flagship(spark, small):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"msg_id", "score", "verdict"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twins_agree(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours = entry.queries()[name](spark, small)
    columns = sorted(ours.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in ours.collect())
    b = sorted(repr(tuple(plain(dict(zip(theirs, r))[c]) for c in columns)) for r in cursor.fetchall())
    assert a == b
