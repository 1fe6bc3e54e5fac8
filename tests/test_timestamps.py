import datetime as dt

import pytest

from relayscope.functions.stamps import readings
from relayscope.operators.timestamps import em_posteriors, normalise


def utc(*x):
    return int(dt.datetime(*x, tzinfo=dt.UTC).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Sat, 24 Aug 2024 03:11:43 +0545", utc(2024, 8, 23, 21, 26, 43)),
        ("Tue, 17 Dec 2024 15:25:10 +1100 (AEDT)", utc(2024, 12, 17, 4, 25, 10)),
        ("Fri, 06 Mar 2026 07:17:42 CST", utc(2026, 3, 6, 13, 17, 42)),
        ("18 Apr 24 19:21:04 -0000", utc(2024, 4, 18, 19, 21, 4)),
        ("Sat, 06 Apr 2024 17:59 +0200", utc(2024, 4, 6, 15, 59)),
        ("16. Februar 2026 14:27:09 +0545", utc(2026, 2, 16, 8, 42, 9)),
        ("22 mars 2024 06h02:54 +0530", utc(2024, 3, 22, 0, 32, 54)),
        ("2025/03/10 03:23:56 GMT+1", utc(2025, 3, 10, 2, 23, 56)),
        ("2026/07/26 09:21:14 UTC+5:45", utc(2026, 7, 26, 3, 36, 14)),
        ("20240726T030606Z", utc(2024, 7, 26, 3, 6, 6)),
        ("1725839036", utc(2024, 9, 8, 23, 43, 56)),
        ("1784960545254709456", utc(2026, 7, 25, 6, 22, 25, 254709)),
        ("2025-12-22T11:29:00.130047571Z", utc(2025, 12, 22, 11, 29, 0, 130047)),
    ],
)
def test_stated_instants(raw, want):
    ((_, local, offset),) = readings(raw)
    assert local - offset * 1_000_000 == want


@pytest.mark.parametrize("raw", [None, "", " ", "-", "n/a", "unknown", "yesterday 14:20", "Fri, 12 Jun", "Sun, 99 Mar 2026 25:61:00", "Thu, 31 Feb 2026 10:00:00 +0000", "0000-00-00 00:00:00", "2026-13-04T09:15:00Z", "Mon, 1 Jan 2024 10:00:00 +9999", "13/13/2024 10:00:00", "01/02/2024 13:00:00 PM", "12345678901234", "x" * 100_000])
def test_nothing_stated(raw):
    assert readings(raw) == []


def test_numeric_dates_have_two_readings():
    assert [r[0] for r in readings("05/06/2024 10:00:00")] == ["DMY", "MDY"]
    assert [r[0] for r in readings("25/06/2024 10:00:00")] == ["DMY"]


def test_two_digit_years_may_come_first():
    assert [r[0] for r in readings("04/05/06 10:00:00")] == ["DMY", "MDY", "YMD"]
    assert [r[0] for r in readings("32-05-04 10:00:00")] == ["YMD"]


def test_em_learns_the_order_and_leaves_a_tie():
    learned = em_posteriors([(("DMY",), 40), (("DMY", "MDY"), 60)])
    assert learned["DMY", "MDY"]["DMY"] > 0.95
    assert em_posteriors([(("DMY", "MDY"), 5)])["DMY", "MDY"] == {"DMY": 0.5, "MDY": 0.5}


@pytest.mark.parametrize("shares", [(6, 3, 1), (6, 1, 3), (90, 9, 1), (1, 0, 1)])
def test_posteriors_do_not_depend_on_size(shares):
    sets = [("DMY", "MDY"), ("MDY",), ("DMY",)]
    small, *larger = [em_posteriors([(f, n * times) for f, n in zip(sets, shares) if n])["DMY", "MDY"]["DMY"] for times in (1, 1_000, 1_000_000, 10**9)]
    assert all(abs(x - small) < 1e-9 for x in larger)


@pytest.mark.parametrize("times", [1, 30])
def test_a_declared_order_holds_against_any_number_of_others(spark, times):
    raws = ["05/06/2024 10:00:00"] * 6 + ["05/26/2024 10:00:00"] * 3 + ["26/05/2024 10:00:00"]
    df = spark.createDataFrame([("h", r, "UTC", "DMY") for r in raws * times], "source string, raw string, zone string, date_order string")
    got = {r["raw"]: (r["status"], r["instant"]) for r in normalise(df, raw="raw").collect()}
    assert got == {raws[0]: ("stated", dt.datetime(2024, 6, 5, 10)), raws[6]: ("none", None), raws[9]: ("stated", dt.datetime(2024, 5, 26, 10))}


ROWS = [
    ("dst twice", "h1", "2024-10-27 02:30:00", "Europe/Berlin", "DMY"),
    ("dst gap", "h1", "2024-03-31 02:30:00", "Europe/Berlin", "DMY"),
    ("declared", "h1", "05/06/2024 10:00:00", "Europe/Berlin", "DMY"),
    ("declared us", "h2", "05/06/2024 10:00:00 PM", "America/Chicago", "MDY"),
    ("wrong order", "h1", "05/26/2024 10:00:00", "Europe/Berlin", "DMY"),
    ("no zone", "h3", "2024-01-01 10:00:00", None, None),
    ("tie", "h3", "05/06/2024 10:00:00 +0000", None, None),
    ("null", "h1", None, "Europe/Berlin", "DMY"),
    ("null", "h1", None, "Europe/Berlin", "DMY"),
]


def test_zones_orders_and_status(spark):
    df = spark.createDataFrame(ROWS, "name string, source string, raw string, zone string, date_order string")
    rows = normalise(df, raw="raw").collect()
    got = {r["name"]: (r["status"], r["instant"]) for r in rows}
    assert len(rows) == len(ROWS)
    assert got["dst twice"] == ("stated", dt.datetime(2024, 10, 27, 0, 30))
    assert got["dst gap"] == ("stated", dt.datetime(2024, 3, 31, 1, 30))
    assert got["declared"] == ("stated", dt.datetime(2024, 6, 5, 8, 0))
    assert got["declared us"] == ("stated", dt.datetime(2024, 5, 7, 3, 0))
    assert got["wrong order"] == ("none", None)
    assert got["no zone"] == ("no_zone", None)
    assert got["tie"] == ("ambiguous", None)
    assert got["null"] == ("none", None)


def test_clashing_columns_make_way(spark):
    df = spark.createDataFrame([("h", "2024-01-01T00:00:00Z", None, None, "x", 1, "y")], "source string, raw string, zone string, date_order string, status string, formats int, best string")
    row = normalise(df, raw="raw").first()
    assert row["status"] == "stated" and row["instant"] == dt.datetime(2024, 1, 1) and "best" not in row.asDict()


def test_empty_table(spark):
    df = spark.createDataFrame([], "source string, raw string, zone string, date_order string")
    assert normalise(df, raw="raw").count() == 0
