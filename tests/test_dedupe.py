import datetime as dt
import pathlib

from pyspark.sql import functions as F

from relayscope.functions.messages import delivery_key, plain_message_id
from relayscope.session import fresh_path
from relayscope.streaming.dedupe import kept_ids, run_dedupe, surplus_ids

SCHEMA = "id string, meta_json string, sha256 string, created_at timestamp, at long, key string"


def row(i, mid, sha, day):
    meta = None if mid is None else '{"message_id": "%s"}' % mid
    return (i, meta, sha, None if day is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=day), 7, "clash")


def surplus(spark, batches, **kw):
    folder = fresh_path(spark, "t").replace("file://", "")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    log = run_dedupe(spark, folder, delivery_key(F.col("meta_json"), F.col("sha256"), F.col("id")), F.col("created_at"), F.col("id"), per_page=16, **kw)
    found, stay = (sorted(r[0] for r in part(log).collect()) for part in (surplus_ids, kept_ids))
    assert sorted(found + stay) == sorted(r[0] for rows in batches for r in rows)
    return found


def brute(rows):
    keys = {}
    for i, meta, sha, at, _, _ in rows:
        mid = None if meta is None else meta.split('"')[3].strip(" <>")
        if mid and "@" in mid:
            mid = mid.rpartition("@")[0] + "@" + mid.rpartition("@")[2].lower()
        keys.setdefault(("m", mid) if mid else ("s", sha.lower().strip()) if sha else ("r", i), []).append((at or dt.datetime.max, i))
    return sorted(i for v in keys.values() for _, i in sorted(v)[1:])


BASE = [
    row("a", "<M1@X.test>", "s1", 5),
    row("b", " M1@x.TEST ", "s2", 3),
    row("c", "m1@x.test", "s2", 1),
    row("d", "", "S9", 2),
    row("e", "<>", "s9 ", 2),
    row("f", None, None, 4),
    row("g", None, None, 4),
    row("h", "no-at", "s3", None),
    row("i", "no-at", "s3", 9),
]


def test_one_batch(spark):
    assert surplus(spark, [BASE]) == brute(BASE) == ["a", "e", "h"]


def test_many_batches_with_expiry_and_late_rows(spark):
    rows = [row(f"r{i:03d}", f"k{i % 40}@t", "x", (i * 37) % 90) for i in range(200)]
    batches = [rows[i::5] for i in range(5)]
    assert surplus(spark, batches, files_per_batch=1, delay="1 days") == brute(rows)


def test_a_copy_after_its_identifier_left_the_state_is_looked_up(spark):
    batches = [[row("a", "m@t", "x", 10), row("f1", "f1@t", "x", 10)], [row("f2", "f2@t", "x", 60)], [row("b", "m@t", "x", 61), row("c", "m@t", "x", 5), row("d", "m@t", "x", 4)], [row("e", "m@t", "x", 3), row("g", "m@t", "x", 90)]]
    assert surplus(spark, batches, files_per_batch=1, delay="1 days") == brute(sum(batches, [])) == ["a", "b", "c", "d", "g"]


def test_a_page_for_each_identifier_gives_the_same(spark):
    rows = [row(f"r{i:03d}", f"k{i % 30}@t", "x", (i * 37) % 90) for i in range(90)]
    folder = fresh_path(spark, "t").replace("file://", "")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    log = run_dedupe(spark, folder, delivery_key(F.col("meta_json"), F.col("sha256"), F.col("id")), F.col("created_at"), F.col("id"), per_page=1)
    assert sorted(r[0] for r in surplus_ids(log).collect()) == brute(rows)


def test_a_batch_that_runs_again_changes_nothing(spark):
    """The commit of the last micro-batch is lost, as when the driver dies after its output was written."""
    folder, work = fresh_path(spark, "src").replace("file://", ""), fresh_path(spark, "work")
    key = delivery_key(F.col("meta_json"), F.col("sha256"), F.col("id"))
    rows = [row(f"r{i:03d}", f"k{i % 20}@t", "x", (i * 37) % 60) for i in range(120)]
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: sorted(tuple(r) for r in run_dedupe(spark, folder, key, F.col("created_at"), F.col("id"), per_page=8, files_per_batch=1, delay="1 days", work=work).collect())
    once = run()
    commits = pathlib.Path(work.replace("file://", "")) / "state" / "commits"
    for lost in (commits / "1", commits / ".1.crc"):
        lost.unlink(missing_ok=True)
    assert run() == once and sorted(r[3] for r in once if r[0] == "surplus") == brute(rows)


def test_names_that_only_begin_alike_are_not_read(spark):
    folder = fresh_path(spark, "t").replace("file://", "")
    spark.createDataFrame(BASE, SCHEMA).coalesce(1).write.parquet(folder)
    spark.createDataFrame([row("bak", "m1@x.test", "s", 9)], SCHEMA).coalesce(1).write.parquet(folder + ".bak")
    log = run_dedupe(spark, folder, delivery_key(F.col("meta_json"), F.col("sha256"), F.col("id")), F.col("created_at"), F.col("id"))
    assert sorted(r[0] for r in surplus_ids(log).collect()) == brute(BASE)


def test_empty_table(spark):
    assert surplus(spark, [[]]) == []


def test_hot_message(spark):
    rows = [row(f"h{i:05d}", "hot@t" if i % 3 else f"o{i}@t", "x", i % 50) for i in range(3000)]
    assert surplus(spark, [rows]) == brute(rows)


def test_goes_on_where_it_ended(spark):
    folder, work = fresh_path(spark, "src").replace("file://", ""), fresh_path(spark, "work")
    key = delivery_key(F.col("meta_json"), F.col("sha256"), F.col("id"))
    first, second = BASE[:3], [row("z", "M1@x.test", "s", 0), row("y", "new@t", "s", 0)]
    for part in (first, second):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        log = run_dedupe(spark, folder, key, F.col("created_at"), F.col("id"), per_page=2, work=work)
    assert sorted(r[0] for r in surplus_ids(log).collect()) == brute(first + second)


def test_message_ids(spark):
    got = spark.createDataFrame([(" <A@B.C> ",), ("<>",), ("",), (None,), ("x",), ("a@b@C",)], "m string").select(plain_message_id(F.col("m"))).collect()
    assert [r[0] for r in got] == ["A@b.c", None, None, None, "x", "a@b@c"]
