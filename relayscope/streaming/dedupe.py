"""Exactly one copy of messages that were delivered at least once.

A keyed state store remembers the best copy of each identifier seen so far. The best copy is the one with
the earliest time, among equal ones the one with the smallest id; a null time comes last. Identifiers
leave the state when the event-time watermark passes them; the output itself, the log, then serves as
the lookup for what arrives after that.

The log says of each row, once and for all, that it is ``surplus``, or that it stays as far as is known:
``kept`` (its identifier wasn't in the state), ``better`` (it beats the copy in the state, which becomes
surplus) or ``late`` (behind the watermark, its identifier not in the state). Rows whose identifier wasn't in
the state are looked up, in the micro-batch they arrive in, among the rows of earlier ones that have left
the state; whichever copy loses becomes surplus. So the surplus rows are read off the log, nothing is
settled over all of it, and one row a message is left that is not surplus. The result doesn't depend on
batches, order or expiry.

Output is written under the number of its micro-batch before Spark commits that batch's state. After a
failure the batch runs again on the same input and state and overwrites what it wrote; where rows
go follows from the rows alone, so a task that runs again gives what it gave.

Identifiers are held in pages, a few hundred to a page: the state's key is a prefix of the identifier's
digest, as in a hash table, and its value the identifiers with it. A page is read and written as a whole
when one of its identifiers arrives; there are as many pages as the input asks for, so they stay small,
and one vectorised merge serves all of a page's rows. ``per_page=1`` gives nearly every identifier a state
value of its own, at some ten times the cost. Copies are thinned out within each Arrow batch before the shuffle; what
is thinned out there travels to pages drawn from the rows' ids, so one message that makes up a third
of all rows loads no page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from relayscope.session import fresh_path, reach

LOG_SCHEMA = "kind string, key string, at long, id string"
_STATE = "key array<string>, at array<bigint>, id array<string>, last array<bigint>"
_LAST = np.iinfo(np.int64).max  # a null time
_FIELDS = ("key", "at", "id", "last")


def _thin(batches: Iterator[pa.RecordBatch], pages: int) -> Iterator[pa.RecordBatch]:
    """Mark copies beaten within their batch. Their page follows from the rows alone, so a task that runs again sends each to the same place."""
    for batch in batches:
        pdf = batch.to_pandas()
        pdf = pdf.sort_values(["key", "at", "id"], kind="stable")
        better = pdf["key"].duplicated().to_numpy()
        page = pdf["page"].to_numpy().copy()
        beaten = pdf.loc[better, "id"]
        # rows that share an id are dealt out by their number among them
        drawn = pd.util.hash_pandas_object(beaten, index=False) % pages + beaten.groupby(beaten, dropna=False).cumcount()
        page[better] = (drawn % pages).astype(page.dtype)
        out = pdf.assign(surplus=better, page=page)
        yield pa.RecordBatch.from_pandas(out[["page", "surplus", "key", "at", "id", "event_time"]], preserve_index=False)


def _load(state: GroupState) -> pd.DataFrame:
    held = state.get if state.exists else ([], [], [], [])
    made = pd.DataFrame({name: list(values) for name, values in zip(_FIELDS, held)})
    return made.astype({"key": object, "at": "int64", "id": object, "last": "int64"})


def _save(state: GroupState, best: pd.DataFrame) -> None:
    state.update(tuple(best[name].tolist() for name in _FIELDS))


def _merge(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    new = pd.concat(list(pdfs), ignore_index=True)
    passed = new["surplus"].to_numpy(bool)
    out = [new[passed].assign(kind="surplus")]
    new = new[~passed]
    if not new.empty:
        watermark = max(state.getCurrentWatermarkMs(), 0) * 1000
        held = _load(state)
        late = ((new["at"] < watermark) & ~new["key"].isin(held["key"])).to_numpy()
        out.append(new[late].assign(kind="late"))
        new = new[~late]
        both = pd.concat([held.assign(old=True), new[["key", "at", "id"]].assign(last=new["at"], old=False)], ignore_index=True)
        both = both.sort_values(["key", "at", "id"], kind="stable")
        first, old = ~both["key"].duplicated(), both["old"].astype(bool)
        known = both["key"].isin(held["key"])
        out.append(both[first & ~old].assign(kind=np.where(known[first & ~old], "better", "kept")))
        # rows that lose, and copies in the state that have lost to one of them
        out.append(both[~first].assign(kind="surplus"))
        last = both["last"].where(both["last"] != _LAST, 0).groupby(both["key"]).max()
        best = both[first].assign(last=lambda x: x["key"].map(last))
        _save(state, best[best["last"] >= watermark])
    rows = pd.concat([x[["kind", "key", "at", "id"]] for x in out if not x.empty])
    if not rows.empty:
        yield rows


def delivery_log(stream: DataFrame, key: Column, at: Column, row_id: Column, delay: str, pages: int) -> DataFrame:
    """The log of a stream, not yet looked up. ``delay``: how far behind the latest time an identifier stays in the state."""
    digest = F.md5(key)
    rows = stream.select(
        F.pmod(F.xxhash64(digest), F.lit(pages)).cast("int").alias("page"),
        digest.alias("key"),
        F.coalesce(F.unix_micros(at), F.lit(int(_LAST))).alias("at"),
        row_id.cast("string").alias("id"),
        at.alias("event_time"),
    )
    thinned = rows.mapInArrow(lambda batches: _thin(batches, pages), "page int, surplus boolean, key string, at long, id string, event_time timestamp")
    return (
        thinned.withWatermark("event_time", delay)
        .groupBy("page")
        .applyInPandasWithState(_merge, LOG_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
    )


def look_up(fresh: DataFrame, earlier: DataFrame) -> DataFrame:
    """Surplus rows among ``fresh`` ones, whose identifiers weren't in the state, and among the ``earlier`` rows that stayed.

    Of an identifier's earlier rows only the best hasn't become surplus yet. Fresh identifiers are few
    beside all earlier ones; the join needs only their keys from there, and no other group is formed.
    """
    best = F.min(F.struct("at", "id"))
    asked = fresh.groupBy("key").agg(best.alias("new"), F.count(F.lit(1)).alias("n"))
    before = earlier.join(asked.select("key"), "key", "left_semi").groupBy("key").agg(best.alias("old"))
    # a fresh row alone with its identifier stays
    settled = asked.join(before, "key", "left").where("old is not null or n > 1").select("key", "old", F.least("old", "new").alias("best"))
    beaten = fresh.join(settled, "key").where(F.struct("at", "id") != F.col("best")).select("key", "at", "id")
    replaced = settled.where("old is not null and old <> best").select("key", "old.at", "old.id")
    return beaten.unionAll(replaced).select(F.lit("surplus").alias("kind"), "key", "at", "id")


def read_log(spark: SparkSession, work: str) -> DataFrame:
    """All rows of the log in the folder ``work``."""
    return spark.read.schema(LOG_SCHEMA + ", batch int").option("basePath", f"{work}/log").parquet(f"{work}/log").select("kind", "key", "at", "id")


def surplus_ids(log: DataFrame) -> DataFrame:
    """Ids of all rows but the best of each identifier."""
    return log.where(F.col("kind") == "surplus").select("id")


def kept_ids(log: DataFrame) -> DataFrame:
    """The id of the best row of each identifier."""
    stays = log.where(F.col("kind") != "surplus").select("key", "at", "id")
    return stays.join(log.where(F.col("kind") == "surplus").select("key", "at", "id"), ["key", "at", "id"], "left_anti").select("id")


def _pages(spark: SparkSession, path: str, count: Callable[[], int]) -> int:
    """The number of pages written down at ``path``; counted and written there the first time."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) or fs.getFileStatus(place).getLen() != 4:  # not there, or not written to its end
        out = fs.create(place, True)
        out.writeInt(count())
        out.close()
    held = fs.open(place)
    pages = held.readInt()
    held.close()
    return pages


def run_dedupe(
    spark: SparkSession,
    path: str,
    key: Column,
    at: Column,
    row_id: Column,
    *,
    delay: str = "45 days",
    per_page: int = 256,
    files_per_batch: int | None = 200,
    work: str | None = None,
) -> DataFrame:
    """Run the stream over what lies under ``path`` until it is read, and give the log.

    ``work`` names a folder of an earlier run to go on from; else a new one in the shared folder is
    used. After a crash the same call goes on where the last committed micro-batch ended. ``per_page``:
    how many identifiers a page is meant to hold; the number of pages follows from the rows there are
    when ``work`` is first used, and stays.
    """
    reach(spark)
    work = work or fresh_path(spark, "deliveries")
    source = spark.read.parquet(path)
    pages = _pages(spark, f"{work}/pages", lambda: max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2**30, -(-source.count() // per_page))))
    reader = spark.readStream.schema(source.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a pattern that only this name matches; it lets the stream take a single file as well as a folder
    log = delivery_log(reader.parquet(f"{path[:-1]}[{path[-1]}]"), key, at, row_id, delay, pages)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        arrived, found = f"{work}/log/batch={2 * number}", f"{work}/log/batch={2 * number + 1}"
        batch.write.mode("overwrite").parquet(arrived)
        if number == 0:  # nothing came before
            return
        fresh = session.read.schema(LOG_SCHEMA).parquet(arrived).where(F.col("kind").isin("kept", "late")).select("key", "at", "id")
        before = session.read.schema(LOG_SCHEMA + ", batch int").option("basePath", f"{work}/log").parquet(f"{work}/log").where((F.col("batch") < 2 * number) & (F.col("kind") != "surplus"))
        look_up(fresh, before.select("key", "at", "id")).write.mode("overwrite").parquet(found)

    query = log.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_log(spark, work)
