"""Messages that arrive in a folder, analysed as they come.

Each micro-batch goes through the same parsing as a batch and is written under its batch number, so a
batch that is run again after a crash overwrites what it wrote. Files are keyed by digest and name.
Spark's file stream passes over files without any bytes, so these are in neither list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relayscope.config import MAX_UPLOAD_BYTES
from relayscope.sources.messages import parse, validated

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def incoming(spark: SparkSession, folder: str, pattern: str = "*.eml", files_per_batch: int = 1000) -> DataFrame:
    """filename, content, msg_id of the files of a folder as a stream."""
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return stream.select(name.alias("filename"), "content", F.concat(F.substring(F.sha2("content", 256), 1, 16), F.lit("-"), name).alias("msg_id"))


def analyse(stream: DataFrame, out: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, most: int = MAX_UPLOAD_BYTES, every: str | None = None) -> StreamingQuery:
    """Parse accepted messages to ``out/messages`` and list the others in ``out/rejected``; ``then`` gets each parsed batch.

    The query ends when what is there is read; with ``every`` (such as ``5 seconds``) it goes on looking for new files until it is stopped.
    """

    def one(batch: DataFrame, number: int) -> None:
        accepted, rejected = validated(batch, most)
        parsed = parse(accepted, "msg_id")
        parsed.write.mode("overwrite").parquet(f"{out}/messages/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        if then is not None:
            then(batch.sparkSession.read.parquet(f"{out}/messages/batch={number}"), number)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
