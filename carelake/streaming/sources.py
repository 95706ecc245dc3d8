"""Streaming reads of the driver tables (file source, one table per glob)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import table_path


MAX_FILES = 64  # files of one micro-batch


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = MAX_FILES) -> DataFrame:
    """``readStream`` over one driver table (schema taken from the batch reader)."""
    schema = spark.read.parquet(table_path(sf_dir, name)).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


FEED_ROWS = 62_500  # most rows of one file of a feed; a file is read by one task
LEAST_FILES, MANY_FILES = 4, 32  # files of a feed at least, of a micro-batch at most


def table_feed(spark: SparkSession, sf_dir: str, name: str, time_col: str, id_col: str = "event_id") -> DataFrame:
    """A driver table as it would arrive: bounded files in order of time, then id, streamed in micro-batches.

    All tasks write the feed together, cut by range, so files and micro-batches
    grow in number with the table, not in size.  The file source takes files by
    their modification time, which is set to their order here (file metadata only).
    """
    rows = spark.read.parquet(table_path(sf_dir, name))
    files = max(LEAST_FILES, -(-rows.count() // FEED_ROWS))
    feed = scratch_path(spark, "stream-feed")
    (rows.repartitionByRange(files, time_col, id_col).sortWithinPartitions(time_col, id_col).write
     .option("maxRecordsPerFile", FEED_ROWS).parquet(feed))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(feed)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = sorted((s for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")),
                 key=lambda s: s.getPath().getName())
    begin = int(time.time()) * 1000 - 1000 * len(own)
    for i, status in enumerate(own):
        fs.setTimes(status.getPath(), begin + 1000 * i, -1)
    at_once = max(1, min(MANY_FILES, len(own) // LEAST_FILES))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(feed)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the session's shared checkpoint dir (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def run_to_table(spark: SparkSession, stream_df: DataFrame, output_mode: str = "append",
                 fmt: str = "parquet") -> DataFrame:
    """Run a streaming query over all available input (``availableNow``) into a
    table in the shared folder, then read the table back as a batch DataFrame."""
    out = scratch_path(spark, "stream-out")
    ckpt = scratch_path(spark, "stream-ckpt")
    if output_mode == "append":
        q = (stream_df.writeStream.format(fmt).option("path", out).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.format(fmt).load(out)

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{out}/epoch={epoch}")  # a retried epoch replaces itself

    q = (stream_df.writeStream.foreachBatch(upsert).option("checkpointLocation", ckpt).outputMode(output_mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.format(fmt).load(out)
