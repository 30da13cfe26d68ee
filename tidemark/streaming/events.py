"""Structured Streaming over the event table: deduplication, windows, sessions, and the conversation ledger.

The windows and sessions are additions; the domain's own state is the ledger's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine import shared_dir

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
LATENESS = "2 days"


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, one file or a folder of files, as a stream of its files; event time in UTC."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event_id once; its state is dropped once the watermark has passed."""
    return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, value) by tumbling or sliding windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", LATENESS).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    grouped = events.withWatermark("ts", LATENESS).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote to a table in the shared folder.

    In update mode a row replaces earlier ones of its ``keys``: each batch is written with its number, the highest
    counts. A batch that is run again after a failure overwrites its own folder, so the result is exact."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    columns = list(stream.columns)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/rows")
    if not keys:
        return rows.select(*columns)
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
