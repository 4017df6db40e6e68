"""Streaming statistics over dated observations: daily, sliding and session windows with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetrack.session import shared_folder

LATE = "1 day"


def observation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of observations."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), "value", "event_type")


def windowed(stream: DataFrame, length: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and means of each kind in tumbling or sliding windows; works on tables as well."""
    window = F.window("time", length, slide) if slide else F.window("time", length)
    timed = stream.withWatermark("time", late) if stream.isStreaming else stream
    out = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(stream: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Sessions of each id: stretches without a gap."""
    timed = stream.withWatermark("time", late) if stream.isStreaming else stream
    out = timed.groupBy(F.session_window("time", gap).alias("w"), "id").agg(F.count("*").alias("n"))
    return out.select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a bounded aggregate stream until its input is used up and return its last result, which lies in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows")

    write = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    write.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
