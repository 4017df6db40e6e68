"""Tracking as scenes arrive: one batch of objects after the other, with the trajectory heads as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenetrack.operators import tracking

KEEP = ["region", "scene_id", "pass_time", "uuid", "area", "major_axis_length", "minor_axis_length", "row_centroid", "col_centroid"]


class StreamTracker:
    """State of a stream of object tables; each batch holds whole scenes that follow those before.

    Every batch writes its rows (path/rows/batch=n) and the heads after it (path/heads/batch=n), so that a repeated batch
    replaces itself and the next one reads the heads alone. Heads older than max_step_s drop out; they can't be met any more.
    """

    def __init__(self, spark: SparkSession, path: str, max_step_s: float = tracking.MAX_STEP_S):
        self.spark, self.path, self.max_step_s = spark, path, max_step_s

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/batch=*")

    def heads_before(self, number: int) -> DataFrame | None:
        """Heads after the last batch before this one, if there is any; batch numbers may have gaps."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return None
        before = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(at) if f.getPath().getName().startswith("batch=")]
        before = [k for k in before if k < number]
        return self.spark.read.parquet(f"{self.path}/heads/batch={max(before)}") if before else None

    def batch(self, objects: DataFrame, number: int) -> None:
        """For foreachBatch: link the batch's scenes to the heads before them and to each other."""
        now = objects.select(KEEP)
        known = self.heads_before(number)
        every = now if known is None else now.unionByName(known.select(KEEP))
        pairs = tracking.weighted(tracking.filtered(tracking.candidates(every, max_step_s=self.max_step_s)))
        # heads have met their own scenes' objects before; only the batch's objects are candidates now
        linked = tracking.track(every, pairs.join(now.select("uuid"), "uuid", "left_semi"), least_rows=1, max_step_s=self.max_step_s)
        mine = now.join(linked.select("uuid", "trajectory_uuid", "head_uuid"), "uuid")
        if known is not None:
            # a chain that begins at a head continues that head's trajectory
            root = known.select(F.col("uuid").alias("root"), F.col("trajectory_uuid").alias("earlier"))
            mine = mine.join(root, F.col("trajectory_uuid") == F.col("root"), "left").withColumn("trajectory_uuid", F.coalesce("earlier", "trajectory_uuid")).drop("root", "earlier")
        rows = f"{self.path}/rows/batch={number}"
        mine.write.mode("overwrite").parquet(rows)
        mine = self.spark.read.schema(mine.schema).parquet(rows)
        state = mine.select(*KEEP, "trajectory_uuid")
        state = state if known is None else state.unionByName(known.select(*KEEP, "trajectory_uuid"))
        head = state.groupBy("trajectory_uuid").agg(F.max_by(F.struct(*KEEP), F.struct("pass_time", "scene_id")).alias("h")).select("trajectory_uuid", "h.*")
        clock = head.groupBy("region").agg(F.max("pass_time").alias("clock"))
        fresh = head.join(clock, "region").where((F.unix_micros("clock") - F.unix_micros("pass_time")) / 1e6 <= self.max_step_s).drop("clock")
        fresh.write.mode("overwrite").parquet(f"{self.path}/heads/batch={number}")

    def tracks(self, least_rows: int = 2) -> DataFrame:
        """Trajectories so far with at least least_rows objects."""
        rows = self.rows().select("uuid", "trajectory_uuid", "head_uuid")
        long = rows.groupBy("trajectory_uuid").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
        return rows.join(long, "trajectory_uuid", "left_semi")


def track_stream(stream: DataFrame, path: str, checkpoint: str, max_step_s: float = tracking.MAX_STEP_S):
    """Start tracking a stream of object tables; returns the streaming query and the tracker."""
    tracker = StreamTracker(stream.sparkSession, path, max_step_s)
    query = stream.writeStream.foreachBatch(tracker.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, tracker
