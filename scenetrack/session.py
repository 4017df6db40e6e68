"""Session helpers: cutting the lineage of iterations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; only a local master may use a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with numbers from 1 in the given order, without bringing them to one task: ranks within range partitions, and
    the sizes of the partitions before."""
    part = "_part_" + name
    spread = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    bases = spread.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return spread.join(bases, part).withColumn(name, (F.col("_base") + rank).cast("bigint")).drop(part, "_base")
