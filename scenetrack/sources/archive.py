"""Archive of scene tables: one partitioned Parquet table per kind, with a version and metadata columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
#: Units of object columns, kept with the table.
UNITS = {"area": "pixels", "perimeter": "pixels", "orientation": "radians", "major_axis_length": "pixels", "minor_axis_length": "pixels"}


def write_archive(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Write each table under path, partitioned by scene; NaN becomes NULL."""
    for name, df in tables.items():
        value = {c: F.when(~F.isnan(c), F.col(c)) if t in ("double", "float") else F.col(c) for c, t in df.dtypes}
        clean = [v.alias(c, metadata={"units": UNITS[c]} if c in UNITS else {}) for c, v in value.items()]
        df.select(*clean, F.lit(VERSION).alias("archive_version")).write.mode(mode).partitionBy("scene_id").parquet(f"{path}/{name}")


def read_archive(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of an archive; unknown versions raise."""
    df = spark.read.parquet(f"{path}/{name}")
    strange = df.where(F.col("archive_version") != VERSION).select("archive_version").first()
    if strange:
        raise ValueError(f"archive version {strange[0]} is not known")
    return df.drop("archive_version")


def export_tracks(tracks: DataFrame, path: str) -> None:
    """Trajectories as CSV without masks and curves."""
    tracks.drop("mask", "psi", "mask1", "mask2", "psi1", "psi2").write.mode("overwrite").option("header", True).csv(path)


def read_properties(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Property tables of all cases at once, with the file each row came from."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("file", F.col("_metadata.file_path"))


def export_properties(objects: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """Object tables as CSV, one folder per scene, with renamed columns if names are given."""
    objects.withColumnsRenamed(names or {}).write.mode("overwrite").partitionBy("scene_id").option("header", True).csv(path)


def read_images(spark: SparkSession, path: str, channels: int) -> DataFrame:
    """Images with a number of channels as pixels: (file, row, col, one column per channel), with Spark's image source.

    One channel is q; three are b, g and r; a fourth is alpha. An image is decoded and spread within one task.
    """
    names = ["q"] if channels == 1 else ["b", "g", "r", "alpha"][:channels]
    images = spark.read.format("image").load(path).where(F.col("image.nChannels") == channels).select("image.origin", "image.width", "image.height", "image.data")

    def spread(tables):
        import numpy as np
        import pandas as pd

        for table in tables:
            for file, width, height, data in table.itertuples(index=False):
                values = np.frombuffer(data, np.uint8).reshape(height * width, channels)
                at = np.arange(height * width, dtype=np.int32)
                yield pd.DataFrame({"file": file, "row": at // width, "col": at % width} | {n: values[:, k].astype(np.int32) for k, n in enumerate(names)})

    return images.mapInPandas(spread, "file string, row int, col int, " + ", ".join(f"{n} int" for n in names))


def read_gray_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Images of one channel: (file, row, col, q)."""
    return read_images(spark, path, 1)


def read_colour_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Colour images of three bands: (file, row, col, b, g, r)."""
    return read_images(spark, path, 3)


def read_masks(spark: SparkSession, path: str, least: float = 0.1) -> DataFrame:
    """Pixels of mask images that are brighter than least (of 1): (file, row, col)."""
    return read_images(spark, path, 1).where(F.col("q") / 255 > least).select("file", "row", "col")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Object pixels of label images; 0 is background: (file, row, col, label)."""
    return read_images(spark, path, 1).where("q > 0").select("file", "row", "col", F.col("q").cast("bigint").alias("label"))
