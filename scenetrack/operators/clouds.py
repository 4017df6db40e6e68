"""Cloud, land and clean-up masks on runs, composed of pixel rules and morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetrack.functions.masks import cloud_box
from scenetrack.operators import runs as R

#: The calibrated box rule (band 7 floor and ceiling, band 2 floor, ratios).
CALIBRATED = {"floor7": 0.21, "ceiling7": 0.51, "floor2": 0.67, "low": 0.0, "high": 0.52}


def opened_by_marker(runs: DataFrame, marker, frame: DataFrame) -> DataFrame:
    """Components of runs that hold a whole marker element."""
    return R.reconstruct(runs, R.opening(runs, marker, frame)).select(*R.KEYS, "c0", "c1")


def calibrated_clouds(px: DataFrame, frame: DataFrame, rule: Column | None = None, marker=None, smooth=None, most_filled: int = 10_000) -> DataFrame:
    """Runs of cloud: the box rule without speckle, smoothed, with clear holes of most_filled pixels at most filled;
    a clear scene with no more pixels than that is such a hole."""
    cloud = R.runs_of(px.where(cloud_box(**CALIBRATED) if rule is None else rule).select("scene_id", "row", "col"))
    kept = opened_by_marker(cloud, marker or R.box(3), frame)
    return R.fill_by_size(R.opening(kept, smooth or R.diamond(1), frame), frame, 0, most_filled)


def object_clouds(px: DataFrame, frame: DataFrame, rule: Column | None = None, marker=None, band: str = "b2", least_clear: int = 300, most_flat: int = 10_000, flat: float = 0.2) -> DataFrame:
    """Runs of cloud: bright in both bands, without speckle, widened; then clear components that are small, or not large
    and of even brightness, become cloud. Scenes without cloud give nothing."""
    bright = (F.col("b2") > 0.34) & (F.col("b7") > 0.15) if rule is None else rule
    cloud = R.dilate(opened_by_marker(R.runs_of(px.where(bright).select("scene_id", "row", "col")), marker or R.box(3), frame), R.disk(2), frame)
    clear = R.components(R.complement(cloud, frame.join(cloud.select("scene_id").distinct(), "scene_id", "left_semi")))
    sizes = R.sizes(clear)
    pixels = R.explode_runs(clear.select(*R.KEYS, "c0", "c1", "label"))
    ranges = pixels.join(px.select(*R.KEYS, "col", band), [*R.KEYS, "col"]).groupBy("scene_id", "label").agg((F.max(band) - F.min(band)).alias("range"))
    lost = sizes.join(ranges, ["scene_id", "label"]).where((F.col("area") < least_clear) | ((F.col("area") < most_flat) & (F.col("range") < flat)))
    more = clear.join(lost.select("scene_id", "label"), ["scene_id", "label"], "left_semi").select(*R.KEYS, "c0", "c1")
    return R.merge_runs(cloud.unionByName(more))


def coastal_buffer(land: DataFrame, frame: DataFrame, element=None, least: int = 0, most: int = 2_000) -> DataFrame:
    """Land widened by the element (an octagon of 49 pixels), with ocean holes of least to most pixels filled."""
    return R.fill_by_size(R.dilate(land, element or R.octagon(49), frame), frame, least, most)


def land_masks(px: DataFrame, frame: DataFrame, land: Column, element=None) -> tuple[DataFrame, DataFrame]:
    """(with coastal buffer, without) of a land rule."""
    runs = R.runs_of(px.where(land).select("scene_id", "row", "col"))
    return coastal_buffer(runs, frame, element), runs


def cleaned(runs: DataFrame, frame: DataFrame, least: int, most_hole: int, element=None) -> DataFrame:
    """Objects without specks, opened, with small holes filled: the usual clean-up of a binary object mask."""
    large = R.keep_sizes(R.components(runs), least).select(*R.KEYS, "c0", "c1")
    return R.fill_by_size(R.opening(large, element or R.diamond(1), frame), frame, 1, most_hole)


def holes_of(runs: DataFrame, frame: DataFrame, least: int = 1) -> DataFrame:
    """Runs, with labels, of the holes of a mask that have least pixels at least."""
    outside = R.components(R.complement(runs, frame))
    return R.keep_sizes(outside.join(R.on_border(outside, frame), ["scene_id", "label"], "left_anti"), least)
