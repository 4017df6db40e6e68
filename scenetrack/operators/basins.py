"""Splitting touching objects: distance levels, marker-driven basins, and boundaries of several segmentations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetrack.operators import forest
from scenetrack.operators import objects as O
from scenetrack.operators import runs as R
from scenetrack.operators import stencil as S
from scenetrack.session import cut

CELL = ["scene_id", "row", "col"]


def levels(pixels: DataFrame, frame: DataFrame, most: int = 5, most_hole: int = 2_000, element=None) -> list[DataFrame]:
    """Labels (runs) of the pixels further than d from the background, for d from 0 to most: opened, small holes filled."""
    element = element or R.disk(3)
    pixels, frame = cut(pixels.select(*CELL)), R.kept(frame)
    near = cut(R.distance_within(pixels, most, frame))
    out = []
    for d in range(most + 1):
        deep = pixels.join(near.where(F.col("d2") <= d * d), CELL, "left_anti").select(*CELL)
        opened = cut(R.opening(cut(R.runs_of(deep)), element, frame))
        out.append(cut(R.components(R.fill_by_size(opened, frame, 0, most_hole))))
    return out


def split_by_depth(pixels: DataFrame, frame: DataFrame, most: int = 5, most_hole: int = 2_000, grow: int = 3, element=None) -> DataFrame:
    """Objects of a mask, divided where they are narrow: runs with labels.

    From the deepest level up: an object with at most one deeper object in it stays whole; one with several takes their
    labels, grown by grow pixels, and loses the rest.
    """
    steps = levels(pixels, frame, most, most_hole, element)
    now = cut(R.explode_runs(steps[-1].select("scene_id", "row", "c0", "c1", "label")))
    for level in reversed(steps[:-1]):
        whole = R.explode_runs(level.select("scene_id", "row", "c0", "c1", "label"))
        met = whole.join(now.withColumnRenamed("label", "deeper"), CELL, "left")
        several = met.groupBy("scene_id", "label").agg(F.count_distinct("deeper").alias("n")).where("n > 1").select("scene_id", "label")
        kept = whole.join(several, ["scene_id", "label"], "left_anti").select(*CELL, "label")
        grown = O.expand_labels(now.select("scene_id", "row", "col", "label"), grow).select(*CELL, "label")
        parts = whole.join(several, ["scene_id", "label"], "left_semi").select(*CELL).join(grown, CELL)
        now = cut(kept.unionByName(parts))
    # pixels of one label that no longer touch become objects of their own
    line = Window.partitionBy("scene_id", "label", "row").orderBy("col")
    island = now.withColumn("_g", F.col("col") - F.row_number().over(line)).groupBy("scene_id", "label", "row", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g")
    return R.components_of(island)


def basins(px: DataFrame, value: str, markers: DataFrame, mask: DataFrame, tile: int = forest.TILE) -> DataFrame:
    """(scene_id, row, col, label): pixels of the mask flooded from the markers (pixels with labels, not negative).

    All floods rise together, and of all steps from a flooded to a dry neighbour the one of the lowest higher pixel comes
    first, then the one of the lowest lower pixel, then one by a fixed scattered order; labels stay where they are. Pixels that no marker
    reaches are absent. This is the spanning forest rooted in the markers (forest.flooded), however far floods reach.
    """
    return forest.flooded(px.join(mask.select(*CELL), CELL, "left_semi"), value, markers, tile)


def watershed(pixels: DataFrame, frame: DataFrame, height: float = 1.0) -> DataFrame:
    """Objects of a mask split at its narrows: (scene_id, row, col, label).

    Distance to the background, shallow maxima levelled out by height, the remaining ones as markers, and their basins. In a
    scene without background all pixels are equally deep, one object.
    """
    dense = S.dense_mask(pixels, frame)
    deep = cut(S.squared_distance(dense, "bit", "d2").withColumn("v", F.when(F.col("bit") == 0, 0.0).otherwise(-F.sqrt(F.coalesce("d2", F.lit(1 << 40))))))
    flat = cut(S.filled_minima(deep, "v", height, 0.0).withColumn("filled", F.round("filled", 9)))
    lows = R.regional_minima(flat.select(*CELL, "filled"), "filled")
    markers = R.explode_runs(lows.where("filled < 0").select("scene_id", "row", "c0", "c1", "label"))
    return basins(flat, "filled", markers, pixels)


def watershed_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boundary pixels that two segmentations have in common."""
    return S.boundaries(a).select(*CELL).join(S.boundaries(b).select(*CELL), CELL, "left_semi")


def regularised(px: DataFrame, value: str, boundary: DataFrame, land: DataFrame, radius: int = 1, sigma: float = 1.0, amount: float = 2.0) -> DataFrame:
    """px with regular: local maxima raised to full brightness, boundary and land pixels dark, dark details filled, sharpened."""
    tops = S.box_extreme(px, value, radius, "_top")
    raised = tops.withColumn("_v", F.when(F.col(value) == F.col("_top"), 255.0).otherwise(F.col(value).cast("double"))).drop("_top")
    dark = boundary.select(*CELL).union(land.select(*CELL)).distinct().withColumn("_dark", F.lit(True))
    marked = raised.join(dark, CELL, "left").withColumn("_v", F.when(F.col("_dark"), 0.0).otherwise(F.col("_v"))).drop("_dark")
    filled = S.closed_by_reconstruction(marked, "_v", radius, 255.0).withColumnRenamed("reconstructed", "_f")
    return S.unsharp(filled, "_f", sigma, amount, 0.0, 255.0).withColumnRenamed("sharp", "regular").drop("_v", "_f")
