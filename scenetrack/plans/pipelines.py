"""Whole segmentations of three-band scenes, composed of the operators: global, tiled and object-based.

Each takes px (scene_id, row, col, b7, b2, b1 in 0..1) of any number of scenes, one row of frame (scene_id, height, width)
per scene and land pixels as runs, and gives labelled runs. keep(name, table) is called with every named intermediate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetrack.functions import masks as M
from scenetrack.operators import basins as B
from scenetrack.operators import clouds as C
from scenetrack.operators import histograms as H
from scenetrack.operators import objects as O
from scenetrack.operators import runs as R
from scenetrack.operators import stencil as S
from scenetrack.operators import tiles as T
from scenetrack.session import cut

CELL = ["scene_id", "row", "col"]
Keep = Callable[[str, DataFrame], None]


@dataclass
class Settings:
    """What differs between images: limits in pixels and in brightness (0..1)."""

    coast: list = field(default_factory=lambda: R.octagon(49))
    cloud: Column | None = None  # a pixel rule; the calibrated one if it is not given
    cloud_hole: int = 10_000
    marker: list = field(default_factory=lambda: R.box(3))
    blocks: tuple[int, int] = (2, 2)
    pixels: int = 300  # unmasked and likely-ice pixels that make a tile worth doing
    ice: float = 0.3
    least: int = 100
    most: int = 90_000
    fit: dict = field(default_factory=dict)  # limits of objects.fit_objects
    depth: int = 5
    hole: int = 2_000
    clip: float = 0.1
    window: int = 50
    round_: list = field(default_factory=lambda: R.disk(3))


def nothing(name: str, table: DataFrame) -> None:
    pass


def prepared(px: DataFrame, frame: DataFrame, land: DataFrame, settings: Settings, keep: Keep = nothing) -> DataFrame:
    """px with grey (0..1): diffused in tiles with margins, contrast-limited, sharpened, 0 on land."""
    grey = px.withColumn("_g", M.grey(F.col("b2"), F.col("b2"), F.col("b1")))
    smooth = T.in_halo_tiles(grey, 1, lambda p: S.diffuse(p, "_g"))
    even = H.clahe(cut(smooth), "_g", frame, 8, 8, 128, settings.clip)
    sharp = T.in_halo_tiles(even, 3, lambda p: S.unsharp(p, "clahe", 1.0, 1.0, 0.0, 1.0))
    off = R.explode_runs(land.select("scene_id", "row", "c0", "c1")).withColumn("_land", F.lit(True))
    out = cut(sharp.join(off, CELL, "left").withColumn("grey", F.when(F.col("_land"), 0.0).otherwise(F.col("sharp"))).drop("_g", "clahe", "sharp", "_land"))
    keep("grey", out)
    return out


def masks_of(px: DataFrame, frame: DataFrame, land: DataFrame, settings: Settings, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Cloud and coast buffer as runs."""
    cloud = cut(C.calibrated_clouds(px, frame, settings.cloud, settings.marker, most_filled=settings.cloud_hole))
    coast = cut(R.merge_runs(C.coastal_buffer(land, frame, settings.coast, most=0)))
    keep("cloud", cloud)
    keep("coast", coast)
    return cloud, coast


def without(pixels: DataFrame, *masks: DataFrame) -> DataFrame:
    for mask in masks:
        pixels = pixels.join(R.explode_runs(mask.select("scene_id", "row", "c0", "c1")), CELL, "left_anti")
    return pixels


def object_based(px: DataFrame, frame: DataFrame, land: DataFrame, settings: Settings | None = None, keep: Keep = nothing) -> DataFrame:
    """Two binarisations in worthwhile tiles, each cleaned, split by depth and filtered, then merged object by object."""
    settings = settings or Settings()
    cloud, coast = masks_of(px, frame, land, settings, keep)
    image = prepared(px, frame, land, settings, keep)
    tiled = T.by_blocks(image, frame, *settings.blocks)
    clear = cut(without(tiled, cloud, land))
    doing = T.worth_doing(clear, F.lit(True), F.col("b2") > settings.ice, settings.pixels)
    tiled = cut(tiled.join(doing.select("scene_id", "tr", "tc"), ["scene_id", "tr", "tc"], "left_semi").withColumn("level", F.round(F.col("grey") * 255).cast("int")))
    one = without(T.tiled_threshold(tiled, "level", least_window=settings.window).select(*CELL), cloud, coast)
    two = without(T.ice_cluster_pixels(tiled, "level", F.col("b2") > settings.ice, settings.pixels).select(*CELL), cloud, coast)
    parts = []
    for name, pixels in (("threshold", one), ("clusters", two)):
        clean = cut(R.explode_runs(C.cleaned(cut(R.runs_of(pixels)), frame, settings.least, settings.hole).select("scene_id", "row", "c0", "c1")))
        split = cut(B.split_by_depth(clean, frame, settings.depth, settings.hole, element=settings.round_))
        fit = cut(O.fit_objects(split, px, coast, R.explode_runs(cloud.select("scene_id", "row", "c0", "c1")), least=settings.least, most=settings.most, **settings.fit))
        keep(name, fit)
        parts.append(fit.select("scene_id", "row", "c0", "c1", "label"))
    kept = cut(O.merged_labels(parts[0], parts[1], px, "b2", least_area=settings.least))
    chosen = [runs.join(kept.where(F.col("source") == k), ["scene_id", "label"], "left_semi").select("scene_id", "row", "c0", "c1") for k, runs in ((1, parts[0]), (2, parts[1]))]
    out = cut(R.components(R.merge_runs(chosen[0].unionByName(chosen[1]))))
    keep("objects", out)
    return out


def global_watershed(px: DataFrame, frame: DataFrame, land: DataFrame, settings: Settings | None = None, keep: Keep = nothing) -> DataFrame:
    """Two segmentations of the whole scene (the ice cluster, and a fixed level of the sharpened and brightened image); the
    boundaries that both have divide the clusters; parts are cleaned, labelled and grown by five pixels."""
    settings = settings or Settings()
    cloud, coast = masks_of(px, frame, land, settings, keep)
    image = prepared(px, frame, land, settings, keep).withColumn("level", F.round(F.col("grey") * 255).cast("int"))
    return _two_ways(image, frame, cloud, coast, settings, keep, ("scene_id",))


def tiled_watershed(px: DataFrame, frame: DataFrame, land: DataFrame, settings: Settings | None = None, keep: Keep = nothing) -> DataFrame:
    """The same with equalised tiles and clusters of each tile."""
    settings = settings or Settings()
    cloud, coast = masks_of(px, frame, land, settings, keep)
    image = T.by_blocks(prepared(px, frame, land, settings, keep), frame, *settings.blocks)
    image = cut(H.equalize_where(image, "grey", 128).withColumn("grey", F.col("adjusted")).drop("adjusted"))
    return _two_ways(image.withColumn("level", F.round(F.col("grey") * 255).cast("int")), frame, cloud, coast, settings, keep, ("scene_id", "tr", "tc"))


def _two_ways(image: DataFrame, frame: DataFrame, cloud: DataFrame, coast: DataFrame, settings: Settings, keep: Keep, keys: tuple[str, ...]) -> DataFrame:
    image = cut(image)
    clusters = without(T.ice_cluster_pixels(image, "level", F.col("b2") > settings.ice, settings.pixels, keys=keys).select(*CELL), cloud, coast)
    bright = without(image.where(M.gamma(0.5 * F.col("grey") + 0.5 * M.brighten(F.col("grey"), F.col("b2") > settings.ice, 1.3), 1.5) > 0.05).select(*CELL), cloud, coast)
    sides = []
    for name, pixels in (("clusters", clusters), ("bright", bright)):
        filled = cut(R.explode_runs(R.fill_by_size(cut(R.runs_of(pixels)), frame, 1, settings.hole)))
        keep(name, filled)
        sides.append(cut(B.watershed(filled, frame)))
    dense = [S.dense_mask(side, frame).select(*CELL).join(side, CELL, "left").withColumn("label", F.coalesce("label", F.lit(0))) for side in sides]
    # only boundaries between two basins, not those to the background
    divide = B.watershed_product(dense[0], dense[1]).join(sides[0].select(*CELL), CELL, "left_semi")
    inner = R.explode_runs(R.erode(cut(R.runs_of(sides[0].select(*CELL))), R.diamond(1), frame))
    divide = cut(divide.join(inner, CELL, "left_semi"))
    keep("divide", divide)
    parts = sides[0].select(*CELL).join(divide, CELL, "left_anti")
    labelled = R.keep_sizes(R.components(cut(R.runs_of(parts))), settings.least, settings.most)
    grown = O.expand_labels(R.explode_runs(cut(labelled).select("scene_id", "row", "c0", "c1", "label")), 5).select(*CELL, "label")
    rows = frame.select("scene_id", "height", "width")
    inside = grown.join(rows, "scene_id").where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") < F.col("width"))).drop("height", "width")
    out = cut(runs_by_label(inside))
    keep("objects", out)
    return out


def runs_by_label(pixels: DataFrame) -> DataFrame:
    """Runs of labelled pixels, each of one label."""
    line = R.Window.partitionBy("scene_id", "row", "label").orderBy("col")
    island = pixels.withColumn("_g", F.col("col") - F.row_number().over(line))
    return island.groupBy("scene_id", "row", "label", "_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_g")
