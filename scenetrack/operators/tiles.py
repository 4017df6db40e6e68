"""Tiles: grids by block count or side, pruning, window passes on halo tiles, tile-keyed thresholds and clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetrack.operators import histograms, stencil
from scenetrack.session import cut

SIDE = 256


def block_key(at: Column, blocks: int, length: Column) -> Column:
    """Tile index for a number of blocks along an axis: what does not divide makes further tiles at the edge."""
    return F.floor(at / F.greatest(F.floor(length / blocks), F.lit(1))).cast("int")


def by_blocks(px: DataFrame, frame: DataFrame, rblocks: int, cblocks: int) -> DataFrame:
    """px with tile keys tr and tc; frame has one row per scene."""
    keyed = px.join(frame.select("scene_id", "height", "width"), "scene_id")
    keyed = keyed.withColumn("tr", block_key(F.col("row"), rblocks, F.col("height"))).withColumn("tc", block_key(F.col("col"), cblocks, F.col("width")))
    return keyed.drop("height", "width")


def tile_meta(tiled: DataFrame) -> DataFrame:
    """Bounds and size of each tile that has pixels."""
    return tiled.groupBy("scene_id", "tr", "tc").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))


def worth_doing(tiled: DataFrame, unmasked: Column, likely: Column, more_than: int) -> DataFrame:
    """Tiles with more than more_than unmasked pixels and as many likely ones among them."""
    counts = tiled.groupBy("scene_id", "tr", "tc").agg(F.count_if(unmasked).alias("unmasked"), F.count_if(unmasked & likely).alias("likely"))
    return counts.where((F.col("unmasked") > more_than) & (F.col("likely") > more_than))


def in_halo_tiles(px: DataFrame, reach: int, work: Callable[[DataFrame], DataFrame], side: int = SIDE) -> DataFrame:
    """work(px) done tile by tile; equal to work on whole scenes if no result reaches further than reach pixels.

    Each tile gets a margin of reach pixels from its neighbours, so a window pass sorts lines of side + 2 reach pixels
    however long the scene is. Inside work, scene_id is a struct that names the tile; margins are dropped afterwards.
    """
    if not 0 <= reach <= side:
        raise ValueError("a margin is one tile wide at most")

    def tiles_of(at: str) -> Column:
        first, last = F.floor((F.col(at) - reach) / side), F.floor((F.col(at) + reach) / side)
        return F.sequence(F.greatest(first, F.lit(0)), last)

    spread = px.withColumn("_tr", F.explode(tiles_of("row"))).withColumn("_tc", F.explode(tiles_of("col")))
    keyed = spread.withColumn("scene_id", F.struct("scene_id", F.col("_tr").alias("tr"), F.col("_tc").alias("tc"))).drop("_tr", "_tc")
    out = work(keyed)
    own = (F.floor(F.col("row") / side) == F.col("scene_id.tr")) & (F.floor(F.col("col") / side) == F.col("scene_id.tc"))
    return out.where(own).withColumn("scene_id", F.col("scene_id.scene_id"))


def tiled_threshold(tiled: DataFrame, value: str, percent: float = 15, least_window: int = 50, dark: float = 75) -> DataFrame:
    """Pixels of each tile (tr, tc) that are brighter than their window's mean less percent of it.

    The window is an eighth of the tile's shorter side, least_window at least; dark pixels count as 0 and are never set.
    """
    lit = tiled.withColumn("_v", F.when(F.col(value) < dark, 0).otherwise(F.col(value)))
    meta = tile_meta(tiled).select("scene_id", "tr", "tc", F.least(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")).alias("short"))
    windows = [r.w for r in meta.select(F.greatest(F.round((F.col("short") + 1) / 8), F.lit(least_window)).cast("int").alias("w")).distinct().collect()]  # tiles have a few sizes
    out = None
    for window in windows:
        some = meta.where(F.greatest(F.round((F.col("short") + 1) / 8), F.lit(least_window)) == window)
        keyed = lit.join(some.select("scene_id", "tr", "tc"), ["scene_id", "tr", "tc"], "left_semi")
        keyed = keyed.withColumn("scene_id", F.struct("scene_id", "tr", "tc"))
        found = stencil.adaptive_threshold(keyed, "_v", window // 2, percent).withColumn("scene_id", F.col("scene_id.scene_id"))
        out = found if out is None else out.unionByName(found)
    return (lit.where("false") if out is None else out.drop("mean")).where(F.col(value) >= dark).drop("_v")


def tiled_kmeans(tiled: DataFrame, value: str, k: int = 4, rounds: int = 5) -> DataFrame:
    """(scene_id, tr, tc, value, cluster, label): k-means of each tile; labels of different tiles differ."""
    clustered = histograms.kmeans(tiled, value, k, rounds, ("scene_id", "tr", "tc"))
    columns = tiled.groupBy("scene_id").agg((F.max("tc") + 1).alias("_columns"))
    return clustered.join(columns, "scene_id").withColumn("label", ((F.col("tr") * F.col("_columns") + F.col("tc")) * k + F.col("cluster")).cast("bigint")).drop("_columns")


def ice_cluster_pixels(tiled: DataFrame, value: str, ice: Column, more_than: int = 0, k: int = 4, keys: tuple[str, ...] = ("scene_id", "tr", "tc")) -> DataFrame:
    """Pixels of the cluster that most ice-flagged pixels of their tile have; tiles with more_than flagged ones at most give none.

    Clusters are picked on levels and their counts; pixels meet one row a tile.
    """
    clustered = cut(histograms.kmeans(tiled, value, k, keys=keys).drop("n"))
    flagged = cut(tiled.where(ice).groupBy(*keys, value).agg(F.count("*").alias("n")))
    enough = flagged.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") > more_than).drop("_n")
    picked = histograms.modal_cluster(clustered, flagged.join(enough, [*keys], "left_semi"), value, keys)
    # clusters on a line are intervals of levels
    ends = clustered.join(picked, [*keys, "cluster"], "left_semi").groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return tiled.join(cut(ends), [*keys]).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).select(tiled.columns)
