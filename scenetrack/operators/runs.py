"""Run-length masks: encoding, components, morphology. Work grows with runs, not with pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetrack.operators import distance
from scenetrack.schema import RUN_ID_FACTOR
from scenetrack.session import cut

KEYS = ("scene_id", "row")
BAND = 512  # rows whose runs are contracted by one task


def run_id(row: str = "row", c0: str = "c0") -> Column:
    return F.col(row).cast("bigint") * RUN_ID_FACTOR + F.col(c0)


def runs_of(pixels: DataFrame) -> DataFrame:
    """Maximal runs of a pixel mask, by gaps and islands."""
    line = Window.partitionBy(*KEYS).orderBy("col")
    island = pixels.select(*KEYS, "col", (F.col("col") - F.row_number().over(line)).alias("island"))
    return island.groupBy(*KEYS, "island").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("island")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Union of overlapping or touching runs of each row."""
    line = Window.partitionBy(*KEYS).orderBy("c0", "c1")
    reach = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = runs.select(*KEYS, "c0", "c1", F.when(F.col("c0") <= reach + 1, 0).otherwise(1).alias("begins"))
    numbered = begins.withColumn("n", F.sum("begins").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*KEYS, "n").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("n")


def complement(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """Runs of the background within frame (scene_id, height, width)."""
    lines = frame.select("scene_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    ends = runs.select(*KEYS, "c0", "c1").unionByName(lines.select(*KEYS, F.lit(-1).alias("c0"), F.lit(-1).alias("c1"))).unionByName(lines.select(*KEYS, F.col("width").alias("c0"), F.col("width").alias("c1")))
    line = Window.partitionBy(*KEYS).orderBy("c0")
    gaps = ends.select(*KEYS, (F.col("c1") + 1).alias("c0"), (F.lead("c0").over(line) - 1).alias("c1"))
    return gaps.where("c0 <= c1").select(*KEYS, F.col("c0").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1"))


def explode_runs(runs: DataFrame) -> DataFrame:
    """Pixels of runs, with their other columns."""
    return runs.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def touching(a: DataFrame, b: DataFrame, reach: int = 0) -> DataFrame:
    """Pairs of runs (a.id, b.id) of neighbouring rows that overlap, widened by reach columns; an equi-join on the row."""
    left = a.select("scene_id", (F.col("row") + 1).alias("row"), "id", "c0", "c1")
    right = b.select("scene_id", "row", F.col("id").alias("id2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    return left.join(right, [*KEYS]).where((F.col("c0") <= F.col("d1") + reach) & (F.col("d0") <= F.col("c1") + reach)).select("scene_id", F.col("id").alias("u"), F.col("id2").alias("v"))


def components(runs: DataFrame, connectivity: int = 4) -> DataFrame:
    """runs with label, the least run id of their component (4- or 8-connected), by star contraction. Runs are made once."""
    named = cut(runs.withColumn("id", run_id()))
    edges = touching(named, named, 0 if connectivity == 4 else 1)
    labels = run_labels(edges)
    return named.join(labels, (named.scene_id == labels.scene) & (named.id == labels.vertex), "left").select(*runs.columns, F.coalesce("component", "id").alias("label"))


def components_of(runs: DataFrame) -> DataFrame:
    """4-connected parts of labelled runs: only runs of one label join; runs with the least run id as their label."""
    named = cut(runs.withColumn("id", run_id()))
    below = named.select("scene_id", "label", (F.col("row") - 1).alias("row"), F.col("id").alias("id2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    edges = named.join(below, ["scene_id", "label", "row"]).where("c0 <= d1 and d0 <= c1").select("scene_id", F.col("id").alias("u"), F.col("id2").alias("v"))
    labels = run_labels(edges)
    return named.join(labels, (named.scene_id == labels.scene) & (named.id == labels.vertex), "left").select(named.scene_id, "row", "c0", "c1", F.coalesce("component", "id").alias("label"))


def star_labels(edges: DataFrame) -> DataFrame:
    """(scene, vertex, component) of edges (scene_id, u, v): large-star and small-star steps until stars remain."""
    links = cut(edges.select("scene_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # both ways by an array: the constraints that Spark keeps of checkpoints can trip its optimiser at a union (key not found)
        both = links.select("scene_id", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("_e")).select("scene_id", "_e.u", "_e.v")
        least = both.groupBy("scene_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, ["scene_id", "u"]).select("scene_id", "v", "m").where("v <> m").distinct()
        low = large.groupBy("scene_id", "v").agg(F.min("m").alias("w"))
        small = large.join(low, ["scene_id", "v"]).select("scene_id", F.when(F.col("m") == F.col("w"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("w").alias("u"))
        links = cut(small.where("u <> v").select("scene_id", "u", "v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("scene_id", "u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select("scene_id", "u").distinct()
    return links.select(F.col("scene_id").alias("scene"), F.col("v").alias("vertex"), F.col("u").alias("component")).union(roots.select("scene_id", "u", "u"))


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (u, v) and the least vertex of the component of each: higher roots are hung under lower ones."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return names, names[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def band_of(vertex: str) -> Column:
    return F.floor(F.shiftright(vertex, 31) / BAND).cast("int")


def contracted_band(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """Vertices of a band with the least one that they reach within it; far: vertices of the next band, which are there too."""
    vertex, root = contracted(edges["u"].to_numpy(np.int64), edges["v"].to_numpy(np.int64))
    return pd.DataFrame({"scene": key[0], "vertex": vertex, "root": root, "far": (vertex >> 31) // BAND != key[1]})


def run_labels(edges: DataFrame) -> DataFrame:
    """(scene, vertex, component) of edges (scene_id, u, v) between run ids, u the one of the upper row: each band of rows is
    contracted by a task, and stars are contracted only over what meets at the bands' borders."""
    own = edges.select("scene_id", band_of("u").alias("_band"), "u", "v")
    border = own.where(band_of("v") != F.col("_band")).select("scene_id", band_of("v").alias("_band"), F.col("v").alias("u"), "v")
    kind = dict(edges.dtypes)["scene_id"]
    work = lambda key, pdf: contracted_band(key, pdf)
    local = cut(own.unionByName(border).groupBy("scene_id", "_band").applyInPandas(work, f"scene {kind}, vertex bigint, root bigint, far boolean"))
    above, below = local.where("far").select("scene", "vertex", F.col("root").alias("u")), local.where("not far").select("scene", "vertex", F.col("root").alias("v"))
    below = below.where(F.shiftright("vertex", 31) % BAND == 0)
    met = star_labels(above.join(below, ["scene", "vertex"]).select(F.col("scene").alias("scene_id"), "u", "v")).withColumnRenamed("vertex", "root")
    return local.where("not far").join(met, ["scene", "root"], "left").select("scene", "vertex", F.coalesce("component", "root").alias("component"))


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("scene_id", "label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area"))


def keep_sizes(labelled: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Components with least <= area <= most."""
    wanted = sizes(labelled)
    if least is not None:
        wanted = wanted.where(F.col("area") >= least)
    if most is not None:
        wanted = wanted.where(F.col("area") <= most)
    return labelled.join(wanted.select("scene_id", "label"), ["scene_id", "label"], "left_semi")


def largest(labelled: DataFrame) -> DataFrame:
    """The largest component of each scene; of equal ones that with the larger label."""
    best = sizes(labelled).groupBy("scene_id").agg(F.max(F.struct("area", "label")).alias("best")).select("scene_id", F.col("best.label").alias("label"))
    return labelled.join(best, ["scene_id", "label"], "left_semi")


def reconstruct(mask_runs: DataFrame, marker: DataFrame, connectivity: int = 4) -> DataFrame:
    """Components of the mask that hold a marker pixel."""
    labelled = components(mask_runs, connectivity)
    hits = labelled.alias("m").join(marker.alias("k"), [*KEYS]).where("k.c0 <= m.c1 and m.c0 <= k.c1").select("scene_id", "m.label").distinct()
    return labelled.join(hits, ["scene_id", "label"], "left_semi")


def on_border(labelled: DataFrame, frame: DataFrame) -> DataFrame:
    at_edge = (F.col("row") == 0) | (F.col("row") == F.col("height") - 1) | (F.col("c0") == 0) | (F.col("c1") == F.col("width") - 1)
    return labelled.join(frame, "scene_id").where(at_edge).select("scene_id", "label").repartition("scene_id", "label").distinct()


def clear_border(runs: DataFrame, frame: DataFrame, connectivity: int = 4) -> DataFrame:
    labelled = components(runs, connectivity)
    return labelled.join(on_border(labelled, frame), ["scene_id", "label"], "left_anti")


def fill_holes(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """Background components that do not touch the frame become foreground."""
    holes = components(complement(runs, frame), 4)
    holes = holes.join(on_border(holes, frame), ["scene_id", "label"], "left_anti")
    return merge_runs(runs.select(*KEYS, "c0", "c1").unionByName(holes.select(*KEYS, "c0", "c1")))


def fill_by_size(runs: DataFrame, frame: DataFrame, least: int, most: int) -> DataFrame:
    """Background components of least to most pixels become foreground."""
    holes = keep_sizes(components(complement(runs, frame), 4), least, most)
    return merge_runs(runs.select(*KEYS, "c0", "c1").unionByName(holes.select(*KEYS, "c0", "c1")))


# -- structuring elements: rows (dr, lo, hi), convex in each row ------------------------------------------------------


def box(radius: int) -> list[tuple[int, int, int]]:
    return [(dr, -radius, radius) for dr in range(-radius, radius + 1)]


def diamond(radius: int) -> list[tuple[int, int, int]]:
    return [(dr, abs(dr) - radius, radius - abs(dr)) for dr in range(-radius, radius + 1)]


def disk(radius: int) -> list[tuple[int, int, int]]:
    import math

    reach = [(dr, math.isqrt(radius * radius - dr * dr)) for dr in range(-radius, radius + 1)]
    return [(dr, -n, n) for dr, n in reach]


def octagon(radius: int) -> list[tuple[int, int, int]]:
    """Square of the radius with its corners cut by a third."""
    cut_off = radius // 3
    return [(dr, -min(radius, 2 * radius - cut_off - abs(dr)), min(radius, 2 * radius - cut_off - abs(dr))) for dr in range(-radius, radius + 1)]


def dilate(runs: DataFrame, element: list[tuple[int, int, int]], frame: DataFrame) -> DataFrame:
    """Each run is moved and widened by every row of the element, clipped to the frame; then runs are merged."""
    rows = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dr, lo, hi in element])
    moved = runs.select("scene_id", "row", "c0", "c1", F.explode(rows).alias("e")).join(frame, "scene_id")
    c0, c1 = F.greatest(F.col("c0") + F.col("e.lo"), F.lit(0)), F.least(F.col("c1") + F.col("e.hi"), F.col("width") - 1)
    out = moved.select("scene_id", (F.col("row") + F.col("e.dr")).alias("row"), c0.cast("int").alias("c0"), c1.cast("int").alias("c1"), "height")
    # dealt by rows again: Spark would keep the join's partitions, one a scene, for the window, and not broadcast the frame
    return merge_runs(out.where("row >= 0 and row < height and c0 <= c1").drop("height").repartition(*KEYS))


def erode(runs: DataFrame, element: list[tuple[int, int, int]], frame: DataFrame) -> DataFrame:
    """Pixels whose whole element lies in the mask; what is outside the frame counts as mask."""
    mirrored = [(-dr, -hi, -lo) for dr, lo, hi in element]
    return complement(dilate(complement(runs, frame), mirrored, frame), frame)


def opening(runs: DataFrame, element, frame: DataFrame) -> DataFrame:
    return dilate(erode(runs, element, frame), element, frame)


def closing(runs: DataFrame, element, frame: DataFrame) -> DataFrame:
    return erode(dilate(runs, element, frame), element, frame)


def subtract(a: DataFrame, b: DataFrame, frame: DataFrame) -> DataFrame:
    return intersect(a, complement(b, frame))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select(*KEYS, "c0", "c1").alias("x"), b.select(*KEYS, "c0", "c1").alias("y")
    both = x.join(y, [*KEYS]).select(*KEYS, F.greatest("x.c0", "y.c0").alias("c0"), F.least("x.c1", "y.c1").alias("c1"))
    return both.where("c0 <= c1")


def bottom_hat(runs: DataFrame, element, frame: DataFrame) -> DataFrame:
    return subtract(closing(runs, element, frame), runs, frame)


def perimeter_pixels(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixels of the mask that the erosion by a 3 x 3 box takes away."""
    return subtract(runs, erode(runs, box(1), frame), frame)


def frame_of(px: DataFrame) -> DataFrame:
    """(scene_id, height, width) of dense rasters: one row per scene."""
    return px.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def kept(frame: DataFrame) -> DataFrame:
    """frame, worked out once. It is dealt over two partitions of no key: a checkpoint of one partition would count as rightly
    partitioned for any join and draw the other side into one task."""
    return cut(frame.repartition(2))


def plateaus(px: DataFrame, value: str) -> DataFrame:
    """Runs of equal value with the label of their 4-connected plateau."""
    island = px.select(*KEYS, "col", value, (F.col("col") - F.row_number().over(Window.partitionBy(*KEYS, value).orderBy("col"))).alias("island"))
    runs = island.groupBy(*KEYS, value, "island").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("island").withColumn("id", run_id())
    below = runs.select("scene_id", (F.col("row") - 1).alias("row"), value, F.col("id").alias("id2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    edges = runs.join(below, [*KEYS, value]).where("c0 <= d1 and d0 <= c1").select("scene_id", F.col("id").alias("u"), F.col("id2").alias("v"))
    labels = run_labels(edges)
    return runs.join(labels, (runs.scene_id == labels.scene) & (runs.id == labels.vertex), "left").select(*KEYS, "c0", "c1", value, F.coalesce("component", "id").alias("label"))


def regional_minima(px: DataFrame, value: str) -> DataFrame:
    """Plateaus without a lower 4-neighbour."""
    from scenetrack.operators.stencil import COL, ROW, shift

    lower = px.select(*KEYS, "col", F.least(*[shift(value, line, by) for line, by in ((ROW, -1), (ROW, 1), (COL, -1), (COL, 1))]).alias("near"), value).where(F.col("near") < F.col(value))
    flat = plateaus(px, value)
    out = explode_runs(flat).join(lower.select(*KEYS, "col"), [*KEYS, "col"], "left_semi").select("scene_id", "label").distinct()
    return flat.join(out, ["scene_id", "label"], "left_anti")


def distance_within(pixels: DataFrame, radius: int, frame: DataFrame) -> DataFrame:
    """Squared distance of mask pixels to the nearest background pixel of the frame, where radius reaches it. Only
    background next to the mask can be nearest."""
    mask = runs_of(pixels)
    edge = explode_runs(intersect(dilate(mask, diamond(1), frame), complement(mask, frame)))
    near = distance.nearest(edge.select("scene_id", "row", "col", F.lit(0).cast("bigint").alias("label")), frame, radius).drop("label")
    return near.join(pixels.select("scene_id", "row", "col"), ["scene_id", "row", "col"], "left_semi")
