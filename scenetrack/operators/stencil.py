"""Small neighbourhood filters as window passes: along rows, then along columns.

A pass partitions by (scene, row) or (scene, col), so its largest sort is one line of one scene. Rasters must be dense;
edges are replicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetrack.operators import distance, forest

ROW, COL = ("row", "col"), ("col", "row")  # line and place in it


def along(line: tuple[str, str]) -> Window:
    return Window.partitionBy("scene_id", line[0]).orderBy(line[1])


def shift(value: str | Column, line, by: int, otherwise: Column | None = None) -> Column:
    """Value by places further along a line; replicated (or otherwise) beyond its end."""
    value = F.col(value) if isinstance(value, str) else value
    moved = F.lead(value, by).over(along(line)) if by > 0 else F.lag(value, -by).over(along(line))
    return F.coalesce(moved, value if otherwise is None else otherwise)


def box3_sum(px: DataFrame, value: str, out: str) -> DataFrame:
    across = px.withColumn("_h", F.col(value) + shift(value, ROW, -1) + shift(value, ROW, 1))
    return across.withColumn(out, F.col("_h") + shift("_h", COL, -1) + shift("_h", COL, 1)).drop("_h")


def box_mean(px: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Mean over the (2 radius + 1) square, clipped at the scene's edge."""
    row = Window.partitionBy("scene_id", "row").orderBy("col").rangeBetween(-radius, radius)
    col = Window.partitionBy("scene_id", "col").orderBy("row").rangeBetween(-radius, radius)
    across = px.withColumn("_s", F.sum(value).over(row)).withColumn("_n", F.count(value).over(row))
    return across.withColumn(out, F.sum("_s").over(col) / F.sum("_n").over(col)).drop("_s", "_n")


def adaptive_threshold(px: DataFrame, value: str, radius: int, percent: float) -> DataFrame:
    """Pixels brighter than their window's mean less percent of it."""
    return box_mean(px, value, radius, "mean").where(F.col(value) > F.col("mean") * (1 - percent / 100))


def sobel(px: DataFrame, value: str) -> DataFrame:
    """Sobel gradient magnitude with replicated border."""
    across = px.withColumn("_d", shift(value, ROW, 1) - shift(value, ROW, -1)).withColumn("_s", shift(value, ROW, -1) + 2 * F.col(value) + shift(value, ROW, 1))
    gx = (shift("_d", COL, -1) + 2 * F.col("_d") + shift("_d", COL, 1)) / 8
    gy = (shift("_s", COL, 1) - shift("_s", COL, -1)) / 8
    return across.withColumn("gradient", F.hypot(gx, gy)).drop("_d", "_s")


def conductance(name: str, gradient: Column, k: float) -> Column:
    """Edge-stopping function by name."""
    scaled = gradient / F.lit(float(k))
    if name == "exponential":
        return F.exp(-(scaled * scaled))
    if name == "inverse_quadratic":
        return 1 / (1 + scaled * scaled)
    raise ValueError(f"no conductance function {name}")


def diffuse(px: DataFrame, value: str, rate: float = 0.1, k: float = 0.1, steps: int = 1, name: str = "exponential") -> DataFrame:
    """Edge-preserving diffusion over 4 neighbours, steps times; for few steps, unrolled."""
    if not 0 < rate <= 0.25 or k <= 0 or steps <= 0:
        raise ValueError("rate in (0, 0.25], k > 0 and steps > 0 are needed")
    for _ in range(steps):
        here = F.col(value)
        flow = F.lit(0.0)
        near = px.select("*", *[(shift(value, line, by) - here).alias(f"_{n}") for n, (line, by) in enumerate(((ROW, -1), (ROW, 1), (COL, -1), (COL, 1)))])
        for n in range(4):
            flow = flow + conductance(name, F.abs(f"_{n}"), k) * F.col(f"_{n}")
        px = near.withColumn(value, here + rate * flow).drop(*[f"_{n}" for n in range(4)])
    return px


def diffuse8(px: DataFrame, value: str, share: float = 0.1, rate: float = 0.125) -> DataFrame:
    """One step of 8-neighbour diffusion; the edge scale is a share of the scene's range, diagonals count half."""
    span = px.groupBy("scene_id").agg((share * (F.max(value) - F.min(value))).alias("_k"))
    px = px.join(span, "scene_id")
    px = px.withColumn("_l", shift(value, ROW, -1)).withColumn("_r", shift(value, ROW, 1))
    terms = [(F.col("_l"), 1.0), (F.col("_r"), 1.0), (shift(value, COL, -1), 1.0), (shift(value, COL, 1), 1.0)]
    terms += [(shift(side, COL, by), 0.5) for side in ("_l", "_r") for by in (-1, 1)]
    px = px.select("*", *[(t - F.col(value)).alias(f"_{n}") for n, (t, _) in enumerate(terms)])
    flow = F.lit(0.0)
    for n, (_, weight) in enumerate(terms):
        flow = flow + weight * F.exp(-F.pow(F.col(f"_{n}") / F.col("_k"), 2)) * F.col(f"_{n}")
    return px.withColumn(value, F.col(value) + rate * flow).drop("_k", "_l", "_r", *[f"_{n}" for n in range(len(terms))])


def gaussian(px: DataFrame, value: str, sigma: float, out: str) -> DataFrame:
    """Separable Gaussian blur for small sigma; weights are normalised over the pixels that exist."""
    import math

    radius = max(1, round(3 * sigma))
    weight = {d: math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)}

    def blur(source: str, line) -> Column:
        total, norm = F.lit(0.0), F.lit(0.0)
        for d, w in weight.items():
            moved = F.col(source) if d == 0 else (F.lead(source, d).over(along(line)) if d > 0 else F.lag(source, -d).over(along(line)))
            total = total + F.coalesce(w * moved, F.lit(0.0))
            norm = norm + F.when(moved.isNotNull(), w).otherwise(0.0)
        return total / norm

    return px.withColumn("_h", blur(value, ROW)).withColumn(out, blur("_h", COL)).drop("_h")


def unsharp(px: DataFrame, value: str, sigma: float, amount: float, threshold: float, top: float) -> DataFrame:
    """value + amount * (value - blur), clamped to 0..top; kept as it is where the difference is under threshold."""
    blurred = gaussian(px, value, sigma, "_b")
    difference = F.col(value) - F.col("_b")
    sharp = F.least(F.lit(float(top)), F.greatest(F.lit(0.0), F.col(value) + amount * difference))
    return blurred.withColumn("sharp", F.when(F.abs(difference) < threshold, F.col(value).cast("double")).otherwise(sharp)).drop("_b")


def neighbourhood_code(dense: DataFrame, bit: str = "bit") -> DataFrame:
    """9-bit code of the 3 x 3 neighbourhood: three bits per column, left column lowest, top row lowest; 0 outside."""
    zero = F.lit(0)
    b = F.col(bit)
    column = shift(b, COL, -1, zero) + 2 * b + 4 * shift(b, COL, 1, zero)
    coded = dense.withColumn("_c", column.cast("int"))
    return coded.withColumn("code", (shift("_c", ROW, -1, zero) + 8 * F.col("_c") + 64 * shift("_c", ROW, 1, zero)).cast("int")).drop("_c")


def boundaries(labels: DataFrame, label: str = "label") -> DataFrame:
    """Pixels of a dense label raster with a differently labelled 4-neighbour."""
    here = F.col(label)
    return labels.select("*", *[(shift(label, line, by) != here).alias(f"_{n}") for n, (line, by) in enumerate(((ROW, -1), (ROW, 1), (COL, -1), (COL, 1)))]).where("_0 or _1 or _2 or _3").drop("_0", "_1", "_2", "_3")


def branch_points(coded: DataFrame) -> DataFrame:
    """Branch points of skeletons from neighbourhood codes (code): candidates with several background groups, but not
    those with two groups that have a pixel of more groups around them."""
    from scenetrack.functions import masks

    parts = F.element_at(F.lit(masks.background_parts()), F.col("code") + 1)
    px = coded.withColumn("parts", parts).withColumn("_m", (F.col("parts") > 2).cast("int"))
    zero = F.lit(0)
    px = px.withColumn("_m", F.greatest(F.col("_m"), shift("_m", ROW, -1, zero), shift("_m", ROW, 1, zero)))
    px = px.withColumn("_m", F.greatest(F.col("_m"), shift("_m", COL, -1, zero), shift("_m", COL, 1, zero)))
    found = F.col("code").isin(masks.branch_candidates()) & (F.col("parts") != 1) & ~((F.col("parts") == 2) & (F.col("_m") == 1))
    return px.where(found).drop("_m", "parts")


def reconstruct_gray(px: DataFrame, marker: str, mask: str, tile: int = forest.TILE) -> DataFrame:
    """px with reconstructed: the marker spreads to 4-neighbours, never above the mask, until nothing changes (grey
    reconstruction by dilation), from one spanning forest of the pixels."""
    kind = px.select(F.least(marker, mask)).schema[0].dataType
    reached = forest.highest_reached(px, marker, mask, tile)
    return px.join(reached.select("scene_id", "row", "col", F.col("reached").cast(kind).alias("reconstructed")), ["scene_id", "row", "col"])


def opened_by_reconstruction(px: DataFrame, value: str, radius: int) -> DataFrame:
    """px with reconstructed: bright details smaller than a square of the radius are gone, all other edges stay."""
    worn = box_extreme(px, value, radius, "_marker", F.min)
    return reconstruct_gray(worn, "_marker", value).drop("_marker")


def closed_by_reconstruction(px: DataFrame, value: str, radius: int, top: float) -> DataFrame:
    """px with reconstructed: dark details smaller than a square of the radius are filled; done on the inverse of top."""
    inverse = px.withColumn("_inverse", top - F.col(value))
    return opened_by_reconstruction(inverse, "_inverse", radius).withColumn("reconstructed", top - F.col("reconstructed")).drop("_inverse")


def dense_mask(pixels: DataFrame, frame: DataFrame) -> DataFrame:
    """All pixels of the frame with bit: 1 where the mask has a pixel. Rows are dealt to all cores before they become pixels."""
    rows = frame.select("scene_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    rows = rows.repartition(frame.sparkSession.sparkContext.defaultParallelism)
    every = rows.select("scene_id", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    some = pixels.select("scene_id", "row", "col", F.lit(1).alias("bit"))
    return every.join(some, ["scene_id", "row", "col"], "left").withColumn("bit", F.coalesce("bit", F.lit(0)))


def box_extreme(px: DataFrame, value: str, radius: int, out: str, of=F.max) -> DataFrame:
    """Grey dilation (of F.max) or erosion (of F.min) by a square of the radius, clipped at the scene's edge."""
    row = Window.partitionBy("scene_id", "row").orderBy("col").rangeBetween(-radius, radius)
    col = Window.partitionBy("scene_id", "col").orderBy("row").rangeBetween(-radius, radius)
    return px.withColumn("_x", of(value).over(row)).withColumn(out, of("_x").over(col)).drop("_x")


def impose_minima(px: DataFrame, value: str, at: Column, step: float = 1.0) -> DataFrame:
    """px with imposed: an image whose only regional minima are the pixels of the mask at.

    Elsewhere the image is raised by step and to what must be crossed to reach the mask (a reconstruction of the inverse)."""
    ends = px.groupBy("scene_id").agg((F.max(value) + 2 * step).alias("_top"), (F.min(value) - step).alias("_low"))
    ready = px.join(ends, "scene_id").withColumn("_marker", F.when(at, F.col("_top") - F.col("_low")).otherwise(F.lit(0.0)))
    ready = ready.withColumn("_mask", F.col("_top") - F.when(at, F.col("_low")).otherwise(F.col(value) + step))
    return reconstruct_gray(ready, "_marker", "_mask").withColumn("imposed", F.col("_top") - F.col("reconstructed")).drop("_top", "_low", "_marker", "_mask", "reconstructed")


def filled_minima(px: DataFrame, value: str, height: float, top: float) -> DataFrame:
    """px with filled: minima shallower than height are gone (the h-minima transform); top bounds the values."""
    ready = px.withColumn("_mask", top - F.col(value)).withColumn("_marker", top - F.col(value) - height)
    return reconstruct_gray(ready, "_marker", "_mask").withColumn("filled", top - F.col("reconstructed")).drop("_mask", "_marker", "reconstructed")


def squared_distance(px: DataFrame, bit: str, out: str, radius: int | None = None) -> DataFrame:
    """Exact squared distance of the pixels of a dense raster to the nearest unset one; NULL beyond the radius, if one is
    given, and where a scene has no unset pixel."""
    extent = px.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    unset = px.where(F.col(bit) == 0).select("scene_id", "row", "col", F.lit(0).cast("bigint").alias("label"))
    found = distance.nearest(unset, extent, radius).select("scene_id", "row", "col", F.col("d2").alias(out))
    return px.join(found, ["scene_id", "row", "col"], "left")
