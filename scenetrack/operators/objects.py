"""Object properties from runs: exact integer sums first, doubles at the end."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetrack.operators.distance import nearest
from scenetrack.operators.runs import explode_runs
from scenetrack.session import cut, numbered

CELL = ("scene_id", "label", "row", "col")


def moments(labelled: DataFrame) -> DataFrame:
    """Sums over each object's pixels, computed per run: n, r, c, rr, cc, rc, and the bounding box."""
    row, c0, c1 = (F.col(x).cast("bigint") for x in ("row", "c0", "c1"))
    n, columns = c1 - c0 + 1, ((c0 + c1) * (c1 - c0 + 1) / 2).cast("bigint")
    squares = lambda k: (k * (k + 1) * (2 * k + 1) / 6).cast("bigint")
    return labelled.groupBy("scene_id", "label").agg(
        F.sum(n).alias("n"), F.sum(row * n).alias("r"), F.sum(columns).alias("c"), F.sum(row * row * n).alias("rr"),
        F.sum(squares(c1) - squares(c0 - 1)).alias("cc"), F.sum(row * columns).alias("rc"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("c0").alias("min_col"), F.max("c1").alias("max_col"),
    )


def object_table(labelled: DataFrame, minimum_area: int = 1) -> DataFrame:
    """Area, centroid, inclusive box, axes and orientation of objects with more than minimum_area pixels."""
    m = moments(labelled).where(F.col("n") > minimum_area)
    n = F.col("n")
    m20, m02, m11 = ((n * F.col(a) - F.col(b) * F.col(c)).cast("double") / n for a, b, c in (("rr", "r", "r"), ("cc", "c", "c"), ("rc", "r", "c")))
    root = F.sqrt((m20 - m02) * (m20 - m02) + 4 * m11 * m11)
    axis = lambda v: 4 * F.sqrt(F.greatest(v, F.lit(0.0)) / 2 / n)
    return m.select(
        "scene_id", "label", n.alias("area"), (F.col("r") / n).alias("row_centroid"), (F.col("c") / n).alias("col_centroid"),
        "min_row", "max_row", "min_col", "max_col",
        axis(m20 + m02 + root).alias("major_axis_length"), axis(m20 + m02 - root).alias("minor_axis_length"),
        (0.5 * F.atan2(2 * m11, m20 - m02)).alias("orientation"),
    )


def neighbours(pixels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Pixels moved by each (dr, dc), with that offset's weight."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(w).alias("w")) for a, b, w in offsets])).alias("m")
    return pixels.select(*CELL, moves).select("scene_id", "label", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), F.col("m.w").alias("w"))


FOUR = [(0, 0, 1), (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1)]
EIGHT = [(0, 0, 1), *[(a, b, 2 if a == 0 or b == 0 else 10) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]]


def border_pixels(pixels: DataFrame) -> DataFrame:
    """Object pixels of which a 4-neighbour is not of the object, by one aggregation of moved pixels."""
    votes = neighbours(pixels, [(a, b, 1 if a or b else 10) for a, b, _ in FOUR])
    return votes.groupBy(*CELL).agg(F.sum("w").alias("w")).where("w >= 10 and w < 14").select(*CELL)


def perimeters(labelled: DataFrame) -> DataFrame:
    """Perimeter from border pixel types: weights by the code 1 + 2 n4 + 10 n8 of border neighbours."""
    code = neighbours(border_pixels(explode_runs(labelled)), EIGHT).groupBy(*CELL).agg(F.sum("w").alias("code"))
    # Length that each border pixel type stands for.
    length = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), 2.0**0.5).when(F.col("code").isin(13, 23), (1 + 2.0**0.5) / 2).otherwise(0.0)
    return code.groupBy("scene_id", "label").agg(F.sum(length).alias("perimeter"))


def circularity(area: Column, perimeter: Column) -> Column:
    return 4 * F.pi() * area / (perimeter * perimeter)


def convex_areas(labelled: DataFrame) -> DataFrame:
    """Shoelace area of the convex hull and pixels within it, from the extreme columns of each row.

    Each object gives two points a row, so a group is bounded by the object's height.
    """
    ends = labelled.groupBy("scene_id", "label", "row").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi"), F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))

    def hull(group):
        import pandas as pd

        points = sorted({(r, c) for r, lo, hi in zip(group["row"], group["lo"], group["hi"], strict=True) for c in (lo, hi)})
        chains = []
        for order in (points, points[::-1]):
            chain: list = []
            for p in order:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                    chain.pop()
                chain.append(p)
            chains.append(chain)
        ring = chains[0][:-1] + chains[1][:-1]
        twice = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)))
        edge = sum(math.gcd(abs(a[0] - b[0]), abs(a[1] - b[1])) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        flat = group["n"].sum() < 4 or twice == 0
        # lattice points within: Pick's theorem
        return pd.DataFrame({"scene_id": [group["scene_id"].iloc[0]], "label": [group["label"].iloc[0]], "convex_polygon": [None if flat else twice / 2], "convex_area": [None if flat else (twice + edge) / 2 + 1]})

    return ends.groupBy("scene_id", "label").applyInPandas(hull, "scene_id int, label long, convex_polygon double, convex_area double")


def relabel(labelled: DataFrame) -> DataFrame:
    """Consecutive numbers from 1 by label, per scene, on the distinct labels."""
    names = numbered(labelled.select("scene_id", "label").distinct(), ["scene_id", "label"], "number")
    first = names.groupBy("scene_id").agg(F.min("number").alias("lowest"))
    names = names.join(first, "scene_id").select("scene_id", "label", (F.col("number") - F.col("lowest") + 1).alias("number"))
    return labelled.join(names, ["scene_id", "label"]).drop("label").withColumnRenamed("number", "label")


def only_labels(labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Objects of the listed labels (scene_id, label)."""
    return labelled.join(labels.select("scene_id", "label").distinct(), ["scene_id", "label"], "left_semi")


def binary_segments(labels: DataFrame) -> DataFrame:
    """Dense label raster with mask: whether a pixel has a label; 0 is the label of an object that holds the first pixel."""
    return labels.withColumn("mask", F.col("label").isNotNull())


def without_low_contrast(pixels: DataFrame, px: DataFrame, band: str, most_area: int, least_contrast: float) -> DataFrame:
    """Object pixels less objects under most_area whose band varies by less than least_contrast."""
    facts = mean_by_label(pixels, px, band)
    flat = facts.where((F.col("n") < most_area) & (F.col("contrast") < least_contrast))
    return pixels.join(flat.select("scene_id", "label"), ["scene_id", "label"], "left_anti")


def mean_map(pixels: DataFrame, px: DataFrame, band: str) -> DataFrame:
    """Object pixels with the mean of a band over their object."""
    means = mean_by_label(pixels, px, band).select("scene_id", "label", (F.col("total") / F.col("n")).alias("mean"))
    return pixels.join(means, ["scene_id", "label"])


def cropped_masks(labelled: DataFrame, minimum_area: int = 1) -> DataFrame:
    """Cells of objects with more than minimum_area pixels, counted from the corner of the object's box."""
    box = moments(labelled).where(F.col("n") > minimum_area).select("scene_id", "label", "min_row", "min_col")
    cells = explode_runs(labelled).join(box, ["scene_id", "label"])
    return cells.select("scene_id", "label", (F.col("row") - F.col("min_row")).alias("r"), (F.col("col") - F.col("min_col")).alias("c"))


def summary(labels: DataFrame, frame: DataFrame) -> DataFrame:
    """(scene_id, labelled_fraction, label_count) of object pixels; scenes without objects have zeros."""
    counts = labels.groupBy("scene_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("label_count"))
    joined = frame.join(counts, "scene_id", "left")
    share = F.coalesce("n", F.lit(0)) / (F.col("height") * F.col("width"))
    return joined.select("scene_id", share.alias("labelled_fraction"), F.coalesce("label_count", F.lit(0)).alias("label_count"))


def validation(validated: DataFrame, measured: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case (scene_id and its other columns): recall, precision and F of its masks, and whether it was measured."""
    scores = compare_masks(validated, measured)
    done = measured.select("scene_id").distinct().withColumn("success", F.lit(True))
    return cases.join(scores, "scene_id", "left").join(done, "scene_id", "left").withColumn("success", F.coalesce("success", F.lit(False)))


def mean_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Means of the scores of validation rows; missing ones don't count."""
    return rows.groupBy(*keys).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"mean_{c}") for c in ("recall", "precision", "f_score")], F.count_if("success").alias("measured"), F.count("*").alias("cases"))


def outer_contrast(pixels: DataFrame, px: DataFrame, band: str, distance: int) -> DataFrame:
    """(scene_id, label, mean, outer, contrast): a band's mean within each object, around it up to distance, and their difference."""
    inner = mean_by_label(pixels, px, band).select("scene_id", "label", (F.col("total") / F.col("n")).alias("mean"))
    around = expand_labels(pixels, distance).where("d2 > 0").drop("d2")
    outer = mean_by_label(around, px, band).select("scene_id", "label", (F.col("total") / F.col("n")).alias("outer"))
    return inner.join(outer, ["scene_id", "label"], "left").withColumn("contrast", F.col("mean") - F.col("outer"))


def compare_objects(a: DataFrame, b: DataFrame, px: DataFrame, band: str, distance: int = 15) -> DataFrame:
    """Relevant pairs of two labellings (runs with labels): centroid distance in pixels, area error over the sum, and of
    both objects area, circularity and contrast with their surroundings."""
    sides = {}
    for name, runs in (("s1", a), ("s2", b)):
        pixels = explode_runs(runs.select("scene_id", "label", "row", "c0", "c1"))
        table = moments(runs).select("scene_id", "label", F.col("n").alias("area"), (F.col("r") / F.col("n")).alias("row_centroid"), (F.col("c") / F.col("n")).alias("col_centroid"))
        table = table.join(perimeters(runs), ["scene_id", "label"]).join(outer_contrast(pixels, px, band, distance), ["scene_id", "label"])
        table = table.withColumn("circularity", F.try_divide(4 * F.pi() * F.col("area"), F.col("perimeter") * F.col("perimeter")))
        sides[name] = pixels, table.select("scene_id", *[F.col(c).alias(f"{name}_{c}") for c in ("label", "area", "row_centroid", "col_centroid", "perimeter", "circularity", "mean", "outer", "contrast")])
    pairs = relevant_pairs(sides["s1"][0], sides["s2"][0]).select("scene_id", F.col("a").alias("s1_label"), F.col("b").alias("s2_label"))
    both = pairs.join(sides["s1"][1], ["scene_id", "s1_label"]).join(sides["s2"][1], ["scene_id", "s2_label"])
    apart = F.hypot(F.col("s1_row_centroid") - F.col("s2_row_centroid"), F.col("s1_col_centroid") - F.col("s2_col_centroid"))
    error = F.abs(F.col("s1_area") - F.col("s2_area")) / (F.col("s1_area") + F.col("s2_area"))
    return both.withColumn("distance", apart).withColumn("area_error", error)


def merged_labels(a: DataFrame, b: DataFrame, px: DataFrame, band: str, most_apart: float = 10, most_error: float = 0.25, least_area: int = 100, distance: int = 15) -> DataFrame:
    """(scene_id, source, label): objects of two labellings that a merged one keeps, source 1 or 2.

    1. Pairs that agree in place and size are matched, each object with the one of least error; the rounder one stays.
    2. Of the other pairs, each object is set against its partner of least contrast, and the one with more contrast stays.
    3. Objects without a partner stay. Objects that a kept one of an earlier step touches go, as do those under least_area.
    """
    pairs = cut(compare_objects(a, b, px, band, distance))
    key = F.struct(F.round("area_error", 9), "s1_label", "s2_label")
    close = pairs.where((F.col("distance") < most_apart) & (F.col("area_error") < most_error))
    close = close.groupBy("scene_id", "s1_label").agg(F.min_by(F.struct(*close.columns), key).alias("p")).select("p.*")
    close = close.groupBy("scene_id", "s2_label").agg(F.min_by(F.struct(*pairs.columns), key).alias("p")).select("p.*")
    pick = lambda rows, better: rows.select("scene_id", F.when(better, 1).otherwise(2).alias("source"), F.when(better, F.col("s1_label")).otherwise(F.col("s2_label")).alias("label"))
    names = {k: moments(runs).select("scene_id", F.lit(k).alias("source"), "label", F.col("n").alias("area")) for k, runs in ((1, a), (2, b))}
    every = names[1].unionByName(names[2])
    large = every.where(F.col("area") >= least_area).select("scene_id", "source", "label")
    one = cut(pick(close, F.round("s1_circularity", 9) > F.round("s2_circularity", 9)).distinct())
    touched = cut(touching_objects(a, b))

    def left_by(kept: DataFrame) -> DataFrame:
        """Objects that neither are kept nor touch a kept one."""
        lost = touched.join(kept, ["scene_id", "source", "label"]).select("scene_id", (3 - F.col("source")).alias("source"), F.col("other").alias("label"))
        return large.join(kept.union(lost).distinct(), ["scene_id", "source", "label"], "left_anti")

    still = cut(left_by(one))
    open_pairs = pairs.join(still.where("source = 1").select("scene_id", F.col("label").alias("s1_label"), F.lit(True).alias("open1")), ["scene_id", "s1_label"], "left")
    open_pairs = open_pairs.join(still.where("source = 2").select("scene_id", F.col("label").alias("s2_label"), F.lit(True).alias("open2")), ["scene_id", "s2_label"], "left").where("open1 or open2")
    better = F.round("s1_contrast", 9) > F.round("s2_contrast", 9)
    by_one = open_pairs.groupBy("scene_id", "s1_label").agg(F.min_by(F.struct(*open_pairs.columns), F.struct(F.round("s2_contrast", 9), "s2_label")).alias("p")).select("p.*")
    by_two = open_pairs.groupBy("scene_id", "s2_label").agg(F.min_by(F.struct(*open_pairs.columns), F.struct(F.round("s1_contrast", 9), "s1_label")).alias("p")).select("p.*")
    two = pick(by_one, better).union(pick(by_two, better)).distinct().join(still, ["scene_id", "source", "label"], "left_semi")
    paired = pairs.select("scene_id", F.lit(1).alias("source"), F.col("s1_label").alias("label")).union(pairs.select("scene_id", F.lit(2), "s2_label"))
    three = every.select("scene_id", "source", "label").join(paired.distinct(), ["scene_id", "source", "label"], "left_anti")
    return one.union(two).union(three).distinct().join(large, ["scene_id", "source", "label"], "left_semi")


def touching_objects(a: DataFrame, b: DataFrame) -> DataFrame:
    """(scene_id, source, label, other) of objects of two labellings that share pixels, from either side."""
    x, y = a.alias("x"), b.alias("y")
    met = x.join(y, ["scene_id", "row"]).where("x.c0 <= y.c1 and y.c0 <= x.c1").select("scene_id", F.col("x.label").alias("p"), F.col("y.label").alias("q")).distinct()
    return met.select("scene_id", F.lit(1).alias("source"), F.col("p").alias("label"), F.col("q").alias("other")).union(met.select("scene_id", F.lit(2), "q", "p"))


def fit_objects(labelled: DataFrame, px: DataFrame, coast: DataFrame, cloud: DataFrame, band: str = "b2", least: int = 300, most: int = 50_000, least_cloudy: int = 1_000, bright: float = 0.4, bright_cloudy: float = 0.7, cloudy: float = 0.5, round_: float = 0.3, round_cloudy: float = 0.5) -> DataFrame:
    """Objects that may be floes: off the coast buffer (runs), of fitting size, bright and round enough; where more than
    cloudy of an object lies under cloud (pixels), the stricter limits hold."""
    at_coast = labelled.alias("x").join(coast.select("scene_id", "row", F.col("c0").alias("d0"), F.col("c1").alias("d1")), ["scene_id", "row"]).where("c0 <= d1 and d0 <= c1").select("scene_id", "label").distinct()
    free = labelled.join(at_coast, ["scene_id", "label"], "left_anti")
    pixels = explode_runs(free.select("scene_id", "label", "row", "c0", "c1"))
    means = mean_by_label(pixels, px, band).select("scene_id", "label", (F.col("total") / F.col("n")).alias("mean"))
    hidden = pixels.join(cloud.select("scene_id", "row", "col"), ["scene_id", "row", "col"], "left_semi").groupBy("scene_id", "label").agg(F.count("*").alias("hidden"))
    facts = moments(free).select("scene_id", "label", F.col("n").alias("area")).join(perimeters(free), ["scene_id", "label"]).join(means, ["scene_id", "label"]).join(hidden, ["scene_id", "label"], "left")
    circle = F.try_divide(4 * F.pi() * F.col("area"), F.col("perimeter") * F.col("perimeter"))
    share = F.coalesce("hidden", F.lit(0)) / F.col("area")
    strict = (F.col("area") >= least_cloudy) & (F.col("mean") >= bright_cloudy) & (circle >= round_cloudy)
    usual = (F.col("mean") >= bright) & (circle >= round_)
    fit = facts.where(F.col("area").between(least, most) & F.when(share > cloudy, strict).otherwise(usual))
    return free.join(fit.select("scene_id", "label"), ["scene_id", "label"], "left_semi")


def named(objects: DataFrame, times: DataFrame) -> DataFrame:
    """objects with the pass time of their scene and a uuid."""
    return objects.join(times, "scene_id").withColumn("uuid", F.concat_ws(":", "scene_id", "label"))


def renamed(objects: DataFrame, names: dict[str, str], whole: tuple[str, ...] = ()) -> DataFrame:
    """objects with new column names; the columns in whole (by their old names) are rounded to whole numbers."""
    rounded = objects.withColumns({c: F.round(c).cast("bigint") for c in whole})
    return rounded.withColumnsRenamed(names)


def expand_labels(pixels: DataFrame, distance: int) -> DataFrame:
    """Background pixels within distance take the nearest label, of equally near ones the least; labelled pixels keep theirs."""
    return nearest(pixels.select("scene_id", "row", "col", F.col("label").cast("bigint").alias("label")), None, distance)


def mean_by_label(pixels: DataFrame, px: DataFrame, band: str) -> DataFrame:
    return pixels.join(px, ["scene_id", "row", "col"]).groupBy("scene_id", "label").agg(F.sum(band).alias("total"), F.count("*").alias("n"), (F.max(band) - F.min(band)).alias("contrast"))


def compare_masks(validated: DataFrame, measured: DataFrame) -> DataFrame:
    """Recall, precision and F of two pixel masks, per scene."""
    both = validated.select("scene_id", "row", "col", F.lit(1).alias("v")).join(measured.select("scene_id", "row", "col", F.lit(1).alias("m")), ["scene_id", "row", "col"], "full")
    counts = both.groupBy("scene_id").agg(F.count("v").alias("nv"), F.count("m").alias("nm"), F.count(F.col("v") + F.col("m")).alias("n"))
    recall, precision = F.try_divide("n", "nv"), F.try_divide("n", "nm")
    return counts.select("scene_id", recall.alias("recall"), precision.alias("precision"), F.try_divide(2 * recall * precision, recall + precision).alias("f_score"))


def relevant_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of labels of two segmentations: one's rounded centroid lies in the other, or they share more than half of either."""
    keys = ["scene_id", "row", "col"]
    x, y = a.select(*keys, F.col("label").alias("a")), b.select(*keys, F.col("label").alias("b"))
    shared = x.join(y, keys).groupBy("scene_id", "a", "b").agg(F.count("*").alias("n"))
    size_a, size_b = x.groupBy("scene_id", "a").agg(F.count("*").alias("na")), y.groupBy("scene_id", "b").agg(F.count("*").alias("nb"))
    half = shared.join(size_a, ["scene_id", "a"]).join(size_b, ["scene_id", "b"]).where("2 * n > na or 2 * n > nb").select("scene_id", "a", "b")
    centre = lambda t, k: t.groupBy("scene_id", k).agg(F.rint(F.avg("row")).cast("int").alias("row"), F.rint(F.avg("col")).cast("int").alias("col"))
    of_a = centre(x, "a").join(y, keys).select("scene_id", "a", "b")
    of_b = centre(y, "b").join(x, keys).select("scene_id", "a", "b")
    return half.union(of_a).union(of_b).distinct()
