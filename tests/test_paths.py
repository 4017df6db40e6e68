"""Paths, floods and distances in rasters against plain searches."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest
from helpers import art, frame, pixels
from pyspark.sql import functions as F

from scenetrack.operators import basins, distance, forest, objects, runs, stencil


def near(p):
    i, j = p
    return (i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)


def noisy(seed, height, width, top, holes=0.0):
    r = random.Random(seed)
    return {(i, j): r.randint(0, top) for i in range(height) for j in range(width) if r.random() >= holes}


def step_order(values, p, q):
    """The order of floods' steps: higher pixel, lower pixel, then the scattered number of the edge."""
    x = min(p, q)
    number = (x[0] * 2**31 + x[1]) * 2 + (p[0] == q[0])
    return max(values[p], values[q]), min(values[p], values[q]), int(forest.scattered(np.array([number]))[0]), number


def flooded(values, markers):
    """Each pixel's marker when the least step from a flooded to a dry pixel is taken, again and again."""
    out, heap = dict(markers), []

    def offer(p):
        for q in near(p):
            if q in values and q not in out:
                heapq.heappush(heap, (step_order(values, p, q), q, out[p]))

    for p in markers:
        offer(p)
    while heap:
        _, q, label = heapq.heappop(heap)
        if q not in out:
            out[q] = label
            offer(q)
    return out


def rebuilt(marker, mask):
    """Highest markers over paths: best first."""
    out, heap = {}, [(-min(marker.get(p, -99), mask[p]), p) for p in mask]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if p not in out:
            out[p] = -v
            for q in near(p):
                if q in mask and q not in out:
                    heapq.heappush(heap, (-min(-v, mask[q]), q))
    return out


def raster(spark, scenes, name="v"):
    rows = [(k, i, j, v) for k, values in enumerate(scenes) for (i, j), v in values.items()]
    return spark.createDataFrame(rows, f"scene_id int, row int, col int, {name} int")


SCENES = [noisy(1, 13, 21, 5), noisy(2, 30, 7, 2, 0.2), noisy(3, 9, 9, 0), noisy(4, 40, 33, 9, 0.3), {(500, 3): 4}]


@pytest.mark.parametrize("tile", [1, 3, 8, 64])
def test_reconstruction_over_tiles(spark, tile):
    scenes = SCENES if tile > 1 else SCENES[:3]
    r = random.Random(tile)
    marks = [{p: r.randint(0, v) if r.random() < 0.3 else 0 for p, v in values.items()} for values in scenes]
    px = raster(spark, scenes).join(raster(spark, marks, "m"), ["scene_id", "row", "col"])
    got = {(x.scene_id, x.row, x.col): x.reconstructed for x in stencil.reconstruct_gray(px, "m", "v", tile).collect()}
    assert got == {(k, *p): v for k, (m, values) in enumerate(zip(marks, scenes)) for p, v in rebuilt(m, values).items()}


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_floods_over_tiles(spark, tile):
    r = random.Random(tile)
    marks = [{p: 10**12 + k for k, p in enumerate(r.sample(sorted(values), min(6, len(values) - 1)))} for values in SCENES[:4]]
    marked = spark.createDataFrame([(k, *p, m) for k, x in enumerate(marks) for p, m in x.items()], "scene_id int, row int, col int, label long")
    px = raster(spark, SCENES)
    got = {(x.scene_id, x.row, x.col): x.label for x in basins.basins(px, "v", marked, px, tile).collect()}
    assert got == {(k, *p): v for k, (m, values) in enumerate(zip(marks, SCENES)) for p, v in flooded(values, m).items()}


def test_floods_reach_any_distance(spark):
    """A winding corridor of some thousand pixels, the marker at one end."""
    corridor = {(i, j): 1 for i in range(0, 80, 2) for j in range(60)} | {(i, 59 if i % 4 == 1 else 0): 2 for i in range(1, 79, 2)}
    px = raster(spark, [corridor])
    marked = spark.createDataFrame([(0, 0, 0, 7)], "scene_id int, row int, col int, label long")
    got = basins.basins(px, "v", marked, px, 16)
    assert got.count() == len(corridor) and got.select("label").distinct().count() == 1


def test_empty_rasters(spark):
    px = raster(spark, [{}])
    assert stencil.reconstruct_gray(px, "v", "v").count() == 0
    assert basins.basins(px, "v", px.withColumnRenamed("v", "label"), px).count() == 0
    assert distance.nearest(px.withColumnRenamed("v", "label"), px.select("scene_id", F.lit(1).alias("height"), F.lit(1).alias("width"))).count() == 0


@pytest.mark.parametrize("reach", [None, 0, 2, 7])
def test_nearest_features(spark, reach):
    r = random.Random(9)
    sizes, features = [(17, 40), (45, 5), (1, 1), (20, 20)], []
    for k, (h, w) in enumerate(sizes):
        features += [(k, i, j, 2**40 + r.randint(0, 5)) for i in range(h) for j in range(w) if r.random() < (0.04, 0.1, 1, 0.5)[k]]
    table = spark.createDataFrame(features, "scene_id int, row int, col int, label long")
    bounds = spark.createDataFrame([(k, *s) for k, s in enumerate(sizes)], "scene_id int, height int, width int")
    want = {}
    for k, (h, w) in enumerate(sizes):
        for i in range(h):
            for j in range(w):
                best = min(((i - a) ** 2 + (j - b) ** 2, m) for s, a, b, m in features if s == k)
                if reach is None or best[0] <= reach**2:
                    want[k, i, j] = best
    got = {(x.scene_id, x.row, x.col): (x.d2, x.label) for x in distance.nearest(table, bounds, reach).collect()}
    assert got == want


def test_columns_equal_all_candidates():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = r.integers(1, 30)
        strip = pd.DataFrame({"col": r.integers(0, 4, n), "row": r.integers(0, 50, n), "label": r.integers(0, 3, n), "g2": r.integers(0, 6, n) ** 2, "lowest": 0, "highest": 49}).drop_duplicates(["col", "row"])
        got = distance.down_columns((0,), strip, None)
        assert len(got) == 50 * strip["col"].nunique()
        for x in got.itertuples():
            c = strip[strip["col"] == x.col]
            assert (x.d2, x.label) == min(zip(c["g2"] + (c["row"] - x.row) ** 2, c["label"]))


def test_labels_grow_without_a_frame(spark):
    rows = [(0, 0, 0, 5), (0, 0, 4, 3), (0, 6, 2, 9), (1, 2, 2, 8)]
    got = {(x.scene_id, x.row, x.col): (x.d2, x.label) for x in objects.expand_labels(spark.createDataFrame(rows, "scene_id int, row int, col int, label long"), 3).collect()}
    want = {}
    for s, i, j, m in rows:
        for a in range(-3, 4):
            for b in range(-3, 4):
                if a * a + b * b <= 9:
                    want[s, i + a, j + b] = min((a * a + b * b, m), want.get((s, i + a, j + b), (99, 0)))
    assert got == want


DUMBBELL = "..............................\n" + "\n".join("." + "".join("#" if min((c - 6) ** 2, (c - 22) ** 2) + (r - 7) ** 2 <= 36 or abs(r - 7) <= 1 and 6 < c < 22 else "." for c in range(28)) + "." for r in range(15)) + "\n.............................."


def test_watershed_of_large_objects(spark):
    """Depths far beyond any step: two discs and the bar between them; a scene with nothing but objects."""
    got = {(x.row, x.col): x.label for x in basins.watershed(pixels(spark, DUMBBELL), frame(spark, DUMBBELL)).collect()}
    assert set(got) == art(DUMBBELL) and got[8, 7] != got[8, 23] and got[4, 6] == got[12, 8]
    full = "####\n####"
    assert {x.label for x in basins.watershed(pixels(spark, full), frame(spark, full)).collect()} == {0}


def test_bounded_distance_reads_edges_only(spark):
    shape = DUMBBELL
    got = {(x.row, x.col): x.d2 for x in runs.distance_within(pixels(spark, shape), 3, frame(spark, shape)).collect()}
    inside = art(shape)
    want = {}
    for i, j in inside:
        best = min(a * a + b * b for a in range(-6, 7) for b in range(-6, 7) if (i + a, j + b) not in inside and 0 <= i + a < 17 and 0 <= j + b < 30)
        if best <= 9:
            want[i, j] = best
    assert got == want
