"""Operators that SQL can't express, against brute force and shapes with known answers."""

import math
import random
import struct

import numpy as np
import pytest
from helpers import art, cells, frame, outline, pixels
from pyspark.sql import functions as F

from scenetrack.functions import geo
from scenetrack.operators import basins, clouds, contours, forest, objects, runs, stencil, tiles, tracking
from scenetrack.session import numbered
from scenetrack.sources import archive, views

BLOB = ".....##... ..#######. .########. ..######.. ...####... ....#....."


# -- contours --------------------------------------------------------------------------------------------------------


def test_outline_of_known_shapes():
    square = {(r, c) for r in range(3) for c in range(3)}
    assert outline(square) == [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]
    assert outline({(4, 4)}) == [(4, 4)]
    assert outline({(0, 0), (0, 1), (0, 2)}) == [(0, 0), (0, 1), (0, 2), (0, 1), (0, 0)]
    assert outline({(0, 0), (1, 1)}) == [(0, 0), (1, 1), (0, 0)]


@pytest.mark.parametrize("seed", range(5))
def test_outline_visits_the_outer_border(seed):
    r = random.Random(seed)
    shape, grown = {(0, 0)}, [(0, 0)]
    while len(shape) < 60:
        a, b = r.choice(grown)
        to = (a + r.choice((-1, 0, 1)), b + r.choice((-1, 0, 1)))
        if to not in shape:
            shape.add(to)
            grown.append(to)
    # background cells that reach the outside by 4-neighbours
    low, high = min(min(p) for p in shape) - 2, max(max(p) for p in shape) + 2
    outside, todo = {(low, low)}, [(low, low)]
    while todo:
        a, b = todo.pop()
        for to in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
            if low <= to[0] <= high and low <= to[1] <= high and to not in shape and to not in outside:
                outside.add(to)
                todo.append(to)
    border = {(a, b) for a, b in shape if {(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)} & outside}
    walk = outline(shape)
    assert set(walk) == border and walk[0] == walk[-1]
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_contours_by_object(spark):
    labelled = runs.components(runs.runs_of(pixels(spark, "###. #.#. ###. ...#")), 4)
    got = contours.contours(labelled).orderBy("label", "i").collect()
    by_label = {}
    for p in got:
        by_label.setdefault(p.label, []).append((p.row, p.col))
    assert sorted(map(len, by_label.values())) == [1, 9]


@pytest.mark.parametrize("seed", range(3))
def test_contours_equal_walks(spark, seed):
    r = random.Random(seed)
    scenes = ["\n".join("".join("#" if r.random() < share else "." for _ in range(23)) for _ in range(19)) for share in (0.45, 0.6, 0.85)] + ["#" * 300, "#\n" * 41, "####\n#..#\n####"]
    labelled = runs.components(runs.runs_of(pixels(spark, *scenes)), 8 if seed == 2 else 4)
    shapes, got = {}, {}
    for x in runs.explode_runs(labelled.select("scene_id", "label", "row", "c0", "c1")).collect():
        shapes.setdefault((x.scene_id, x.label), set()).add((x.row, x.col))
    for x in contours.contours(labelled).orderBy("i").collect():
        got.setdefault((x.scene_id, x.label), []).append((x.i, (x.row, x.col)))
    assert got == {k: list(enumerate(outline(v))) for k, v in shapes.items()}


def test_periodic_spline_solves_the_cyclic_system():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 7, 30, 31):
        knots = r.normal(size=n)
        values = np.append(knots, knots[0])
        matrix = np.zeros((n, n))
        for i in range(n):
            for j, w in ((i - 1, 1), (i, 4), (i + 1, 1)):
                matrix[i, j % n] += w
        bend = np.linalg.solve(matrix, 6 * (np.roll(knots, -1) - 2 * knots + np.roll(knots, 1)))
        at = np.linspace(0, n, 40)
        k = np.minimum(at.astype(int), n - 1)
        t, to = at - k, (k + 1) % n
        want = (bend[k] * (1 - t) ** 3 + bend[to] * t**3) / 6 + (knots[k] - bend[k] / 6) * (1 - t) + (knots[to] - bend[to] / 6) * t
        assert np.allclose(contours.periodic_spline(values, at), want)
        assert np.allclose(contours.periodic_spline(values, np.arange(n + 1)), values)
    assert contours.periodic_spline(np.array([5.0]), np.zeros(2)).tolist() == [5, 5]


def test_spline_passes_its_knots_and_has_straight_ends():
    values = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0])
    assert np.allclose(contours.natural_spline(values, np.arange(6)), values)
    fine = np.linspace(0, 5, 5001)
    bend = np.gradient(np.gradient(contours.natural_spline(values, fine), fine), fine)
    assert abs(bend[3]) < 0.1 and abs(bend[-4]) < 0.1 and np.abs(np.diff(bend[3:-3])).max() < 0.5
    line = np.array([[k, 2 * k] for k in range(9)])
    assert np.allclose(contours.resampled(line), [[k * 8 / 3, k * 16 / 3] for k in range(4)])
    # the reference answer of a square of nine points at four places
    square = np.array([(10, 13), (11, 13), (12, 13), (12, 14), (12, 15), (11, 15), (10, 15), (10, 14), (10, 13)])
    assert np.allclose(contours.resampled(square), [[10, 13], [12.0357, 13.5859], [10.5859, 15.0357], [10, 13]], atol=1e-4)


def test_angle_curve_of_a_circle():
    turn = np.linspace(0, 2 * np.pi, 181)
    psi, s = contours.angle_curve(np.stack([10 * np.cos(turn), 10 * np.sin(turn)], 1))
    assert np.allclose(np.diff(psi), 2 * np.pi / 180) and s[-1] == pytest.approx(20 * np.pi, rel=1e-3)
    wrapped, _ = contours.angle_curve(np.stack([np.cos(turn), np.sin(turn)], 1), unwrap=False)
    assert wrapped.min() >= 0 and wrapped.max() < 2 * np.pi


# -- distance, reconstruction, basins --------------------------------------------------------------------------------


def noisy(seed, height=12, width=14, top=6):
    r = random.Random(seed)
    return [[r.randint(0, top) for _ in range(width)] for _ in range(height)]


def raster(spark, values, name="v"):
    return spark.createDataFrame([(0, i, j, v) for i, row in enumerate(values) for j, v in enumerate(row)], f"scene_id int, row int, col int, {name} int")


def near(values, i, j):
    for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
        if 0 <= a < len(values) and 0 <= b < len(values[0]):
            yield a, b


def rebuilt(marker, mask):
    now = [[min(m, k) for m, k in zip(x, y, strict=True)] for x, y in zip(marker, mask, strict=True)]
    while True:
        then = [[min(mask[i][j], max([now[i][j], *(now[a][b] for a, b in near(now, i, j))])) for j in range(len(now[0]))] for i in range(len(now))]
        if then == now:
            return now
        now = then


@pytest.mark.parametrize("seed", range(2))
def test_grey_reconstruction_and_minima(spark, seed):
    values = noisy(seed)
    px = raster(spark, values)
    filled = {(r.row, r.col): r.filled for r in stencil.filled_minima(px, "v", 2, 6).collect()}
    wanted = rebuilt([[6 - v - 2 for v in row] for row in values], [[6 - v for v in row] for row in values])
    assert filled == {(i, j): 6 - wanted[i][j] for i in range(12) for j in range(14)}
    at = (F.col("row") == 3) & (F.col("col").isin(2, 11))
    imposed = stencil.impose_minima(px, "v", at).select("scene_id", "row", "col", F.col("imposed").cast("int").alias("w"))
    assert cells(runs.regional_minima(imposed, "w")) == {(3, 2), (3, 11)}
    opened = {(r.row, r.col): r.reconstructed for r in stencil.opened_by_reconstruction(px, "v", 1).collect()}
    worn = [[min(values[a][b] for a in range(max(i - 1, 0), min(i + 2, 12)) for b in range(max(j - 1, 0), min(j + 2, 14))) for j in range(14)] for i in range(12)]
    wanted = rebuilt(worn, values)
    assert opened == {(i, j): wanted[i][j] for i in range(12) for j in range(14)}


def test_squared_distance(spark):
    shape = art(BLOB)
    px = stencil.dense_mask(pixels(spark, BLOB), frame(spark, BLOB))
    for r in stencil.squared_distance(px, "bit", "d2", 4).collect():
        best = min((r.row - a) ** 2 + (r.col - b) ** 2 for a in range(6) for b in range(10) if (a, b) not in shape)
        assert r.d2 == (best if best <= 16 else None)


def flooded(values, markers):
    """Each pixel's marker when the least step from a flooded to a dry pixel is taken, again and again; steps by the
    higher pixel, the lower one, then the scattered order of edges."""
    out = dict(markers)

    def order(p, q):
        x = min(p, q)
        number = (x[0] * 2**31 + x[1]) * 2 + (p[0] == q[0])
        return max(at(p), at(q)), min(at(p), at(q)), int(forest.scattered(np.array([number]))[0]), number

    at = lambda p: values[p[0]][p[1]]
    while steps := [(order(p, q), q, out[p]) for p in out for q in near(values, *p) if q not in out]:
        _, q, label = min(steps)
        out[q] = label
    return out


def test_basins_equal_flooding(spark):
    values, markers = noisy(5), {(1, 1): 1, (10, 12): 2, (2, 12): 3}
    px = raster(spark, values)
    marked = spark.createDataFrame([(0, i, j, m) for (i, j), m in markers.items()], "scene_id int, row int, col int, label long")
    got = {(r.row, r.col): r.label for r in basins.basins(px, "v", marked, px).collect()}
    assert got == flooded(values, markers)


TWO = "...................... ...####.......####.... ..######.....######... .########...########.. .####################. .########...########.. ..######.....######... ...####.......####.... ......................"


def test_watershed_splits_touching_discs(spark):
    got = basins.watershed(pixels(spark, TWO), frame(spark, TWO)).collect()
    left, right = {r.label for r in got if r.col <= 7}, {r.label for r in got if r.col >= 14}
    assert len(left) == len(right) == 1 and left != right and {(r.row, r.col) for r in got} == art(TWO)


def test_split_by_depth(spark):
    for shape, parts in ((TWO, 2), (BLOB, 1)):
        got = basins.split_by_depth(pixels(spark, shape), frame(spark, shape), most=2, most_hole=3, element=runs.diamond(1))
        assert got.select("label").distinct().count() == parts
        assert cells(got) <= art(shape)


def test_watershed_product_and_regularise(spark):
    values = noisy(9, top=3)
    px = raster(spark, values, "label")
    both = {(r.row, r.col) for r in basins.watershed_product(px, px).collect()}
    assert both == {(i, j) for i in range(12) for j in range(14) if any(values[a][b] != values[i][j] for a, b in near(values, i, j))}
    grey = raster(spark, [[20 * v for v in row] for row in noisy(10)])
    none = grey.where("false").select("scene_id", "row", "col")
    got = basins.regularised(grey, "v", none, none).collect()
    assert len(got) == 168 and all(0 <= r.regular <= 255 for r in got)


# -- tiles and masks -------------------------------------------------------------------------------------------------


def test_halo_tiles_equal_whole_scenes(spark):
    px = raster(spark, noisy(3, 23, 31, 255))
    for work, reach in ((lambda p: stencil.sobel(p, "v").withColumnRenamed("gradient", "x"), 1), (lambda p: stencil.gaussian(p, "v", 1.0, "x"), 3), (lambda p: stencil.box_mean(p, "v", 2, "x"), 2)):
        whole = {(r.row, r.col): round(r.x, 9) for r in work(px).collect()}
        for side in (4, 7, 64):
            assert {(r.row, r.col): round(r.x, 9) for r in tiles.in_halo_tiles(px, reach, work, side).collect()} == whole
    with pytest.raises(ValueError):
        tiles.in_halo_tiles(px, 9, lambda p: p, 4)


def test_land_masks_and_empty_scenes(spark):
    px = stencil.dense_mask(pixels(spark, BLOB), frame(spark, BLOB))
    wide, plain = clouds.land_masks(px, frame(spark, BLOB), F.col("bit") == 1, runs.box(1))
    around = {(a + i, b + j) for a, b in art(BLOB) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= a + i < 6 and 0 <= b + j < 10}
    assert cells(plain) == art(BLOB) and cells(clouds.coastal_buffer(plain, frame(spark, BLOB), runs.box(1), most=0)) == around
    assert cells(wide) == {(i, j) for i in range(6) for j in range(10)}  # an ocean of a few pixels is a hole
    none = px.where("false").withColumn("b2", F.lit(0.0)).withColumn("b7", F.lit(0.0))
    assert clouds.object_clouds(none, frame(spark, BLOB)).count() == 0
    assert clouds.calibrated_clouds(none, frame(spark, BLOB), most_filled=59).count() == 0
    assert clouds.calibrated_clouds(none, frame(spark, BLOB)).count() == 6  # a clear scene of 60 pixels is a hole that is filled


def test_numbered_in_many_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = numbered(rows, ["x"], "n").collect()
    assert {r.x: r.n for r in got} == {x: k for k, x in enumerate(sorted(r.x for r in got), 1)}


def test_alpha_of_objects(spark):
    labelled = runs.components(runs.runs_of(pixels(spark, BLOB)))
    table = objects.object_table(labelled).join(objects.perimeters(labelled), ["scene_id", "label"])
    r = table.select(objects.circularity(F.col("area"), F.col("perimeter")).alias("c"), "area", "perimeter").first()
    assert r.c == pytest.approx(4 * math.pi * r.area / r.perimeter**2)


# -- geography, sources ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("epsg", [4326, 3857, 3413, 3031])
def test_projection_there_and_back(spark, epsg):
    sign = -1 if epsg == 3031 else 1
    rows = [(lon, sign * lat) for lon in (-170.0, -45.0, 0.0, 33.3, 120.0) for lat in (60.5, 71.0, 84.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y = geo.xy(F.col("lon"), F.col("lat"), epsg)
    lon, lat = geo.lon_lat(F.col("x"), F.col("y"), epsg)
    for r in df.withColumn("x", x).withColumn("y", y).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-6), pytest.approx(r.lat, abs=1e-6))
    with pytest.raises(ValueError):
        geo.xy(F.col("lon"), F.col("lat"), 1)


def bitmap(width, height, rows, bits):
    """An uncompressed bitmap file: rows of bytes from the top, with a grey palette for 8 bits."""
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if bits == 8 else b""
    lines = [bytes(r) + b"\0" * (-len(r) % 4) for r in rows[::-1]]
    start = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + sum(map(len, lines)), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0) + palette + b"".join(lines)


def test_image_sources(spark, tmp_path):
    colour = [[(3 * i + k) % 256 for k in range(15)] for i in range(4)]  # 5 pixels of b, g, r
    (tmp_path / "colour").mkdir()
    (tmp_path / "colour" / "a.bmp").write_bytes(bitmap(5, 4, colour, 24))
    got = {(r.row, r.col): (r.b, r.g, r.r) for r in archive.read_colour_scenes(spark, str(tmp_path / "colour")).collect()}
    assert got == {(i, j): tuple(colour[i][3 * j : 3 * j + 3]) for i in range(4) for j in range(5)}
    assert archive.read_gray_scenes(spark, str(tmp_path / "colour")).count() == 0


def test_archive_keeps_units_and_versions(spark, tmp_path):
    labelled = runs.components(runs.runs_of(pixels(spark, BLOB, "##.. ##..")))
    table = objects.object_table(labelled).join(objects.perimeters(labelled), ["scene_id", "label"]).withColumn("odd", F.lit(float("nan")))
    archive.write_archive({"objects": table}, str(tmp_path / "a"))
    back = archive.read_archive(spark, str(tmp_path / "a"), "objects")
    units = {f.name: f.metadata.get("units") for f in back.schema.fields}
    assert {k: units[k] for k in archive.UNITS} == archive.UNITS
    assert back.where("odd is null").count() == 2 and sorted(r.area for r in back.collect()) == sorted(r.area for r in table.collect())
    archive.export_properties(table.select("scene_id", "label", "area"), str(tmp_path / "csv"), {"area": "size"})
    props = archive.read_properties(spark, str(tmp_path / "csv" / "*"), "label long, size long")
    assert sorted(r.size for r in props.collect()) == sorted(r.area for r in table.collect())
    archive.export_tracks(table.select("label", F.lit("x").alias("mask")), str(tmp_path / "tracks"))
    assert spark.read.option("header", True).csv(str(tmp_path / "tracks")).columns == ["label"]


def test_case_views(spark):
    days = spark.createDataFrame([(1, "a")], "case_number int, region string").select("*", F.lit("2024-02-28").cast("date").alias("start"), F.lit("2024-03-01").cast("date").alias("end"))
    assert views.expand_cases(days).count() == 6
    assert views.subset(days, F.col("region") == "b").count() == 0


# -- tracking --------------------------------------------------------------------------------------------------------


def objects_at(spark, rows):
    """(scene, hours, row, col, area) as objects."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(s, h, float(r), float(c), a, "r") for s, h, r, c, a in rows], "scene_id int, h int, row_centroid double, col_centroid double, area long, region string")
    axis = F.sqrt(F.col("area").cast("double"))
    return df.select("scene_id", "region", (base + F.make_dt_interval(hours=F.col("h"))).alias("pass_time"), F.concat_ws(":", "scene_id", "area").alias("uuid"), "area", "row_centroid", "col_centroid", axis.alias("major_axis_length"), axis.alias("minor_axis_length"))


def test_cells_reach_as_far_as_the_rule(spark):
    two = objects_at(spark, [(0, 0, 0, 0, 500), (1, 47, 0, 500, 500)])
    assert tracking.candidates(two, tracking.linear_distance).count() == 1
    assert tracking.candidates(two).count() == 0
    with pytest.raises(ValueError):
        tracking.candidates(two, lambda dx, dt: dx < 1)


def test_trajectories_end_after_the_longest_step(spark):
    rows = objects_at(spark, [(0, 0, 0, 0, 500), (1, 24, 1, 1, 510), (2, 90, 2, 2, 515), (3, 100, 2, 2, 520)])
    got = {r.uuid: (r.trajectory_uuid, r.id) for r in tracking.tracked(rows).collect()}
    assert got == {"0:500": ("0:500", 1), "1:510": ("0:500", 1), "2:515": ("2:515", 2), "3:520": ("2:515", 2)}
    assert tracking.tracked(rows, preset="large").count() == 4 and tracking.tracked(rows.where("area < 0")).count() == 0


def test_shapes_and_curves_tell_objects_apart(spark):
    times = spark.createDataFrame([(0, 0), (1, 2)], "scene_id int, h int").select("scene_id", F.lit("r").alias("region"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("h"))).alias("pass_time"))
    square, bar = " ".join(["." * 30, *["..." + "#" * 12 + "." * 15] * 12, "." * 30]), " ".join(["." * 30, *["..." + "#" * 24 + "..."] * 6, "." * 30, *["." * 30] * 6])
    same = runs.components(runs.runs_of(pixels(spark, square, square)))
    assert tracking.track_scenes(same, times).count() == 2
    other = runs.components(runs.runs_of(pixels(spark, square, bar)))
    assert tracking.track_scenes(other, times).count() == 0


def test_stream_batches_with_gaps(spark, tmp_path):
    from scenetrack.streaming.tracker import StreamTracker

    rows = objects_at(spark, [(0, 0, 0, 0, 500), (1, 24, 1, 1, 510), (2, 30, 2, 2, 515), (3, 300, 2, 2, 520)])
    tracker = StreamTracker(spark, str(tmp_path))
    for scene, number in ((0, 0), (1, 2), (2, 5), (2, 5), (3, 6)):  # one batch comes twice
        tracker.batch(rows.where(F.col("scene_id") == scene), number)
    assert {r.uuid: r.trajectory_uuid for r in tracker.tracks(1).collect()} == {"0:500": "0:500", "1:510": "0:500", "2:515": "0:500", "3:520": "3:520"}
    assert spark.read.parquet(f"{tmp_path}/heads/batch=6").count() == 1


R1 = runs.diamond(1)

# -- whole segmentations ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["object_based", "global_watershed", "tiled_watershed"])
def test_pipelines_find_discs(spark, name):
    from scenetrack.plans import pipelines

    discs = ((14, 14, 8), (14, 44, 9))
    inside = lambda i, j: any((i - a) ** 2 + (j - b) ** 2 <= r * r for a, b, r in discs)
    rows = [(0, i, j, 0.02, 0.8 if inside(i, j) else 0.05, 0.8 if inside(i, j) else 0.05) for i in range(30) for j in range(60)]
    px = spark.createDataFrame(rows, "scene_id int, row int, col int, b7 double, b2 double, b1 double").cache()
    size = spark.createDataFrame([(0, 30, 60)], "scene_id int, height int, width int")
    land = spark.createDataFrame([(0, 29, 0, 2)], "scene_id int, row int, c0 int, c1 int")
    settings = pipelines.Settings(coast=R1, marker=R1, blocks=(1, 1), pixels=20, least=40, most=2_000, depth=2, hole=5, cloud_hole=5, window=40, round_=R1, fit={"least_cloudy": 40})
    seen = {}
    got = getattr(pipelines, name)(px, size, land, settings, lambda k, t: seen.update({k: t.count()}))
    found = {r.label for r in got.select("label").distinct().collect()}
    assert len(found) == 2 and "objects" in seen and len(seen) >= 5
    near = cells(got)
    assert all((a, b) in near for a, b, _ in discs)
