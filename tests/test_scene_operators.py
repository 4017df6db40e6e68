import math

import pytest
from helpers import art, cells, frame, pixels, values
from pyspark.sql import functions as F

from scenetrack.functions import geo, masks
from scenetrack.operators import histograms, objects, runs, stencil, tracking

SHAPES = "##...# #..... ...##. ...##. #....."
RING = "..... .###. .#.#. .###. ....."


def mask(spark, text):
    return runs.runs_of(pixels(spark, text))


def test_runs_and_complement(spark):
    m = mask(spark, SHAPES)
    assert cells(m) == art(SHAPES)
    assert cells(runs.complement(m, frame(spark, SHAPES))) == {(r, c) for r in range(5) for c in range(6)} - art(SHAPES)


@pytest.mark.parametrize(("connectivity", "parts"), [(4, 2), (8, 1)])
def test_components_diagonal(spark, connectivity, parts):
    labelled = runs.components(mask(spark, "#. .#"), connectivity)
    assert labelled.select("label").distinct().count() == parts


def test_components_keep_scenes_apart(spark):
    px = pixels(spark, "## ..", "## ##")
    sizes = values(runs.sizes(runs.components(runs.runs_of(px))), "scene_id", "area")
    assert sizes == {(0, 2), (1, 4)}


def test_snake_is_one_component(spark):
    snake = "##### ....# ##### #.... #####"
    assert values(runs.sizes(runs.components(mask(spark, snake))), "area") == {(17,)}


def test_empty_mask(spark):
    empty = mask(spark, "... ...")
    assert runs.components(empty).count() == 0
    assert objects.object_table(runs.components(empty)).count() == 0
    assert len(cells(runs.dilate(empty, runs.box(1), frame(spark, "... ...")))) == 0


def test_fill_holes_and_border(spark):
    f = frame(spark, RING)
    assert (2, 2) in cells(runs.fill_holes(mask(spark, RING), f))
    assert (2, 2) not in cells(runs.fill_by_size(mask(spark, RING), f, 2, 9))
    assert cells(runs.clear_border(mask(spark, SHAPES), frame(spark, SHAPES))) == {(2, 3), (2, 4), (3, 3), (3, 4)}


def test_erosion_counts_outside_as_set(spark):
    full = "### ### ###"
    assert cells(runs.erode(mask(spark, full), runs.box(1), frame(spark, full))) == art(full)
    assert cells(runs.erode(mask(spark, RING), runs.diamond(1), frame(spark, RING))) == set()


def test_opening_and_closing_are_idempotent(spark):
    f = frame(spark, SHAPES)
    for step in (runs.opening, runs.closing):
        once = step(mask(spark, SHAPES), runs.box(1), f)
        assert cells(step(once, runs.box(1), f)) == cells(once)


def test_reconstruct_and_largest(spark):
    marker = mask(spark, "#..... ...... ...... ...... ......")
    assert cells(runs.reconstruct(mask(spark, SHAPES), marker)) == {(0, 0), (0, 1), (1, 0)}
    assert cells(runs.largest(runs.components(mask(spark, SHAPES)))) == {(2, 3), (2, 4), (3, 3), (3, 4)}


def test_object_table_of_a_bar(spark):
    row = objects.object_table(runs.components(mask(spark, "...... .####. ......"))).first()
    assert (row.area, row.min_row, row.max_row, row.min_col, row.max_col) == (4, 1, 1, 1, 4)
    assert row.row_centroid == 1 and row.col_centroid == 2.5
    assert row.major_axis_length == pytest.approx(4 * math.sqrt(5 / 4)) and row.minor_axis_length == 0


def test_minimum_area_is_exclusive(spark):
    labelled = runs.components(mask(spark, "#.##"))
    assert objects.object_table(labelled, 1).count() == 1


def test_perimeter_of_a_square(spark):
    square = "...... .####. .####. .####. .####. ......"
    assert objects.perimeters(runs.components(mask(spark, square))).first().perimeter == 12


def test_convex_areas(spark):
    got = values(objects.convex_areas(runs.components(mask(spark, "#### #### ####"))), "convex_polygon", "convex_area")
    assert got == {(6.0, 12.0)}
    assert values(objects.convex_areas(runs.components(mask(spark, "#### ...."))), "convex_area") == {(None,)}


def test_bridge_rule_counts():
    codes = set(masks.bridge_codes())
    assert all(c in codes for c in range(512) if c >> 4 & 1)
    assert (1 << 0 | 1 << 8) in codes and (1 << 0 | 1 << 2) not in codes and (1 << 1) not in codes


def test_h_break(spark):
    dense = spark.createDataFrame([(0, r, c, int(ch == "#")) for r, line in enumerate("#.# ### #.#".split()) for c, ch in enumerate(line)], "scene_id int, row int, col int, bit int")
    left = stencil.neighbourhood_code(dense).where((F.col("bit") == 1) & ~masks.h_breaks(F.col("code")))
    assert values(left, "row", "col") == art("#.# #.# #.#")


def test_sobel_is_zero_on_flat(spark):
    flat = spark.createDataFrame([(0, r, c, 7) for r in range(4) for c in range(5)], "scene_id int, row int, col int, q int")
    assert values(stencil.sobel(flat, "q"), "gradient") == {(0.0,)}
    even = stencil.diffuse8(flat.withColumn("v", F.col("q") * 1.0 + F.col("row")), "v")
    assert even.agg(F.abs(F.avg("v") - 8.5)).first()[0] < 1e-9


def test_diffusion_parameters(spark):
    flat = spark.range(1).select(F.lit(0).alias("scene_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("v"))
    for bad in ({"rate": 0.3}, {"k": 0}, {"steps": 0}, {"name": "none"}):
        with pytest.raises(ValueError):
            stencil.diffuse(flat, "v", **bad)


@pytest.mark.parametrize(("length", "side", "tiles"), [(100, 30, 3), (100, 40, 3), (100, 100, 1), (90, 30, 3)])
def test_last_tile_absorbs_small_rest(spark, length, side, tiles):
    at = spark.range(length).select(histograms.tile_key(F.col("id"), side, length).alias("t"))
    assert at.select("t").distinct().count() == tiles


def test_peak_is_the_prominent_one(spark):
    counts = [1, 1, 1, 2, 9, 2, 1, 1, 1, 4, 30, 4, 1, 1, 1, 1]
    px = spark.createDataFrame([(0, (b + 0.5) / 16) for b, n in enumerate(counts) for _ in range(n)], "scene_id int, v double")
    assert histograms.peaks(histograms.histogram(px, "v", 16), 16).first().edge == 10 / 16


def test_kmeans_separates_levels(spark):
    px = spark.createDataFrame([(0, v) for v in [1, 2, 3, 100, 101, 102]], "scene_id int, q int")
    got = {r.q: r.cluster for r in histograms.kmeans(px, "q", k=2).collect()}
    assert {got[v] for v in (1, 2, 3)} == {0} and {got[v] for v in (100, 101, 102)} == {1}


def test_threshold_functions(spark):
    d = spark.createDataFrame([(3600.0, 2000.0), (3600.0, 3000.0), (8 * 86400.0, 1.0), (1e9, 60000.0), (1e9, 60001.0)], "dt double, dx double")
    log = [r[0] for r in d.select(tracking.log_log_distance(F.col("dx"), F.col("dt"))).collect()]
    step = [r[0] for r in d.select(tracking.stepwise_distance(F.col("dx"), F.col("dt"))).collect()]
    assert log == [True, False, False, False, False] and step == [True, True, True, True, False]


def scene_table(spark, rows):
    return spark.createDataFrame(rows, "region string, scene_id int, pass_time timestamp, uuid string, area long, row_centroid double, col_centroid double, major_axis_length double, minor_axis_length double")


def test_tracking_over_a_gap(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("r", 0, t(0), "a0", 400, 10.0, 10.0, 20.0, 10.0), ("r", 0, t(0), "b0", 900, 80.0, 80.0, 40.0, 20.0), ("r", 1, t(1), "b1", 905, 81.0, 80.0, 40.0, 20.0), ("r", 2, t(2), "a2", 398, 11.0, 11.0, 20.0, 10.0), ("r", 2, t(2), "b2", 903, 82.0, 80.0, 40.0, 20.0), ("s", 2, t(2), "x", 400, 10.0, 10.0, 20.0, 10.0)]
    objects_ = scene_table(spark, rows)
    pairs = tracking.weighted(tracking.filtered(tracking.candidates(objects_)))
    got = {r.uuid: (r.trajectory_uuid, r.head_uuid) for r in tracking.track(objects_, pairs).collect()}
    assert got == {"a0": ("a0", None), "a2": ("a0", "a0"), "b0": ("b0", None), "b1": ("b0", "b0"), "b2": ("b0", "b1")}


def test_mutual_best_is_not_assignment(spark):
    pairs = spark.createDataFrame([("h1", "c1", 1.0), ("h1", "c2", 2.0), ("h2", "c1", 1.5)], "h_uuid string, uuid string, w double")
    assert values(tracking.mutual_best(pairs), "h_uuid", "uuid") == {("h1", "c1")}


def test_register_finds_the_turn(spark):
    shape = [(r, c) for r in range(-12, 13) for c in range(-4, 5)] + [(r, c) for r in range(8, 13) for c in range(4, 9)]
    first = spark.createDataFrame([("a", r + 20, c + 20) for r, c in shape], "uuid string, row int, col int")
    turned = tracking.rotated_cells(first, [30.0]).select(F.lit("b").alias("uuid"), (F.col("r") + 30).cast("int").alias("row"), (F.col("c") + 30).cast("int").alias("col"))
    pairs = spark.createDataFrame([("a", "b")], "u1 string, u2 string")
    assert abs(tracking.register(first, turned, pairs, 15).first().angle - 30) <= 15


def test_geo_round_values(spark):
    one = spark.range(1)
    lon, lat = geo.lon_lat(F.lit(0.0), F.lit(-2_000_000.0), 3413)
    x, y = one.select(lon, lat).first()
    assert x == pytest.approx(-45) and 71 < y < 72.5
    with pytest.raises(ValueError):
        geo.lon_lat(F.lit(0.0), F.lit(0.0), 32633)


def test_gray_reconstruction_equals_brute_force(spark):
    import random

    r = random.Random(3)
    mask_ = {(i, j): r.randint(0, 9) for i in range(7) for j in range(9)}
    marker = {k: max(0, v - r.randint(0, 9)) for k, v in mask_.items()}
    want, before = dict(marker), None
    while want != before:
        before = dict(want)
        want = {(i, j): min(mask_[i, j], max(before.get(p, 0) for p in ((i, j), (i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)))) for i, j in mask_}
    px = spark.createDataFrame([(0, i, j, marker[i, j], mask_[i, j]) for i, j in mask_], "scene_id int, row int, col int, marker int, mask int")
    got = {(x.row, x.col): x.reconstructed for x in stencil.reconstruct_gray(px, "marker", "mask", 2).collect()}
    assert got == want


def test_shape_difference_of_turned_bars(spark):
    flat = [("a", 5, c, math.pi / 2) for c in range(20)]
    upright = [("b", r, 7, 0.0) for r in range(20)]
    kind = "uuid string, row int, col int, orientation double"
    pairs = spark.createDataFrame([("a", "b")], "u1 string, u2 string")
    got = tracking.shape_difference(spark.createDataFrame(flat, kind), spark.createDataFrame(upright, kind), pairs).first()
    assert got.difference <= 2 and got.scaled <= 0.1


def test_optimal_tile_side(spark):
    got = spark.createDataFrame([(3, 10, 7), (5, 10, 20), (2, 4, 4)], "s int, h int, w int").select(masks.optimal_tile_side(F.col("s"), F.col("h"), F.col("w")).alias("t")).collect()
    assert [r.t for r in got] == [2, 5, 2]


def test_stream_tracking_equals_batch(spark, tmp_path):
    from scenetrack.sources import archive, views
    from scenetrack.streaming.tracker import StreamTracker

    d = "/root/testdata/sf0.001"
    labels = runs.components(runs.runs_of(views.scenes(spark, d, 3)))
    table = objects.object_table(labels, 29).join(views.scene_times(spark, 3), "scene_id").withColumn("uuid", F.concat_ws(":", "scene_id", "label"))
    archive.write_archive({"objects": table}, f"{tmp_path}/archive")
    table = archive.read_archive(spark, f"{tmp_path}/archive", "objects").cache()
    pairs = tracking.weighted(tracking.filtered(tracking.candidates(table)))
    whole = values(tracking.track(table, pairs), "uuid", "trajectory_uuid")
    tracker = StreamTracker(spark, f"{tmp_path}/state")
    for k in range(3):
        tracker.batch(table.where(F.col("scene_id") == k), k)
    assert len(whole) > 20 and values(tracker.tracks(), "uuid", "trajectory_uuid") == whole


def test_archive_rejects_other_versions(spark, tmp_path):
    from scenetrack.sources import archive

    spark.sql("select 1 as scene_id, '99' as archive_version").write.parquet(f"{tmp_path}/t")
    with pytest.raises(ValueError):
        archive.read_archive(spark, str(tmp_path), "t")


def test_exact_percentiles_of_any_values(spark):
    import random

    import numpy as np

    from scenetrack.operators import histograms

    r = random.Random(8)
    scenes = [[r.gauss(0, 1e6) for _ in range(2_000)], [float(r.randint(0, 9)) for _ in range(501)], [7.5], [1.0, 1.0 + 2**-52, 1.0 + 2**-51, -1e300, 1e300], [3.0] * 40]
    px = spark.createDataFrame([(k, v) for k, x in enumerate(scenes) for v in [*x, None]], "scene_id int, v double")
    shares = [0.0, 0.01, 0.5, 0.73, 0.99, 1.0]
    got = {x.scene_id: x.p for x in histograms.exact_percentiles(px, "v", shares).collect()}
    want = {x.scene_id: x.p for x in px.groupBy("scene_id").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("p")).collect()}
    assert got == want and np.allclose(got[0], np.quantile(scenes[0], shares))
