"""What a step makes once: pixels and runs are not worked out again by every use."""

from pyspark.sql import functions as F

from scenetrack.operators import distance, histograms, runs, stencil, tiles, tracking


def raster(spark, height=40, width=8):
    px = spark.range(height * width).select(F.lit(0).alias("scene_id"), (F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return px.withColumn("q", ((F.col("row") * 37 + F.col("col") * 101) % 256).cast("int"))


def times_made(df) -> int:
    """How often the raster is made anew in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")


def test_ice_clusters_meet_pixels_once(spark):
    tiled = raster(spark).withColumn("tr", F.floor(F.col("row") / 16)).withColumn("tc", F.lit(0))
    found = tiles.ice_cluster_pixels(tiled, "q", F.col("q") > 200, 5)
    assert times_made(found) == 1
    clustered = histograms.kmeans(tiled, "q", keys=("scene_id", "tr", "tc"))
    assert times_made(clustered) == 0
    flagged = tiled.where("q > 200").join(clustered.drop("n"), ["scene_id", "tr", "tc", "q"])
    want = set()
    for key in {r.tr for r in flagged.collect()}:
        counts = {r.cluster: r["count"] for r in flagged.where(F.col("tr") == key).groupBy("cluster").count().collect()}
        if sum(counts.values()) > 5:
            best = min(counts, key=lambda c: (-counts[c], c))
            levels = [r.q for r in clustered.where((F.col("tr") == key) & (F.col("cluster") == best)).collect()]
            want |= {(r.row, r.col) for r in tiled.where((F.col("tr") == key) & F.col("q").isin(levels)).collect()}
    assert want and {(r.row, r.col) for r in found.collect()} == want and found.columns == tiled.columns


def test_frames_dont_gather_scenes(spark):
    """What follows a join with the frame is dealt by rows or bands, not by the scene that the join would deal by."""
    frame = runs.kept(runs.frame_of(raster(spark)))
    assert times_made(frame) == 0 and frame.rdd.getNumPartitions() == 2
    mask = runs.runs_of(raster(spark).where("q > 128").select("scene_id", "row", "col"))
    near = distance.nearest(raster(spark).where("q > 250").select("scene_id", "row", "col", F.lit(1).cast("bigint").alias("label")), frame, 3)
    for df in (runs.dilate(mask, runs.diamond(1), frame), near):
        assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_before_they_become_pixels(spark):
    plan = stencil.dense_mask(raster(spark), runs.kept(runs.frame_of(raster(spark))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(0, (width") < plan.index("Repartition ") < plan.index("explode(sequence(0, (height")


def test_components_make_runs_once(spark):
    assert times_made(runs.components(runs.runs_of(raster(spark).where("q > 128")))) == 0


def test_cells_reach_as_far_as_times_allow(spark):
    rows = [("r", k, f"2024-01-01 0{2 * k}:00:00", f"{k}:{i}", 100, 7.0 * i + k, 3.0, 9.0, 5.0) for k in range(3) for i in range(40)]
    objects = spark.createDataFrame(rows, "region string, scene_id int, pass_time string, uuid string, area int, row_centroid double, col_centroid double, major_axis_length double, minor_axis_length double")
    objects = objects.withColumn("pass_time", F.col("pass_time").cast("timestamp"))
    assert tracking.longest_step_s(objects) == 4 * 3600 and tracking.longest_step_s(objects.where("false")) == 0
    for rule in (tracking.log_log_distance, tracking.linear_distance, tracking.stepwise_distance):
        found, wide = (tracking.candidates(objects, rule, cell).select("h_uuid", "uuid").collect() for cell in (None, 1000))
        assert found and sorted(found) == sorted(wide)
