"""Rasters and object tables derived from relational tables, by gridding keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rasterize(points: DataFrame, row: Column, col: Column, *measures: Column, scene: Column | None = None) -> DataFrame:
    """Grid any table: one pixel per (scene, row, col) with aggregated measures."""
    scene = F.lit(0) if scene is None else scene
    return points.groupBy(scene.cast("int").alias("scene_id"), row.cast("int").alias("row"), col.cast("int").alias("col")).agg(*measures)


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey raster of the embeddings: row = vector, column = element, q in 0..255."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    q = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.5) * 256))).cast("int")
    return e.select(F.lit(0).alias("scene_id"), F.col("vec_id").cast("int").alias("row"), "col", q.alias("q"))


def px_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3 sums of px_embed with replicated edges, as two window passes."""
    from scenetrack.operators.stencil import box3_sum
    from scenetrack.operators.tiles import in_halo_tiles

    return in_halo_tiles(px_embed(spark, sf_dir), 1, lambda px: box3_sum(px, "q", "s"))


def mask(spark: SparkSession, sf_dir: str, threshold: int = 1200) -> DataFrame:
    return px_smooth(spark, sf_dir).where(F.col("s") > threshold).select("scene_id", "row", "col")


def scenes(spark: SparkSession, sf_dir: str, count: int = 4) -> DataFrame:
    """Pixels of count scenes with a known motion of (1, 2) pixels a step, two hours apart."""
    k = F.explode(F.array(*[F.lit(i) for i in range(count)])).alias("k")
    p = px_smooth(spark, sf_dir).select("row", "col", "s", k).where(F.col("s") > 1200 - 10 * F.col("k"))
    return p.select(F.col("k").alias("scene_id"), (F.col("row") + F.col("k")).alias("row"), (F.col("col") + 2 * F.col("k")).alias("col"))


def scene_times(spark: SparkSession, count: int = 4) -> DataFrame:
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return spark.range(count).select(F.col("id").cast("int").alias("scene_id"), F.lit("r0").alias("region"), (base + F.make_dt_interval(hours=F.col("id") * 2)).alias("pass_time"))


def px_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-band raster of the line items, 100 x 100."""
    quantity = F.sum(F.col("l_quantity").cast("bigint"))
    band = lambda total, k: ((total * k) % 256 / F.lit(255.0)).cast("double")
    lines = read(spark, sf_dir, "lineitem")
    return rasterize(lines, F.col("l_partkey") % 100, F.col("l_suppkey") % 100, band(quantity, 7).alias("b7"), band(quantity, 13).alias("b2"), band(F.sum(F.col("l_linenumber").cast("bigint")), 29).alias("b1"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), "value", "event_type")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case catalog: one row per case with region and period."""
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    start = F.to_date("o_orderdate")
    return j.select(F.col("o_orderkey").alias("case_number"), F.col("r_name").alias("region"), start.alias("start"), F.date_add(start, 2).alias("end"))


def subset(cases: DataFrame, rule: Column | None = None, order: list[Column] | None = None, first: int = 0, count: int | None = None) -> DataFrame:
    """Cases that a rule keeps, in an order, from the first (0-based) on, count of them."""
    out = cases if rule is None else cases.where(rule)
    out = out if order is None else out.orderBy(*order)
    out = out.offset(first) if first else out
    return out if count is None else out.limit(count)


def expand_cases(cases: DataFrame, satellites: tuple[str, ...] = ("aqua", "terra")) -> DataFrame:
    """One row per case, day of its period and satellite."""
    days = cases.withColumn("day", F.explode(F.sequence("start", "end"))).drop("start", "end")
    return days.withColumn("satellite", F.explode(F.array(*[F.lit(s) for s in satellites])))


def case_names(cases: DataFrame, side: str = "100km", scale: str = "250m") -> DataFrame:
    """cases (case_number, region, start, satellite) with name: number of three digits at least, region, side, day, satellite and scale."""
    digits = F.col("case_number").cast("string")
    number = F.lpad(digits, 3, "0")
    parts = F.when(F.length(digits) > 3, digits).otherwise(number), F.col("region"), F.lit(side), F.date_format("start", "yyyyMMdd"), F.col("satellite"), F.lit(scale)
    return cases.withColumn("name", F.concat_ws("-", *parts))


def case_path(cases: DataFrame, kind: str, out: str, folder: str = "data/validation_dataset", objects: str | None = None, ending: str = "png") -> DataFrame:
    """cases with out: where the image of a kind lies; NULL where the column objects (how many a case has) is 0."""
    digits = F.col("case_number").cast("string")
    number = F.when(F.length(digits) > 3, digits).otherwise(F.lpad(digits, 3, "0"))
    file = F.concat_ws("-", number, "region", F.date_format("start", "yyyyMMdd"), "satellite", F.lit(f"{kind}.{ending}"))
    path = F.concat(F.lit(f"{folder}/{kind}/"), file)
    return cases.withColumn(out, path if objects is None else F.when(F.col(objects) != 0, path))


def with_overpass(scenes: DataFrame, passes: DataFrame) -> DataFrame:
    """scenes (day, satellite, ...) with the first pass (satellite, time) of their day; NULL without one."""
    first = passes.groupBy(F.to_date("time").alias("day"), "satellite").agg(F.min("time").alias("pass_time"))
    return scenes.join(first, ["day", "satellite"], "left")


def by_row(*extra: str) -> Window:
    return Window.partitionBy("scene_id", "row", *extra).orderBy("col")
