"""Histograms, contrast and clustering on binned intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenetrack.session import cut


def histogram(px: DataFrame, value: str, bins: int, keys: tuple[str, ...] = ("scene_id",), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts of equal bins over low..high; the top value falls into the last bin; empty bins are 0."""
    at = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = px.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    every = px.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def peaks(hist: DataFrame, bins: int, threshold: float = 0.3, reach: int = 3, least: float = 0.01) -> DataFrame:
    """Left edge of the most prominent local maximum of each scene's histogram, NULL if there is none.

    Counts are shares of the mass above threshold, but all bins are searched. Prominence is the height over the higher
    of the two lowest points towards the next higher bin (or the end) on either side. A scene has few bins.
    """
    line = Window.partitionBy("scene_id").orderBy("bin")
    near = line.rowsBetween(-reach, reach)
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.col("bin") / F.lit(float(bins))
    mass = F.sum(F.when(edge > threshold, F.col("n")).otherwise(0)).over(every)
    inside = (F.col("bin") >= reach) & (F.col("bin") < bins - reach)
    shares = hist.withColumn("share", F.when(mass > 0, F.col("n") / mass)).withColumn("top", (F.col("n") == F.max("n").over(near)) & inside & (F.col("n") > F.lag("n").over(line)) & (F.col("n") > F.lead("n").over(line)))
    all_bins = shares.select("scene_id", F.col("bin").alias("b"), F.col("share").alias("s"))
    tops = shares.where("top and share is not null").select("scene_id", "bin", "share")
    wide = tops.join(all_bins, "scene_id")
    walls = wide.groupBy("scene_id", "bin", "share").agg(F.max(F.when((F.col("b") < F.col("bin")) & (F.col("s") > F.col("share")), F.col("b"))).alias("lw"), F.min(F.when((F.col("b") > F.col("bin")) & (F.col("s") > F.col("share")), F.col("b"))).alias("rw"))
    lows = walls.join(all_bins, "scene_id").groupBy("scene_id", "bin", "share").agg(
        F.min(F.when((F.col("b") < F.col("bin")) & (F.col("b") > F.coalesce("lw", F.lit(-1))), F.col("s"))).alias("left"),
        F.min(F.when((F.col("b") > F.col("bin")) & (F.col("b") < F.coalesce("rw", F.lit(bins))), F.col("s"))).alias("right"),
    )
    prominent = lows.withColumn("prominence", F.col("share") - F.greatest("left", "right")).where(F.col("prominence") >= least)
    best = prominent.groupBy("scene_id").agg(F.max_by("bin", F.struct("prominence", -F.col("bin"))).alias("best"))
    return best.select("scene_id", (F.col("best") / F.lit(float(bins))).alias("edge"))


def band_edges(px: DataFrame, bands: tuple[str, ...], bins: int, threshold: float, reach: int, least: float) -> DataFrame:
    """(scene_id, one edge per band): left edge of each band's most prominent peak, infinite where there is none."""
    out = px.select("scene_id").distinct()
    for band in bands:
        found = peaks(histogram(px, band, bins), bins, threshold, reach, least).withColumnRenamed("edge", f"edge_{band}")
        out = out.join(found, "scene_id", "left")
    return out.select("scene_id", *[F.coalesce(f"edge_{b}", F.lit(float("inf"))).alias(f"edge_{b}") for b in bands])


def ice_by_peaks(px: DataFrame, most7: float, threshold: float, bins: int = 128, least: float = 0.01, reach: int = 3, either: bool = False) -> DataFrame:
    """Pixels dark in band 7 and above the peaks of bands 2 and 1 (or of either); without a peak no pixel is above."""
    edges = band_edges(px, ("b2", "b1"), bins, threshold, reach, least)
    two, one = F.col("b2") > F.col("edge_b2"), F.col("b1") > F.col("edge_b1")
    return px.join(edges, "scene_id").where((F.col("b7") < most7) & ((two | one) if either else (two & one))).drop("edge_b2", "edge_b1")


def ice_by_midpoint(px: DataFrame, value: str, lowest: float = 0.3, bins: int = 128, least: float = 0.01, reach: int = 3) -> DataFrame:
    """Pixels above the middle between lowest and the peak; above lowest where there is no peak. A tile's key may stand for the scene."""
    edge = F.col(f"edge_{value}")
    edges = band_edges(px, (value,), bins, lowest, reach, least)
    return px.join(edges, "scene_id").where(F.col(value) > 0.5 * (lowest + F.when(edge == float("inf"), lowest).otherwise(edge))).drop(f"edge_{value}")


def peak_share(px: DataFrame, value: str, bins: int, above: float, of_highest: float = 0.6) -> DataFrame:
    """(scene_id, share): of the local maxima of the histogram of values beyond above, those over of_highest times the highest.

    Bins are equal over the values' range; an end of the histogram is no maximum."""
    some = px.where(F.col(value) > above)
    ends = some.groupBy("scene_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = some.join(ends, "scene_id").withColumn("_x", (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    line = Window.partitionBy("scene_id").orderBy("bin")
    counts = histogram(scaled, "_x", bins).withColumn("p", F.lag("n").over(line)).withColumn("q", F.lead("n").over(line))
    tops = counts.where("n > p and n > q")
    highest = tops.groupBy("scene_id").agg(F.max("n").alias("most"))
    return tops.join(highest, "scene_id").groupBy("scene_id").agg(F.avg((F.col("n") > of_highest * F.col("most")).cast("int")).alias("share"))


def moments(px: DataFrame, value: str) -> DataFrame:
    """(scene_id, mean, std, skewness, kurtosis) of a band; kurtosis is the excess over 3, both without sample correction."""
    return px.groupBy("scene_id").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))


def equalize_where(px: DataFrame, value: str, bins: int, least_entropy: float = 4.0, least_white: float = 0.4, white: float = 0.1) -> DataFrame:
    """Tiles (tr, tc) of much entropy and many white pixels are equalised, the others stay: px with adjusted."""
    keys = ("scene_id", "tr", "tc")
    lively = entropy(px, value, bins, keys).join(px.groupBy(*keys).agg(F.avg((F.col(value) > white).cast("int")).alias("_white")), [*keys])
    lively = lively.where((F.col("entropy") > least_entropy) & (F.col("_white") > least_white)).select(*keys)
    line = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = histogram(px.join(lively, [*keys], "left_semi"), value, bins, keys)
    cdf = cdf.withColumn("_eq", F.sum("n").over(line) / F.sum("n").over(Window.partitionBy(*keys))).drop("n")
    binned = px.withColumn("bin", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int"))
    return binned.join(cdf, [*keys, "bin"], "left").withColumn("adjusted", F.coalesce("_eq", value)).drop("bin", "_eq")


def clahe(px: DataFrame, value: str, frame: DataFrame, rblocks: int = 8, cblocks: int = 8, bins: int = 128, clip: float = 0.1) -> DataFrame:
    """Contrast-limited equalisation: px with clahe, values in 0..1.

    Each block's histogram is cut off at clip times its even count (1 at least); what is cut off goes to all bins alike,
    the rest of that to the lowest ones. Its cumulative shares map the values. A pixel blends the maps of the four
    blocks whose centres surround it, by its place between them; blocks beyond the frame repeat the outermost ones. Blocks
    have even sides; those at the far edges may be cut short by the frame.
    """
    keys = ("scene_id", "br", "bc")
    side = lambda length, blocks: 2 * F.ceil(F.col(length) / (2 * blocks))
    sized = px.join(frame.select("scene_id", "height", "width"), "scene_id").withColumn("_h", side("height", rblocks)).withColumn("_w", side("width", cblocks))
    binned = sized.withColumn("bin", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int"))
    binned = binned.withColumn("br", F.floor(F.col("row") / F.col("_h")).cast("int")).withColumn("bc", F.floor(F.col("col") / F.col("_w")).cast("int"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.max(F.greatest(F.floor(clip * F.col("_h") * F.col("_w") / bins), F.lit(1))).alias("limit"))
    capped = counts.withColumn("kept", F.least("n", "limit"))
    spare = capped.groupBy(*keys).agg(F.sum(F.col("n") - F.col("kept")).alias("spare"), F.sum("n").alias("all"))
    filled = spare.select(*keys, "all", "spare", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(capped.select(*keys, "bin", "kept"), [*keys, "bin"], "left")
    mass = F.coalesce("kept", F.lit(0)) + F.floor(F.col("spare") / bins) + (F.col("bin") < F.col("spare") % bins).cast("int")
    line = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    maps = filled.select(*keys, "bin", (F.sum(mass).over(line) / F.col("all")).alias("share"))
    last = maps.groupBy("scene_id").agg(F.max("br").alias("last_r"), F.max("bc").alias("last_c"))
    place = binned.join(last, "scene_id")
    near = lambda at, length: F.floor((F.col(at) + F.col(length) / 2) / F.col(length)) - 1
    place = place.withColumn("_r", near("row", "_h")).withColumn("_c", near("col", "_w"))
    along = lambda at, block, length: (F.col(at) - (F.col(block) * F.col(length) + F.col(length) / 2)) / (F.col(length) - 1)
    place = place.withColumn("_y", along("row", "_r", "_h")).withColumn("_x", along("col", "_c", "_w"))
    corners = []
    for a in (0, 1):
        for b in (0, 1):
            weight = (F.col("_y") if a else 1 - F.col("_y")) * (F.col("_x") if b else 1 - F.col("_x"))
            r = F.least(F.greatest(F.col("_r") + a, F.lit(0)), F.col("last_r")).cast("int")
            c = F.least(F.greatest(F.col("_c") + b, F.lit(0)), F.col("last_c")).cast("int")
            corners.append(F.struct(r.alias("br"), c.alias("bc"), weight.alias("w")))
    four = place.select("scene_id", "row", "col", "bin", F.explode(F.array(*corners)).alias("k")).select("scene_id", "row", "col", "bin", "k.*")
    blended = four.join(maps, [*keys, "bin"]).groupBy("scene_id", "row", "col").agg(F.sum(F.col("w") * F.col("share")).alias("clahe"))
    return px.join(blended, ["scene_id", "row", "col"])


def clahe_by_range(px: DataFrame, values: list[str], frame: DataFrame, rblocks: int = 8, cblocks: int = 8, bins: int = 256, clip: float = 0.99) -> DataFrame:
    """px with <value>_even for each value: contrast-limited equalisation between the channel's own least and greatest value in
    the scene; a channel of one value stays."""
    ends = cut(px.groupBy("scene_id").agg(*[f(v).cast("double").alias(f"_{name}_{v}") for v in values for name, f in (("lo", F.min), ("hi", F.max))]))
    out = px
    for v in values:
        lo, hi = F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        unit = px.join(ends, "scene_id").select("scene_id", "row", "col", lo.alias("lo"), hi.alias("hi"), F.when(hi > lo, (F.col(v) - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("unit"))
        even = clahe(unit, "unit", frame, rblocks, cblocks, bins, clip)
        back = F.when(F.col("hi") > F.col("lo"), F.col("lo") + F.col("clahe") * (F.col("hi") - F.col("lo"))).otherwise(F.col("lo"))
        out = out.join(even.select("scene_id", "row", "col", back.alias(f"{v}_even")), ["scene_id", "row", "col"])
    return out


def flatten_threshold(kurt2: Column, kurt1: Column, skew2: Column, share: Column, cloud_share: Column, spread: Column) -> Column:
    """Grey level (of 1) under which an ice image is flattened: 50, 130 or 80 of 255.

    kurt and skew are of bands 2 and 1 beyond the floe level, share is peak_share, cloud_share that of cloudy pixels,
    spread the deviation of the grey image."""
    # Limits of the decision.
    low, high, skewed, few, none, cloudy, wide, wider = 2, 8, 4, 0.1, 0.01, 0.02, 84 / 255, 98.9 / 255
    fifty = (kurt2 > high) | ((kurt2 < low) & (kurt1 > high)) | ((kurt2 < low) & (skew2 < skewed) & (share < few)) | (share < none)
    above = ((cloud_share < cloudy) & (spread > wide)) | (spread > wider)
    return F.when(fifty, 50 / 255).when(above, 130 / 255).otherwise(80 / 255)


def ice_from_water(px: DataFrame, grey: str, cloud: Column, land: Column, floe: float = 100 / 255, speckle: tuple[float, float] = (17 / 255, 30 / 255), least_pixels: int = 10) -> DataFrame:
    """px with ice: the grey image flattened below its scene's threshold, less three times band 7 where that is speckle.

    Scenes with fewer than least_pixels bright pixels in band 2 keep their grey image."""
    bright = px.where(F.col("b2") > floe)
    band2, band1 = moments(bright, "b2"), moments(px.where(F.col("b1") > floe), "b1").select("scene_id", F.col("kurtosis").alias("kurt1"))
    shares = peak_share(px, "b2", round(255 * (1 - floe)), floe)
    whole = px.groupBy("scene_id").agg(F.stddev_samp(grey).alias("spread"), F.avg(F.when(~land, (~cloud & (F.col("b7") > 0)).cast("int"))).alias("cloud_share"), F.count_if(F.col("b2") > floe).alias("bright"))
    facts = whole.join(band2, "scene_id", "left").join(band1, "scene_id", "left").join(shares, "scene_id", "left")
    level = flatten_threshold(F.col("kurtosis"), F.col("kurt1"), F.col("skewness"), F.col("share"), F.col("cloud_share"), F.col("spread"))
    facts = facts.select("scene_id", F.when(F.col("bright") >= least_pixels, level).alias("level"))
    speck = F.when(~cloud & F.col("b7").between(*speckle), F.col("b7")).otherwise(0.0)
    flat = F.when(F.col(grey) <= F.col("level"), 0.0).otherwise(F.col(grey))
    return px.join(facts, "scene_id").withColumn("ice", F.when(F.isnull("level"), F.col(grey)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), flat - 3 * speck)))).drop("level")


def entropy(px: DataFrame, value: str, bins: int, keys: tuple[str, ...]) -> DataFrame:
    """Shannon entropy in bits of the binned values of each key."""
    counts = px.groupBy(*keys, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    total = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return total.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


BINS = 4_096  # of a round of exact_percentiles


def exact_percentiles(px: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(scene_id, p): exact percentiles of each scene (array, one for each share), between two ranks in proportion; nulls don't count.

    Each rank is narrowed by histograms: a round counts the values of its interval in BINS bins and goes on with the bin
    that holds the rank, from its least to its greatest value, until they are equal. Tasks hold counts of bins only; values of
    few levels take one round, any doubles some five.
    """
    v = px.where(F.col(value).isNotNull()).select("scene_id", F.col(value).cast("double").alias("_v"))
    ends = v.groupBy("scene_id").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("share") + 1)
    wanted = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))).alias("share")).withColumn("place", place)
    ranks = F.explode(F.array(*[F.struct(F.lit(up).alias("up"), f("place").cast("bigint").alias("rank")) for up, f in ((0, F.floor), (1, F.ceil))]))
    now = cut(wanted.select("scene_id", "share", "place", "lo", "hi", F.lit(0).cast("bigint").alias("below"), ranks.alias("r")).select("*", "r.*").drop("r"))
    keys = ["scene_id", "share", "up"]
    line = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while not (open_ := now.where("lo < hi")).isEmpty():
        inside = v.join(open_.select(*keys, "lo", "hi"), "scene_id").where("_v between lo and hi")
        bin_ = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin")
        counts = inside.groupBy(*keys, bin_).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = counts.withColumn("_before", F.coalesce(F.sum("n").over(line), F.lit(0)))
        met = open_.drop("lo", "hi").join(before, keys).where((F.col("rank") >= F.col("below") + F.col("_before")) & (F.col("rank") < F.col("below") + F.col("_before") + F.col("n")))
        narrower = met.select(*keys, "place", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("_before")).alias("below"), "rank")
        now = cut(now.where("lo >= hi").unionByName(narrower))
    pair = now.groupBy("scene_id", "share").agg(F.first("place").alias("place"), F.min(F.struct("up", "lo")).alias("a"), F.max(F.struct("up", "lo")).alias("b"))
    floor, ceil = F.floor("place"), F.ceil("place")
    between = (ceil - F.col("place")) * F.col("a.lo") + (F.col("place") - floor) * F.col("b.lo")
    found = pair.select("scene_id", "share", F.when((floor == ceil) | (F.col("a.lo") == F.col("b.lo")), F.col("a.lo")).otherwise(between).alias("value"))
    return found.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "value"))), lambda x: x["value"]).alias("p"))


def stretch(px: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Linear stretch between two percentiles of each scene to 0..255."""
    ends = exact_percentiles(px, value, [low, high])
    scaled = (F.col(value) - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0]) * 255
    return px.join(ends, "scene_id").withColumn("stretched", F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), scaled))).cast("int")).drop("p")


def equalize(px: DataFrame, value: str, bins: int) -> DataFrame:
    """Global equalisation: each pixel takes the cumulative share of its bin."""
    hist = histogram(px, value, bins)
    line = Window.partitionBy("scene_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("scene_id")
    cdf = hist.withColumn("equalized", F.sum("n").over(line) / F.sum("n").over(every)).drop("n")
    binned = px.withColumn("bin", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int"))
    return binned.join(cdf, ["scene_id", "bin"]).drop("bin")


def kmeans(px: DataFrame, value: str, k: int = 4, rounds: int = 5, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Weighted one-dimensional k-means on distinct levels: (keys, value, cluster), clusters by rising centre.

    Centres start at the quantile levels (i + 1/2) / k. Work per round grows with levels, not pixels; centres are cut in every
    round, so that no task holds the sorts of several.
    """
    levels = cut(px.groupBy(*keys, value).agg(F.count("*").alias("n")))
    line = Window.partitionBy(*keys).orderBy(value)
    every = Window.partitionBy(*keys)
    half = (2 * F.sum("n").over(line) - F.col("n")) / (2 * F.sum("n").over(every))
    clustered = levels.withColumn("cluster", F.least(F.floor(half * k), F.lit(k - 1)).cast("int"))
    for _ in range(rounds):
        some = lambda i, x: F.sum(F.when(F.col("cluster") == i, x))
        centres = clustered.groupBy(*keys).agg(*[(some(i, F.col(value) * F.col("n")) / some(i, F.col("n"))).alias(f"_{i}") for i in range(k)])
        listed = cut(centres.select(*keys, F.array_sort(F.array_compact(F.array(*[f"_{i}" for i in range(k)]))).alias("centres")))
        gaps = F.transform("centres", lambda c: F.abs(c - F.col(value)))
        clustered = levels.join(listed, [*keys]).select(*keys, value, "n", (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int").alias("cluster"))
    return clustered


def modal_cluster(clustered: DataFrame, flagged: DataFrame, value: str, keys: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """The cluster that most flagged pixels (or levels with their number n) have, per key; of equal ones the lower."""
    pixels = F.sum("n") if "n" in flagged.columns else F.count("*")
    clusters = clustered.select(*keys, value, "cluster")
    counts = flagged.join(clusters, [*keys, value]).groupBy(*keys, "cluster").agg(pixels.alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))


def tile_key(at: Column, side: int, length: int) -> Column:
    """Tile index along one axis; a rest of less than half a tile joins the last one."""
    count = max(1, length // side + (1 if 2 * (length % side) >= side else 0))
    return F.least(F.floor(at / side), F.lit(count - 1)).cast("int")


def stitch(px: DataFrame, label: str, grey: str, least: int = 4, most_apart: float = 0.1) -> DataFrame:
    """Labels of tiles joined along the seams: (scene_id, label, stitched).

    px is dense with tile keys tr and tc. Each label right of or below a seam goes to the label it meets most often
    there, if they meet least times and their mean grey differs by less than most_apart. All seams at once; chains are
    closed to the least label.
    """
    from scenetrack.operators.runs import star_labels
    from scenetrack.operators.stencil import COL, ROW, along

    here = F.col(label).cast("bigint")
    seams = None
    for line, key in ((ROW, "tc"), (COL, "tr")):
        met = px.select("scene_id", here.alias("l"), F.col(key).alias("k"), F.lead(here).over(along(line)).alias("r"), F.lead(key).over(along(line)).alias("k2")).where("k <> k2 and l <> r").select("scene_id", "l", "r")
        seams = met if seams is None else seams.unionAll(met)
    counts = seams.groupBy("scene_id", "l", "r").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    means = px.groupBy("scene_id", here.alias("label")).agg(F.avg(grey).alias("mean"))
    l_mean = means.select("scene_id", F.col("label").alias("l"), F.col("mean").alias("lm"))
    r_mean = means.select("scene_id", F.col("label").alias("r"), F.col("mean").alias("rm"))
    near = counts.join(l_mean, ["scene_id", "l"]).join(r_mean, ["scene_id", "r"]).where(F.abs(F.col("lm") - F.col("rm")) < most_apart)
    best = near.groupBy("scene_id", "r").agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("l"))
    roots = star_labels(best.select("scene_id", F.col("r").alias("u"), F.col("l").alias("v")))
    names = means.select("scene_id", "label")
    return names.join(roots, (names.scene_id == roots.scene) & (names.label == roots.vertex), "left").select("scene_id", "label", F.coalesce("component", "label").alias("stitched"))
