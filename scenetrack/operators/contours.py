"""Contours of objects by list ranking, resampled contours and their angle curves.

A border walk is a list of states: a border pixel and the direction in which the walk leaves it. Which state comes next
depends on the 3 x 3 neighbourhood of the next pixel alone, so one join links all states of all objects. How far a state is from the
start of its object's walk comes from pointer jumping: in each round every state looks twice as far back, so a walk of n steps
takes log2 n joins, and no task follows a border.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetrack.operators.objects import border_pixels
from scenetrack.operators.runs import explode_runs
from scenetrack.session import cut

OBJECT, PIXEL = ["scene_id", "label"], ["scene_id", "label", "row", "col"]

#: The eight directions, clockwise from up.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
#: For each direction of a step, where the unset pixel that the walk passes last lies, as seen from the pixel stepped to.
PASSED = tuple(AROUND.index((a - c, b - d)) for (a, b), (c, d) in ((AROUND[way - 1], AROUND[way]) for way in range(8)))


def neighbour_bits(labelled: DataFrame) -> DataFrame:
    """(scene_id, label, row, col, bits): border pixels of objects, bit k set if the neighbour in direction k is of the object."""
    border = border_pixels(explode_runs(labelled.select(*OBJECT, "row", "c0", "c1")))
    looks = [F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(1 << k).alias("bit")) for k, (a, b) in enumerate(((*AROUND, (0, 0))))]
    near = border.select(*PIXEL, F.explode(F.array(*looks)).alias("m")).select(*OBJECT, (F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"), F.col("m.bit").alias("bit"))
    # pixels inside count as unset: a walk comes to a border pixel before them
    found = near.groupBy(*PIXEL).agg(F.sum("bit").cast("int").alias("bits"))
    return found.where("bits >= 256").select(*PIXEL, (F.col("bits") - 256).alias("bits"))


def turned(way: Column, table: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in table]), way + 1)


def first_set(bits: Column, after: Column) -> Column:
    """First direction clockwise after the given one whose bit is set."""
    start = F.pmod(after + 1, F.lit(8))
    two = (bits * 256 + bits).cast("int")  # the circle twice, so that a shift turns it
    rotated = F.floor(two / F.pow(F.lit(2), start)).cast("int").bitwiseAND(255)
    lowest = F.bit_count(rotated.bitwiseAND(-rotated) - 1)
    return F.pmod(start + lowest, F.lit(8)).cast("int")


def walks(labelled: DataFrame) -> DataFrame:
    """(scene_id, label, i, row, col): each object's outer border, clockwise from its first pixel in reading order, closed.

    From each pixel the next one is the first border pixel clockwise after the unset one that the walk came along. The walk is over
    when it would leave the first pixel as it did at first, so pixels of one-pixel bridges come twice; a single pixel is its own
    contour.
    """
    bits = cut(neighbour_bits(labelled))
    place = F.struct("row", "col")
    start = bits.groupBy(*OBJECT).agg(F.min(place).alias("p"), F.min_by("bits", place).alias("bits")).select(*OBJECT, "p.row", "p.col", "bits")
    begins = start.where("bits <> 0").select(*PIXEL, first_set(F.col("bits"), F.lit(6)).alias("way"))
    ways = bits.select("*", F.explode(F.array(*[F.lit(k) for k in range(8)])).alias("way"))
    set_at = lambda way: F.floor(F.col("bits") / F.pow(F.lit(2), way)).cast("int") % 2 == 1
    # the walk passes along an unset side of the pixel, not just along an unset corner
    unset = lambda by: ~set_at(F.pmod(F.col("way") + by, F.lit(8)))
    states = ways.where(set_at(F.col("way")) & unset(7) & ((F.col("way") % 2 == 1) | unset(6))).select(*PIXEL, "way")
    name = lambda row, col, way: (F.col(row).cast("bigint") * (1 << 34) + F.col(col) * 8 + way).alias("state")  # noqa: E731  below 2**29 rows
    steps = states.select(*OBJECT, name("row", "col", F.col("way")), (F.col("row") + turned(F.col("way"), tuple(a for a, _ in AROUND))).alias("row"), (F.col("col") + turned(F.col("way"), tuple(b for _, b in AROUND))).alias("col"), turned(F.col("way"), PASSED).alias("passed"))
    linked = cut(steps).join(bits, PIXEL).select(*OBJECT, F.col("state").alias("before"), name("row", "col", first_set(F.col("bits"), F.col("passed"))))
    heads = begins.select(*OBJECT, name("row", "col", F.col("way"))).withColumn("head", F.lit(True))
    chain = linked.join(heads, [*OBJECT, "state"], "left")
    # the start has nothing before it; a state that has looked back to it is done, with its distance
    now = cut(chain.select(*OBJECT, "state", F.when(F.col("head").isNull(), F.col("before")).alias("before"), F.when(F.col("head").isNull(), 1).otherwise(0).alias("far")))
    done = -1
    while (ended := now.where("before is null").count()) > done:  # walks around holes never end
        done = ended
        back = now.select(*OBJECT, F.col("state").alias("before"), F.col("before").alias("further"), F.col("far").alias("more"))
        met = now.join(back, [*OBJECT, "before"], "left")
        now = cut(met.select(*OBJECT, "state", F.col("further").alias("before"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
    row = F.floor(F.col("state") / (1 << 34))
    points = now.where("before is null").select(*OBJECT, F.col("far").alias("i"), row.cast("int").alias("row"), F.floor((F.col("state") - row * (1 << 34)) / 8).cast("int").alias("col"))
    last = points.groupBy(*OBJECT).agg((F.max("i") + 1).alias("i"))
    closing = start.join(last, OBJECT).select(*OBJECT, "i", "row", "col")
    single = start.where("bits = 0").select(*OBJECT, F.lit(0).alias("i"), "row", "col")
    return points.union(closing).union(single)


def natural_spline(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with straight ends through values at 0, 1, 2, ..., evaluated at places at."""
    n = len(values)
    bend = np.zeros(n)
    if n > 2:
        # second derivatives of the inner knots: (1, 4, 1) bands, solved forwards and back
        right, factor = 6 * (values[2:] - 2 * values[1:-1] + values[:-2]), np.zeros(n - 2)
        found = np.zeros(n - 2)
        for i in range(n - 2):
            pivot = 4 - (factor[i - 1] if i else 0)
            factor[i] = 1 / pivot
            found[i] = (right[i] - (found[i - 1] if i else 0)) / pivot
        for i in range(n - 3, -1, -1):
            bend[i + 1] = found[i] - factor[i] * bend[i + 2]
    k = np.clip(np.floor(at).astype(int), 0, max(n - 2, 0))
    t = at - k
    if n == 1:
        return np.full(len(at), values[0], float)
    a, b = values[k] - bend[k] / 6, values[k + 1] - bend[k + 1] / 6
    return a * (1 - t) + b * t + (bend[k] * (1 - t) ** 3 + bend[k + 1] * t**3) / 6


def periodic_spline(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through values at 0, 1, 2, ..., the last equal to the first, smooth there too, evaluated at places at.

    The second derivatives solve a cyclic system of (1, 4, 1) bands, whose matrix a Fourier transform makes diagonal."""
    n = len(values) - 1
    if n < 1:
        return np.full(len(at), values[0], float)
    knots = values[:n].astype(float)
    right = 6 * (np.roll(knots, -1) - 2 * knots + np.roll(knots, 1))
    bend = np.fft.irfft(np.fft.rfft(right) / (4 + 2 * np.cos(2 * np.pi * np.arange(n // 2 + 1) / n)), n)
    k = np.clip(np.floor(at).astype(int), 0, n - 1)
    t, to = at - k, (k + 1) % n
    a, b = knots[k] - bend[k] / 6, knots[to] - bend[to] / 6
    return a * (1 - t) + b * t + (bend[k] * (1 - t) ** 3 + bend[to] * t**3) / 6


SPLINES = {"natural": natural_spline, "periodic": periodic_spline}


def resampled(points: np.ndarray, factor: int = 2, ends: str = "natural") -> np.ndarray:
    """A closed contour at len(points) // factor places (2 at least), evenly spread over its points; ends: how the spline
    joins where the contour closes, natural (straight ends) or periodic (smooth)."""
    at = np.linspace(0, len(points) - 1, max(len(points) // factor, 2))
    return np.stack([SPLINES[ends](points[:, 0].astype(float), at), SPLINES[ends](points[:, 1].astype(float), at)], 1)


def angle_curve(points: np.ndarray, unwrap: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Direction of each step of a polygon, from 0 to 2 pi and then continued without jumps, and the length walked so far."""
    steps = np.diff(points.astype(float), axis=0)
    angle = np.arctan2(steps[:, 1], steps[:, 0]) % (2 * np.pi)
    return np.unwrap(angle) if unwrap else angle, np.cumsum(np.hypot(steps[:, 0], steps[:, 1]))


def _per_object(walked: DataFrame, work, schema: str) -> DataFrame:
    """work(contour as an array of row, col) of every object, as rows numbered by i."""

    def run(group):
        import pandas as pd

        columns = work(group.sort_values("i")[["row", "col"]].to_numpy())
        n = len(next(iter(columns.values())))
        return pd.DataFrame({"scene_id": np.full(n, group["scene_id"].iloc[0]), "label": np.full(n, group["label"].iloc[0]), "i": np.arange(n)} | columns)

    return walked.groupBy("scene_id", "label").applyInPandas(run, "scene_id int, label long, i int, " + schema)


def contours(labelled: DataFrame) -> DataFrame:
    """(scene_id, label, i, row, col): each object's outer border, closed."""
    return walks(labelled)


def resampled_contours(labelled: DataFrame, factor: int = 2, ends: str = "natural") -> DataFrame:
    """(scene_id, label, i, x, y): each object's border as a smooth curve with fewer points."""

    def work(p):
        q = resampled(p, factor, ends)
        return {"x": q[:, 0], "y": q[:, 1]}

    return _per_object(walks(labelled), work, "x double, y double")


def psi_curves(labelled: DataFrame, factor: int = 2) -> DataFrame:
    """(scene_id, label, i, psi, s): angle and length along each object's resampled border."""

    def work(p):
        psi, s = angle_curve(resampled(p, factor))
        return {"psi": psi, "s": s}

    return _per_object(walks(labelled), work, "psi double, s double")
