"""Pixel rules as column expressions: clouds, ice, brightness."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binarize(value: Column, tolerance: float = 0) -> Column:
    return value > tolerance


def apply_mask(alpha: Column, mask: Column) -> Column:
    """Alpha after masking: an existing alpha is combined, not replaced."""
    return F.least(alpha, 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), mask)))


def zero_where(mask: Column, *bands: str) -> list[Column]:
    return [F.when(mask, 0.0).otherwise(F.col(b)).alias(b) for b in bands]


def usable(alpha: Column) -> Column:
    return alpha > 0.5


def without_clouds(cloud: Column, *bands: str, drop: str | None = None) -> list[Column]:
    """Bands that are 0 where there is cloud; the band named drop is 0 everywhere."""
    return [(F.lit(0.0) if b == drop else F.when(cloud, 0.0).otherwise(F.col(b))).alias(b) for b in bands]


def brighten_mask(rebuilt: Column, green: Column) -> Column:
    """How much brighter a rebuilt 8-bit image is than its green band, within 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), rebuilt - green))


def each_band(change: Callable[[Column], Column], *bands: str) -> list[Column]:
    """The same change of several bands."""
    return [change(F.col(b)).alias(b) for b in bands]


def cloud_box(b7: str = "b7", b2: str = "b2", floor7: float = 110 / 255, ceiling7: float = 200 / 255, floor2: float = 190 / 255, low: float = 0.0, high: float = 0.75) -> Column:
    """Bright in band 7 and outside the ratio box of clear ice. Pixels outside the box stay cloud."""
    v7, v2 = F.col(b7), F.col(b2)
    clear = (v7 < ceiling7) & (v2 > floor2) & (low * v2 <= v7) & (v7 < high * v2)
    return (v7 > floor7) & ~clear


def ice_threshold(most7: float, least2: float, least1: float, b7: str = "b7", b2: str = "b2", b1: str = "b1") -> Column:
    return (F.col(b7) < most7) & (F.col(b2) > least2) & (F.col(b1) > least1)


#: Preset detectors, each (most in band 7, least in band 2, least in band 1) of 255, tried in this order.
PRESETS = {"strict first": ((5, 230, 240), (10, 190, 190)), "wide": ((5, 230, 240), (10, 190, 190), (30, 190, 75))}


def preset(name: str) -> list[Column]:
    return [ice_threshold(a / 255, b / 255, c / 255) for a, b, c in PRESETS[name]]


def first_detector(px: DataFrame, detectors: list[Column], more_than: int = 10) -> DataFrame:
    """Pixels of the first detector that finds more than more_than pixels in its scene; none if no detector does."""
    flagged = px.select("*", *[d.alias(f"_d{i}") for i, d in enumerate(detectors)])
    counts = flagged.groupBy("scene_id").agg(*[F.count_if(f"_d{i}").alias(f"_n{i}") for i in range(len(detectors))])
    choice = F.coalesce(*[F.when(F.col(f"_n{i}") > more_than, i) for i in range(len(detectors))])
    picked = flagged.join(counts.select("scene_id", choice.alias("detector")), "scene_id")
    hit = reduce(lambda a, b: a | b, [(F.col("detector") == i) & F.col(f"_d{i}") for i in range(len(detectors))])
    return picked.where(hit).drop(*[f"_d{i}" for i in range(len(detectors))])


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.5870 * g + 0.1140 * b


def to_uint8(value: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(value))).cast("int")


def brighten(value: Column, mask: Column, factor: float) -> Column:
    return F.when(mask, F.least(F.lit(1.0), value * factor)).otherwise(value)


def complement(value: Column, top: float = 1.0) -> Column:
    return top - value


def gamma(value: Column, power: float) -> Column:
    return F.pow(value, power)


# 3 x 3 rules on 9-bit codes: three bits per column, centre is bit 4

RING = (0, 1, 2, 5, 8, 7, 6, 3)  # positions around the centre, in order


def bit(code: Column, position: int) -> Column:
    return F.getbit(code, F.lit(position)).cast("int")


def fills(code: Column) -> Column:
    """Centre, or all four 4-neighbours."""
    return (bit(code, 4) == 1) | ((bit(code, 1) + bit(code, 3) + bit(code, 5) + bit(code, 7)) == 4)


def _groups(code: int) -> int:
    """8-connected groups of ring pixels."""
    left, groups = {p for p in RING if code >> p & 1}, 0
    while left:
        todo, groups = [left.pop()], groups + 1
        while todo:
            p = todo.pop()
            near = {q for q in left if abs(q // 3 - p // 3) <= 1 and abs(q % 3 - p % 3) <= 1}
            left -= near
            todo += near
    return groups


def bridge_codes() -> list[int]:
    """Codes that the bridge rule sets: centre, or two groups in the ring but for two corners on one edge alone."""
    corners = [{0, 2}, {0, 6}, {2, 8}, {6, 8}]
    return [c for c in range(512) if c >> 4 & 1 or (_groups(c) >= 2 and {p for p in RING if c >> p & 1} not in corners)]


def bridges(code: Column) -> Column:
    return F.element_at(F.lit([c in set(bridge_codes()) for c in range(512)]), (code + 1).cast("int"))


def h_breaks(code: Column) -> Column:
    """The centre of an H, upright or lying."""
    full = 0b111111111
    return code.isin(full & ~(1 << 3) & ~(1 << 5), full & ~(1 << 1) & ~(1 << 7))


def _background_parts(code: int) -> int:
    """4-connected groups of unset cells in the 3 x 3 neighbourhood."""
    left, parts = {p for p in range(9) if not code >> p & 1}, 0
    while left:
        todo, parts = [left.pop()], parts + 1
        while todo:
            p = todo.pop()
            near = {q for q in left if abs(q // 3 - p // 3) + abs(q % 3 - p % 3) == 1}
            left -= near
            todo += near
    return parts


def background_parts() -> list[int]:
    """For each code with its centre set, the number of background groups; 0 for the others."""
    return [_background_parts(c) if c >> 4 & 1 else 0 for c in range(512)]


def branch_candidates() -> list[int]:
    """Codes with their centre and at least three more cells set."""
    return [c for c in range(512) if c >> 4 & 1 and c.bit_count() > 3]


def optimal_tile_side(side: Column, height: Column, width: Column) -> Column:
    """Of side - 1, side and side + 1 the one that leaves the least area uncovered; of equal ones the larger; 2 at least."""

    def candidate(shift: int) -> Column:
        s = side + shift
        missed = height * width - F.floor(height / s) * F.floor(width / s) * s * s
        return F.when(s >= 2, F.struct(missed.alias("missed"), (-s).alias("minus")))

    return -F.array_min(F.filter(F.array(*[candidate(k) for k in (-1, 0, 1)]), lambda x: x.isNotNull()))["minus"]
