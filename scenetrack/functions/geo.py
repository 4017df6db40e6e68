"""Coordinates as column expressions: pixel to projection, projection to longitude and latitude, units."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ellipsoid, and (standard parallel, central longitude, hemisphere) of the polar stereographic codes.
RADIUS, ECCENTRICITY = 6378137.0, 0.0818191908426215
POLAR = {3413: (70.0, -45.0, 1), 3031: (71.0, 0.0, -1)}


def pixel_to_xy(col: Column, row: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """Affine transform of pixel centres; 0-based row and column."""
    a, b, c, d, e, f = transform
    return a + (col + 0.5) * b + (row + 0.5) * c, d + (col + 0.5) * e + (row + 0.5) * f


def area_km2(area: Column, transform: tuple[float, ...]) -> Column:
    return area * (transform[1] ** 2 / 1e6)


def length_km(length: Column, transform: tuple[float, ...]) -> Column:
    return length * (abs(transform[1]) / 1e3)


def lon_lat(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees for EPSG 4326, 3857, 3413 and 3031; others raise."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
    if epsg not in POLAR:
        raise ValueError(f"no closed form for EPSG {epsg}")
    parallel, centre, side = POLAR[epsg]
    e, phi = ECCENTRICITY, math.radians(parallel)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    m = math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)
    small = F.hypot(x, y) * (t / (RADIUS * m))
    chi = math.pi / 2 - 2 * F.atan(small)
    e2, e4, e6, e8 = e**2, e**4, e**6, e**8
    lat = chi + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi) + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi) + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi) + (4279 * e8 / 161280) * F.sin(8 * chi)
    lon = F.degrees(F.atan2(x, -y if side > 0 else y)) + centre
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon), side * F.degrees(lat)


def xy(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Metres of a projection for degrees: EPSG 4326 (degrees again), 3857, 3413 and 3031; others raise."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return F.radians(lon) * RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS
    if epsg not in POLAR:
        raise ValueError(f"no closed form for EPSG {epsg}")
    parallel, centre, side = POLAR[epsg]
    e, phi = ECCENTRICITY, math.radians(parallel)

    def shrink(sine, tangent):
        return tangent / ((1 - e * sine) / (1 + e * sine)) ** (e / 2)

    scale = RADIUS * math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2) / shrink(math.sin(phi), math.tan(math.pi / 4 - phi / 2))
    at = side * F.radians(lat)
    sine = F.sin(at)
    reach = scale * F.tan(math.pi / 4 - at / 2) / F.pow((1 - e * sine) / (1 + e * sine), F.lit(e / 2))
    turn = F.radians(lon - centre)
    return reach * F.sin(turn), -side * reach * F.cos(turn)


def region_box(lon: Column, lat: Column, epsg: int, width: Column, height: Column, digits: int = 0) -> list[Column]:
    """left, lower, right and upper of a region: its centre projected and rounded, half its extent to each side."""
    x, y = (F.round(v, digits) for v in xy(lon, lat, epsg))
    return [(x - width / 2).alias("left"), (y - height / 2).alias("lower"), (x + width / 2).alias("right"), (y + height / 2).alias("upper")]


def with_lat_lon(px: DataFrame, transform: tuple[float, ...], epsg: int) -> DataFrame:
    """px (row, col) with x, y, lon and lat of the pixel centres."""
    x, y = pixel_to_xy(F.col("col"), F.col("row"), transform)
    placed = px.withColumn("x", x).withColumn("y", y)
    lon, lat = lon_lat(F.col("x"), F.col("y"), epsg)
    return placed.withColumn("lon", lon).withColumn("lat", lat)


LENGTHS = ("perimeter", "major_axis_length", "minor_axis_length")


def in_units(objects: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """objects with areas in square kilometres and lengths in kilometres, as far as they have them; an empty table keeps its columns."""
    areas = {c: area_km2(F.col(c), transform) for c in ("area", "convex_area") if c in objects.columns}
    return objects.withColumns(areas | {c: length_km(F.col(c), transform) for c in LENGTHS if c in objects.columns})
