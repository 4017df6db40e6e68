"""Nearest features: exact Euclidean distance and label of the nearest pixel of a set, in two passes, without a radius.

The first pass stays within rows: a feature serves the columns up to half way to the next feature of its row, so rows are cut
into intervals by windows over features alone. The second pass takes a column at a time: each of its rows has at
most one candidate, whose squared distance to the rows of the column is a parabola, and the least of parabolas of one shape
moves down the column monotonically. So the middle row's best candidate bounds those of the rows on either side, and halving the gaps
finds all of a strip of STRIP columns with vector operations, O(height log height) a column. Of equal distances the
smaller label wins: labels count as a difference smaller than any of distances, so the order of candidates is the same.

A task gets BAND rows of a strip with a margin of candidates above and below: of the reach, if there is one. Otherwise a band is
done if each of its pixels has a feature nearer than the rows beyond the margin; the other bands are taken again with a wider margin,
so a task's rows grow with the distances in its band and not with the scene's height.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenetrack.session import cut

STRIP = 16
BAND, MARGIN, WIDER = 2048, 128, 8  # rows of a band, of its first margin, and how many times wider the next one is


def along_rows(features: DataFrame, frame: DataFrame | None, reach: int | None = None) -> DataFrame:
    """(scene_id, row, col, label, g2): the nearest feature (scene_id, row, col, label) of the row, for every column of the
    frame (scene_id, height, width), or as far as reach; of two the one of the smaller label."""
    line = Window.partitionBy("scene_id", "row").orderBy("col")
    sides = features.select("scene_id", "row", "col", "label", *[move(c, 1).over(line).alias(f"_{name}_{c}") for name, move in (("l", F.lag), ("r", F.lead)) for c in ("col", "label")])
    half = lambda other: F.floor((F.col("col") + F.col(other)) / 2)
    halfway = lambda other: (F.col("col") + F.col(other)) % 2 == 0  # noqa: E731  the middle is a pixel: the smaller label takes it
    low = half("_l_col") + F.when(halfway("_l_col") & (F.col("label") < F.col("_l_label")), 0).otherwise(1)
    high = half("_r_col") - F.when(halfway("_r_col") & (F.col("_r_label") < F.col("label")), 1).otherwise(0)
    if frame is not None:
        sides = sides.join(frame.select("scene_id", "width"), "scene_id")
        low, high = F.coalesce(low, F.lit(0)), F.coalesce(high, F.col("width") - 1)
    if reach is not None:
        low, high = F.greatest(low, F.col("col") - reach), F.least(high, F.col("col") + reach)
    if frame is not None:
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("width") - 1)
    spans = sides.select("scene_id", "row", F.col("col").alias("_c"), "label", low.cast("int").alias("_low"), high.cast("int").alias("_high")).where("_low <= _high")
    each = spans.withColumn("col", F.explode(F.sequence("_low", "_high")))
    return each.select("scene_id", "row", "col", "label", ((F.col("col") - F.col("_c")).cast("bigint") * (F.col("col") - F.col("_c"))).alias("g2"))


def least_parabolas(rows: np.ndarray, cost: np.ndarray, first: np.ndarray, queries: np.ndarray, weight: int) -> np.ndarray:
    """Best candidate of each query row in each column. Candidates stand column by column (column k: first[k] to
    first[k + 1]), by row; a candidate costs cost + weight * (row - query)**2. Returns places, columns x queries."""
    columns, n = len(first) - 1, len(queries)
    best = np.zeros((columns, n), np.int64)
    low, high = np.repeat(first[:-1, None], n, 1), np.repeat(first[1:, None] - 1, n, 1)
    step = 1 << max(n - 1, 0).bit_length()
    while step:
        at = np.arange(step - 1, n, 2 * step)
        if len(at):
            lo, hi = low[:, at].ravel(), high[:, at].ravel()
            if step > 1 or n > 1:
                before, after = at - step, at + step
                known = before >= 0
                lo = np.where(np.tile(known, columns), best[:, np.maximum(before, 0)].ravel(), lo)
                known = after < n
                hi = np.where(np.tile(known, columns), best[:, np.minimum(after, n - 1)].ravel(), hi)
            size = hi - lo + 1
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            place = np.arange(size.sum()) - np.repeat(starts - lo, size)
            away = rows[place] - np.repeat(np.tile(queries[at], columns), size)
            total = cost[place] + weight * away * away
            least = np.repeat(np.minimum.reduceat(total, starts), size)
            hit = np.flatnonzero(total == least)
            group = np.repeat(np.arange(len(size)), size)[hit]
            best[:, at] = place[hit[np.searchsorted(group, np.arange(len(size)))]].reshape(columns, len(at))
        step //= 2
    return best


def down_columns(key: tuple, strip: pd.DataFrame, reach: int | None) -> pd.DataFrame:
    """Nearest features of the pixels in a strip of columns."""
    strip = strip.sort_values(["col", "row"], kind="stable")
    col, rows, label, g2, lowest, highest = (strip[c].to_numpy(np.int64) for c in ("col", "row", "label", "g2", "lowest", "highest"))
    names, rank = np.unique(label, return_inverse=True)
    weight = len(names)
    columns, first = np.unique(col, return_index=True)
    first = np.append(first, len(col))
    low, high = lowest[0], highest[0]
    if reach is not None:
        low, high = max(rows.min() - reach, low), min(rows.max() + reach, high)
    queries = np.arange(low, high + 1)
    best = least_parabolas(rows, g2 * weight + rank, first, queries, weight)
    d2 = g2[best] + (rows[best] - queries[None, :]) ** 2
    near = np.full(d2.shape, True) if reach is None else d2 <= reach * reach
    k, q = np.nonzero(near)
    return pd.DataFrame({"scene_id": key[0], "row": queries[q], "col": columns[k], "label": label[best[k, q]], "d2": d2[k, q]})


def in_bands(candidates: DataFrame, margin: int, band: int) -> DataFrame:
    """candidates with _strip and _band, once for each band that they may serve, whose rows bound lowest and highest."""
    first, last = (F.greatest(F.least(F.col("row") + by, F.col("highest")), F.col("lowest")) for by in (-margin, margin))
    keyed = candidates.withColumn("_strip", F.floor(F.col("col") / STRIP).cast("int"))
    keyed = keyed.withColumn("_band", F.explode(F.sequence(F.floor(first / band).cast("int"), F.floor(last / band).cast("int"))))
    begin = F.col("_band") * band
    keyed = keyed.withColumn("lowest", F.greatest("lowest", begin)).withColumn("highest", F.least("highest", begin + band - 1))
    # dealt by bands: Spark would keep the partitions of the join with the frame, one a scene, for the groups
    return keyed.repartition("scene_id", "_strip", "_band")


def settled(key: tuple, strip: pd.DataFrame, margin: int) -> pd.DataFrame:
    """Nearest features of a band (key: scene, strip, band), if no row beyond the margin can hold nearer ones or equally near
    ones; else nothing. top and bottom are the scene's ends."""
    out = down_columns(key, strip, None)
    row, d2 = out["row"].to_numpy(np.int64), out["d2"].to_numpy(np.int64)
    above, below = strip["lowest"].iloc[0] - margin, strip["highest"].iloc[0] + margin  # the last rows that were looked at
    open_ = (above > strip["top"].iloc[0]) & (d2 >= (row - above + 1) ** 2) | (below < strip["bottom"].iloc[0]) & (d2 >= (below - row + 1) ** 2)
    return (out.iloc[:0] if open_.any() else out).assign(_strip=key[1], _band=key[2])


def nearest(features: DataFrame, frame: DataFrame | None, reach: int | None = None, band: int = BAND, margin: int = MARGIN) -> DataFrame:
    """(scene_id, row, col, label, d2): label and squared distance of the nearest feature (scene_id, row, col, label), for all
    pixels of the frame (scene_id, height, width), or for those that have one within reach; without a frame, rows and columns
    have no ends. Scenes without features give none."""
    if frame is None and reach is None:
        raise ValueError("a frame or a reach is needed")
    candidates = along_rows(features, frame, reach)
    if frame is None:
        candidates = candidates.withColumn("lowest", F.lit(-(1 << 30))).withColumn("highest", F.lit(1 << 30))
    else:
        candidates = candidates.join(frame.select("scene_id", F.lit(0).alias("lowest"), (F.col("height") - 1).alias("highest")), "scene_id")
    shape = f"scene_id {dict(features.dtypes)['scene_id']}, row int, col int, label bigint, d2 bigint"
    if reach is not None:
        work = functools.partial(down_columns, reach=reach)
        return in_bands(candidates, reach, max(band, reach)).groupBy("scene_id", "_strip", "_band").applyInPandas(lambda key, pdf: work(key, pdf), shape)
    candidates = candidates.withColumn("top", F.col("lowest")).withColumn("bottom", F.col("highest"))
    group, parts, todo, height = ["scene_id", "_strip", "_band"], [], None, None
    while True:
        spread = in_bands(candidates, margin, band)
        work = functools.partial(settled, margin=margin)  # cut at once, before the margin changes
        spread = spread if todo is None else spread.join(todo, group, "left_semi")
        parts.append(cut(spread.groupBy(*group).applyInPandas(lambda key, pdf: work(key, pdf), shape + ", _strip int, _band int")))
        if todo is None:
            ends = frame.join(features.select("scene_id").distinct(), "scene_id", "left_semi")
            height = ends.agg(F.max("height")).first()[0] or 0
            strips, bands = (F.sequence(F.lit(0), F.floor((F.col(side) - 1) / by).cast("int")) for side, by in (("width", STRIP), ("height", band)))
            todo = ends.where("height > 0 and width > 0").select("scene_id", F.explode(strips).alias("_strip"), bands.alias("_b")).select("scene_id", "_strip", F.explode("_b").alias("_band"))
        if margin >= height:
            break
        todo = cut(todo.join(parts[-1].select(*group).distinct(), group, "left_anti"))
        if todo.isEmpty():
            break
        margin *= WIDER
    return functools.reduce(DataFrame.union, parts).select("scene_id", "row", "col", "label", "d2")
