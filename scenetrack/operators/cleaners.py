"""Clean-up steps for binary masks that are made of several 3 x 3 rules and run operators; masks are run tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenetrack.functions import masks as M
from scenetrack.operators import runs as R
from scenetrack.operators import stencil as S
from scenetrack.session import cut

RUN = ("scene_id", "row", "c0", "c1")


def coded(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """All pixels of the frame with bit and the code of their 3 x 3 neighbourhood."""
    return S.neighbourhood_code(S.dense_mask(R.explode_runs(runs.select(*RUN)), frame))


def by_rule(runs: DataFrame, frame: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """Runs of the pixels whose code the rule takes."""
    return cut(R.runs_of(coded(runs, frame).where(rule(F.col("code"))).select("scene_id", "row", "col")))


def h_broken(runs: DataFrame, frame: DataFrame) -> DataFrame:
    return by_rule(runs, frame, lambda code: (M.bit(code, 4) == 1) & ~M.h_breaks(code))


def bridged(runs: DataFrame, frame: DataFrame) -> DataFrame:
    return by_rule(runs, frame, M.bridges)


def filled_in(runs: DataFrame, frame: DataFrame) -> DataFrame:
    return by_rule(runs, frame, M.fills)


def branched(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """Branch points of a mask."""
    return cut(R.runs_of(S.branch_points(coded(runs, frame)).select("scene_id", "row", "col")))


def branch_bridge(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """Branch points, and what bridges them."""
    return bridged(branched(runs, frame), frame)


def large(runs: DataFrame, least: int, connectivity: int = 4) -> DataFrame:
    """A mask without components of fewer than least pixels."""
    return R.keep_sizes(R.components(runs.select(*RUN), connectivity), least).select(*RUN)


def changed_by_opening(runs: DataFrame, frame: DataFrame, least: int = 20, element=None) -> DataFrame:
    """What tells a mask without specks, its Hs broken, from its branch points when these are bridged, opened and filled."""
    kept = h_broken(large(runs, least), frame)
    out = cut(R.fill_holes(R.opening(branch_bridge(kept, frame), element or R.octagon(3), frame), frame).select(*RUN))
    return R.merge_runs(R.subtract(kept, out, frame).select(*RUN).unionByName(R.subtract(out, kept, frame).select(*RUN)))


def with_changes(runs: DataFrame, frame: DataFrame, least: int = 20, element=None) -> DataFrame:
    """A mask with what changed_by_opening finds."""
    return R.merge_runs(runs.select(*RUN).unionByName(changed_by_opening(runs, frame, least, element)))


def split_morphologically(runs: DataFrame, cloud: DataFrame, frame: DataFrame, least_piece: int = 2, least: int = 20, element=None) -> DataFrame:
    """Objects divided along leads: the branch points of a mask, less narrow gaps and specks, filled, without cloud, opened.

    least_piece: smaller pieces of the first branch points go; least: smaller 8-connected pieces go, twice.
    """
    points = branched(h_broken(runs, frame), frame)
    opened = branched(large(large(points, least_piece), least, 8), frame)
    gaps = R.bottom_hat(opened, R.diamond(2), frame).select(*RUN)
    leads = cut(large(cut(R.subtract(opened, gaps, frame).select(*RUN)), least, 8))
    clear = R.subtract(cut(R.fill_holes(leads, frame).select(*RUN)), cut(cloud.select(*RUN)), frame).select(*RUN)
    floes = branched(cut(clear), frame)
    core = cut(R.opening(floes, element or R.octagon(3), frame).select(*RUN))
    return R.reconstruct(core, floes, 8).select(*RUN)


def finished(runs: DataFrame, divide: DataFrame | None, frame: DataFrame, erosion=None, dilation=None) -> DataFrame:
    """The last clean-up of a segmentation: Hs broken, pixels filled, the divide (a mask, if any) cut out, holes filled; then those
    parts of its branch points, eroded and dilated, that still meet them."""
    now = filled_in(h_broken(runs, frame), frame)
    if divide is not None:
        now = cut(R.subtract(now, cut(divide.select(*RUN)), frame).select(*RUN))
    points = branched(cut(R.fill_holes(now, frame).select(*RUN)), frame)
    core = cut(R.dilate(R.erode(points, erosion or R.diamond(1), frame), dilation or R.diamond(1), frame).select(*RUN))
    return R.reconstruct(core, points, 8).select(*RUN)
