"""Paths of least resistance in rasters, from one spanning forest of the pixels, without stepping from pixel to pixel.

Neighbouring pixels are joined by edges in one strict order. Each vertex takes its best edge and is contracted with what it
leads to (Borůvka's rounds); by the cut property the value that reaches a vertex from outside comes over this edge, so it is a
function of the contracted vertex's value alone. The raster is a pyramid: a tile contracts all it can (a vertex whose best
edge leaves the tile waits), and hands up what is left, which are vertices along its border; SPREAD x SPREAD tiles make
a tile of the next level, until a scene is one. Values come back level by level, one join each. Levels grow with the logarithm of a scene's side,
and no task gets more than a tile or the borders of the tiles it joins, whatever paths look like.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenetrack.schema import RUN_ID_FACTOR
from scenetrack.session import cut

CELL = ["scene_id", "row", "col"]
TILE, SPREAD = 64, 4
MAP, VERTEX, EDGE, HALF = range(4)  # kinds of rows that a tile hands up
ROWS = "scene_id bigint, ti int, tj int, kind int, u bigint, v bigint, a double, b double, label bigint, done boolean"


def scattered(number: np.ndarray) -> np.ndarray:
    """A fixed irregular order of edge numbers, so that chains of equal edges stay short."""
    return ((number >> 32) * 1_103_515_245 + (number & 0xFFFFFFFF) * 1_220_703_125) % 2_147_483_629


class Forest:
    """Vertices 0 to n - 1 of a tile while they are contracted. kept: vertices that never take an edge (they have a label).

    Each vertex knows its root and the value it gets from it: max(low, min(high, value of the root)).
    """

    def __init__(self, n: int, value: np.ndarray, kept: np.ndarray):
        self.value, self.kept = value.astype(float), kept
        self.root, self.low, self.high = np.arange(n), np.full(n, -np.inf), np.full(n, np.inf)

    def contract(self, u: np.ndarray, v: np.ndarray, rank: np.ndarray, pass_: np.ndarray) -> np.ndarray:
        """Contract along edges (u, v), v -1 where it lies outside; lower rank is better, pass_ is what an edge lets
        through. Returns which edges still join different roots or lead outside."""
        n = len(self.root)
        order = np.argsort(rank)
        u, v, pass_ = u[order], v[order], pass_[order]
        alive = np.arange(len(u))
        while len(alive):
            a, b = self.root[u[alive]], np.where(v[alive] < 0, -1, self.root[v[alive]])
            alive = alive[differ := (a != b) & ~((b >= 0) & self.kept[a] & self.kept[b])]
            a, b = a[differ], b[differ]
            best = np.full(n, len(u))
            np.minimum.at(best, a, alive)
            np.minimum.at(best, b[b >= 0], alive[b >= 0])
            mine = np.flatnonzero((best < len(u)) & ~self.kept)
            place = np.searchsorted(alive, best[mine])
            other = np.where(a[place] == mine, b[place], a[place])
            mine, best, other = (x[other >= 0] for x in (mine, best[mine], other))
            parent = np.arange(n)
            parent[mine] = other
            mutual = (parent[parent[mine]] == mine) & (mine < parent[mine])
            parent[mine[mutual]] = mine[mutual]
            moved = mine[~mutual]
            if not len(moved):
                break
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
            low[moved], high[moved] = self.value[moved], np.maximum(pass_[best[~mutual]], self.value[moved])
            brought = np.minimum(self.value[moved], pass_[best[~mutual]])
            while True:  # each step doubles how far up a vertex looks
                up = parent[parent]
                if (up == parent).all():
                    break
                low, high = np.maximum(low, np.minimum(high, low[parent])), np.maximum(low, np.minimum(high, high[parent]))
                parent = up
            np.maximum.at(self.value, parent[moved], brought)
            old = self.root
            self.low, self.high = np.maximum(self.low, np.minimum(self.high, low[old])), np.maximum(self.low, np.minimum(self.high, high[old]))
            self.root = parent[old]
        out = np.zeros(len(u), bool)
        out[order[alive]] = True
        return out


def edge_rank(first: np.ndarray, second: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rank by (first, second, scattered edge number, edge number)."""
    rank = np.empty(len(number), np.int64)
    rank[np.lexsort((number, scattered(number), second, first))] = np.arange(len(number))
    return rank


def handed_up(scene: int, at: tuple[int, int], ids: np.ndarray, forest: Forest, label: np.ndarray, u, v, number, first, second, left, out: np.ndarray) -> pd.DataFrame:
    """Rows of a contracted tile: where each vertex went, and what the next level needs of vertices and edges.

    Vertices whose root has no edge left, or a label, are done: their value is a (label: label)."""
    root, outside = forest.root, v < 0
    open_ = np.zeros(len(ids), bool)
    open_[root[u[left]]] = True
    open_[root[v[left & ~outside]]] = True
    done = ~open_[root] | forest.kept[root]
    final = np.maximum(forest.low, np.minimum(forest.high, forest.value[root]))
    maps = {"kind": MAP, "u": ids, "v": ids[root], "a": np.where(done, final, forest.low), "b": np.where(done, final, forest.high), "label": label[root], "done": done}
    roots = np.flatnonzero(open_)
    vertices = {"kind": VERTEX, "u": ids[roots], "v": -1, "a": forest.value[roots], "b": 0.0, "label": label[roots], "done": forest.kept[roots]}
    inner, half = left & ~outside, left & outside
    # the number of an edge goes in label; edges inside go up with both roots
    edges = {"kind": EDGE, "u": ids[root[u[inner]]], "v": ids[root[v[inner]]], "a": first[inner], "b": second[inner], "label": number[inner], "done": False}
    halves = {"kind": HALF, "u": ids[root[u[half]]], "v": out[half], "a": first[half], "b": second[half], "label": number[half], "done": False}
    table = pd.concat([pd.DataFrame(x) for x in (maps, vertices, edges, halves)], ignore_index=True)
    table["scene_id"], table["ti"], table["tj"] = scene, *at
    return table[[c.split()[0] for c in ROWS.split(", ")]]


def edge_keys(x: np.ndarray, y: np.ndarray, flood: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys by which edges are ordered: for floods the higher pixel, then the lower; else the lower mask, the highest first."""
    if flood:
        return np.maximum(x, y), np.minimum(x, y)
    return -np.minimum(x, y), np.zeros(len(x))


def first_level(key: tuple, px: pd.DataFrame, flood: bool) -> pd.DataFrame:
    """Contract one tile of pixels (v: height or mask, m: marker, label, inside: not a neighbouring tile's)."""
    inside, rows, cols = px["inside"].to_numpy(), px["row"].to_numpy(), px["col"].to_numpy()
    order = np.argsort(~inside, kind="stable")
    rows, cols, value = rows[order], cols[order], px["v"].to_numpy(float)[order]
    n, r0, c0 = int(inside.sum()), rows.min(), cols.min()
    grid = np.full((rows.max() - r0 + 2, cols.max() - c0 + 2), -1)
    grid[rows - r0, cols - c0] = np.arange(len(rows))
    ids = rows.astype(np.int64) * RUN_ID_FACTOR + cols
    pairs = [(grid[:-1].ravel(), grid[1:].ravel(), 0), (grid[:, :-1].ravel(), grid[:, 1:].ravel(), 1)]
    found = []
    for x, y, way in pairs:
        both = (x >= 0) & (y >= 0) & ((x < n) | (y < n))
        found.append(np.stack([x[both], y[both], ids[x[both]] * 2 + way]))
    x, y, number = np.concatenate(found, axis=1)
    first, second = edge_keys(value[x], value[y], flood)
    u, v = np.where(x < n, x, y), np.where(x < n, np.where(y < n, y, -1), -1)
    away = np.where(v < 0, ids[np.where(x < n, y, x)], -1)
    marker = px["m"].to_numpy(float)[order][:n]  # a tile with nothing but a border of others has n = 0 and gives no rows
    named = px["label"].to_numpy(np.int64)[order][:n]
    forest = Forest(n, np.full(n, -np.inf) if flood else np.where(np.isnan(marker), -np.inf, marker), named >= 0 if flood else np.zeros(n, bool))
    left = forest.contract(u, v, edge_rank(first, second, number), -first)
    return handed_up(key[0], key[1:], ids[:n], forest, named, u, v, number, first, second, left, away)


def next_level(key: tuple, rows: pd.DataFrame, flood: bool) -> pd.DataFrame:
    """Contract what the tiles of one tile of the next level have handed up."""
    kind = rows["kind"].to_numpy()
    vertices = rows[kind == VERTEX].sort_values("u")
    ids, named = vertices["u"].to_numpy(), vertices["label"].to_numpy(np.int64)
    inner = rows[kind == EDGE]
    half = rows[kind == HALF].sort_values(["label", "u"])
    number, at = half["label"].to_numpy(), half["u"].to_numpy()
    twin = np.zeros(len(half), bool)  # first of two halves of one edge
    twin[:-1] = number[1:] == number[:-1]
    second_half = np.roll(twin, 1)
    lone = ~twin & ~second_half
    met = np.flatnonzero(twin)
    place = lambda x: np.searchsorted(ids, x)
    u = place(np.concatenate([inner["u"].to_numpy(), at[met], at[lone]]).astype(np.int64))
    v = np.concatenate([place(inner["v"].to_numpy().astype(np.int64)), place(at[met + 1]) if len(met) else met, np.full(lone.sum(), -1)]).astype(np.int64)
    column = lambda c: np.concatenate([inner[c].to_numpy(), half[c].to_numpy()[met], half[c].to_numpy()[lone]])
    first, second, numbers = column("a").astype(float), column("b").astype(float), column("label").astype(np.int64)
    away = np.concatenate([np.full(len(inner) + len(met), -1), half["v"].to_numpy()[lone]]).astype(np.int64)
    forest = Forest(len(ids), vertices["a"].to_numpy(), vertices["done"].to_numpy(bool))
    left = forest.contract(u, v, edge_rank(first, second, numbers), -first)
    return handed_up(key[0], key[1:], ids, forest, named, u, v, numbers, first, second, left, away)


def in_tiles(px: DataFrame, tile: int) -> DataFrame:
    """px with tile (ti, tj), each pixel on a tile's border also in the tiles next to it, there with inside false."""
    i, j = F.floor(F.col("row") / tile).cast("int"), F.floor(F.col("col") / tile).cast("int")
    own = F.struct(i.alias("ti"), j.alias("tj"), F.lit(True).alias("inside"))
    next_to = lambda at, by, di, dj: F.when(F.col(at) % tile == (0 if by < 0 else tile - 1), F.struct((i + di).cast("int").alias("ti"), (j + dj).cast("int").alias("tj"), F.lit(False).alias("inside")))
    places = F.array_compact(F.array(own, next_to("row", -1, -1, 0), next_to("row", 1, 1, 0), next_to("col", -1, 0, -1), next_to("col", 1, 0, 1)))
    return px.withColumn("_at", F.explode(places)).select("*", "_at.*").drop("_at")


def solved(px: DataFrame, flood: bool, tile: int = TILE, spread: int = SPREAD) -> DataFrame:
    """(scene_id, u: row * RUN_ID_FACTOR + col, a: value, label) of pixels (scene_id, row, col, v, m, label); any of their
    neighbouring pixels may be absent."""
    placed = in_tiles(px.withColumn("label", F.coalesce("label", F.lit(-1).cast("bigint"))), tile)
    contract = functools.partial(first_level, flood=flood)
    levels = [cut(placed.groupBy("scene_id", "ti", "tj").applyInPandas(lambda key, pdf: contract(key, pdf), ROWS))]
    top = levels[0].agg(F.max(F.greatest("ti", "tj"))).first()[0] or 0
    join_tiles = functools.partial(next_level, flood=flood)
    while top:
        top //= spread
        up = levels[-1].where(F.col("kind") != MAP)
        up = up.withColumn("ti", F.floor(F.col("ti") / spread).cast("int")).withColumn("tj", F.floor(F.col("tj") / spread).cast("int"))
        levels.append(cut(up.groupBy("scene_id", "ti", "tj").applyInPandas(lambda key, pdf: join_tiles(key, pdf), ROWS)))
    value = F.greatest("a", F.least("b", "x"))
    out = None
    for level in reversed(levels):
        here = level.where(F.col("kind") == MAP)
        if out is None:
            out = here.select("scene_id", "u", "a", "label")
            continue
        above = out.select("scene_id", F.col("u").alias("v"), F.col("a").alias("x"), F.col("label").alias("named"))
        rest = here.where("not done").join(above, ["scene_id", "v"])
        out = here.where("done").select("scene_id", "u", "a", "label").union(rest.select("scene_id", "u", value.alias("a"), F.col("named").alias("label")))
    return out


def back_to_pixels(found: DataFrame) -> DataFrame:
    row = F.floor(F.col("u") / RUN_ID_FACTOR)
    return found.select("scene_id", row.cast("int").alias("row"), (F.col("u") - row * RUN_ID_FACTOR).cast("int").alias("col"), "a", "label")


def highest_reached(px: DataFrame, marker: str, mask: str, tile: int = TILE) -> DataFrame:
    """(scene_id, row, col, reached): the highest marker that reaches each pixel over a path of 4-neighbours, cut to the lowest
    mask on the path (grey reconstruction by dilation)."""
    start = px.select(*CELL, F.col(mask).cast("double").alias("v"), F.least(marker, mask).cast("double").alias("m"), F.lit(None).cast("bigint").alias("label"))
    return back_to_pixels(solved(start, False, tile)).select(*CELL, F.col("a").alias("reached"))


def flooded(px: DataFrame, value: str, markers: DataFrame, tile: int = TILE) -> DataFrame:
    """(scene_id, row, col, label): pixels by the marker (scene_id, row, col, label; labels not negative) whose flood takes
    them first, if the least edge next to any flood is always the next one crossed: least higher pixel, then lower
    pixel, then scattered edge number. Pixels that no marker reaches are absent."""
    start = px.select(*CELL, F.col(value).cast("double").alias("v"), F.lit(None).cast("double").alias("m"))
    start = start.join(markers.select(*CELL, F.col("label").cast("bigint").alias("label")), CELL, "left")
    return back_to_pixels(solved(start, True, tile)).where("label >= 0").select(*CELL, "label")
