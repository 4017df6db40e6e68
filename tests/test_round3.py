"""Emptied star contraction, label 0, distances and components in bands of rows."""

import random

import pytest
from test_cleaners import Mask

from scenetrack.operators import distance, objects, runs, tiles
from scenetrack.plans.queries import frame, registered
from scenetrack.sources import views

DIR = "/root/testdata/sf0.001"


def test_split_morphologically_runs(spark):
    """Once nothing is left to join, the optimiser failed on the checkpoints of star contraction; the rows are those of plain loops."""
    size = frame(spark, DIR).first()
    m = Mask({(p.row, p.col) for p in views.mask(spark, DIR).collect()}, size.height, size.width)
    opened = m.h_broken().branched().large(2).large(4, m.EIGHT).branched()
    leads = m.of(opened.on - (opened.dilated(2).eroded(2).on - opened.on)).large(4, m.EIGHT)
    floes = leads.filled().branched()
    got = registered()[0]["split_morphologically"](spark, DIR).collect()
    assert {(x.row, c) for x in got for c in range(x.c0, x.c1 + 1)} == floes.eroded().dilated().touched(floes).on


def test_label_0_is_a_label(spark):
    dense = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 7), (0, 0, 2, None)], "scene_id int, row int, col int, label long")
    assert {r.col: r.mask for r in objects.binary_segments(dense).collect()} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("reach", [None, 0, 5, 30])
def test_nearest_in_bands(spark, monkeypatch, reach):
    """Far features, bands without any, ties across bands: as by all pairs, and no task gets the whole height of a strip."""
    r = random.Random(3)
    sizes, features = [(90, 19), (70, 3), (33, 40), (60, 4)], [(1, 69, 2, 4), (3, 10, 1, 9), (3, 30, 1, 2)]
    features += [(0, i, r.randrange(19), r.randint(0, 3)) for i in (0, 1, 2, 3, 4, 60, 61)] + [(2, i, j, r.randint(0, 3)) for i in range(33) for j in range(40) if r.random() < 0.3]
    features = list({x[:3]: x for x in features}.values())
    want = {}
    for k, (h, w) in enumerate(sizes):
        for i in range(h):
            for j in range(w):
                best = min(((i - a) ** 2 + (j - b) ** 2, m) for s, a, b, m in features if s == k)
                if reach is None or best[0] <= reach**2:
                    want[k, i, j] = best
    most = 8 + 2 * (reach or 2)
    down_columns = distance.down_columns
    def watched(key, strip, reach):
        dense = key[0] == 2
        assert not dense or strip["row"].nunique() <= most + 2 * (reach or 0)
        return down_columns(key, strip, reach)
    monkeypatch.setattr(distance, "down_columns", watched)
    table = spark.createDataFrame(features, "scene_id int, row int, col int, label long")
    bounds = spark.createDataFrame([(k, *s) for k, s in enumerate(sizes)], "scene_id int, height int, width int")
    found = [(x.scene_id, x.row, x.col, x.d2, x.label) for x in distance.nearest(table, bounds, reach, band=8, margin=2).collect()]
    assert {x[:3]: x[3:] for x in found} == want and len(found) == len(want)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_across_bands(spark, monkeypatch, connectivity):
    """Combs and noise over many bands: as by plain loops; stars get edges between bands only."""
    monkeypatch.setattr(runs, "BAND", 4)
    r, counts = random.Random(5), []
    noise = {(i, j) for i in range(45) for j in range(12) if r.random() < 0.55}
    comb = {(i, j) for i in range(30) for j in range(15) if j % 2 == 0 or i == 29}
    star_labels = runs.star_labels
    monkeypatch.setattr(runs, "star_labels", lambda edges: counts.append(edges.count()) or star_labels(edges))
    table = spark.createDataFrame([(k, *p) for k, on in enumerate((noise, comb)) for p in on], "scene_id int, row int, col int")
    got = {(x.scene_id, x.row, x.col): x.label for x in runs.explode_runs(runs.components(runs.runs_of(table), connectivity)).collect()}
    assert counts[0] <= 11 * 7 + 7 * 8
    m = Mask(set(), 0, 0)
    for k, on in enumerate((noise, comb)):
        for part in m.components(on, m.FOUR if connectivity == 4 else m.EIGHT):
            first = min(part)
            assert {got.pop((k, *p)) for p in part} == {first[0] * (1 << 31) + first[1]}
    assert not got


def test_tile_labels_without_a_window_over_a_scene(spark):
    """Labels of tiles count the tile columns of their scene; no window takes all levels of a scene."""
    rows = [(s, i // 2, j // 2, i, j, (7 * i + 3 * j) % 5) for s, (h, w) in enumerate(((6, 4), (2, 8))) for i in range(h) for j in range(w)]
    tiled = spark.createDataFrame(rows, "scene_id int, tr int, tc int, row int, col int, q int")
    out = tiles.tiled_kmeans(tiled, "q", 2)
    columns = {0: 2, 1: 4}
    got = out.collect()
    assert {(x.scene_id, x.tr, x.tc, x.q) for x in got} == {(s, a, b, q) for s, a, b, _, _, q in rows}
    assert all(x.label == (x.tr * columns[x.scene_id] + x.tc) * 2 + x.cluster for x in got)
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("tr#" in x.rsplit("], [", 2)[-2 if "ASC" in x else -1] for x in windows)
