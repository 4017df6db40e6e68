"""Composite clean-up steps against pixel by pixel rules."""

import random

import pytest
from helpers import cells, frame, pixels

from scenetrack.functions import masks
from scenetrack.operators import cleaners, runs

ELEMENT = runs.diamond(1)


class Mask:
    """A set of pixels in a frame, with each rule written out."""

    def __init__(self, on, h, w):
        self.on, self.h, self.w = frozenset(on), h, w

    def of(self, on):
        return Mask(on, self.h, self.w)

    def every(self):
        return [(i, j) for i in range(self.h) for j in range(self.w)]

    def code(self, p):
        return sum(((p[0] + a, p[1] + b) in self.on) << ((a + 1) * 3 + b + 1) for a in (-1, 0, 1) for b in (-1, 0, 1))

    def h_broken(self):
        gone = {0b111111111 & ~(1 << 3) & ~(1 << 5), 0b111111111 & ~(1 << 1) & ~(1 << 7)}
        return self.of(p for p in self.on if self.code(p) not in gone)

    def bridged(self):
        codes = set(masks.bridge_codes())
        return self.of(p for p in self.every() if self.code(p) in codes)

    def filled_in(self):
        return self.of(p for p in self.every() if p in self.on or all((p[0] + a, p[1] + b) in self.on for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))))

    def branched(self):
        parts, candidates = masks.background_parts(), set(masks.branch_candidates())
        many = {p for p in self.every() if parts[self.code(p)] > 2}
        near = lambda p: any((p[0] + a, p[1] + b) in many for a in (-1, 0, 1) for b in (-1, 0, 1))
        return self.of(p for p in self.every() if self.code(p) in candidates and parts[self.code(p)] != 1 and not (parts[self.code(p)] == 2 and near(p)))

    def components(self, on, steps):
        left, out = set(on), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                p = todo.pop()
                part.add(p)
                near = {(p[0] + a, p[1] + b) for a, b in steps} & left
                left -= near
                todo += near
            out.append(part)
        return out

    FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
    EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)

    def large(self, least, steps=FOUR):
        return self.of(p for c in self.components(self.on, steps) if len(c) >= least for p in c)

    def filled(self):
        edge = lambda p: p[0] in (0, self.h - 1) or p[1] in (0, self.w - 1)
        holes = [c for c in self.components(set(self.every()) - self.on, self.FOUR) if not any(map(edge, c))]
        return self.of(self.on | {p for c in holes for p in c})

    def moved(self, p, k=1):
        return {(p[0] + a, p[1] + b) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a) + abs(b) <= k}

    def dilated(self, k=1):
        return self.of(p for p in self.every() if self.moved(p, k) & self.on)

    def eroded(self, k=1):
        inside = set(self.every())
        return self.of(p for p in self.every() if self.moved(p, k) & inside <= self.on)

    def touched(self, marker):
        return self.of(p for c in self.components(self.on, self.EIGHT) if c & marker.on for p in c)


def shapes(seed, h=24, w=30):
    r = random.Random(seed)
    grid = [[r.random() < (0.55, 0.8, 0.68)[seed % 3] for _ in range(w)] for _ in range(h)]
    return "\n".join("".join("#" if x else "." for x in row) for row in grid), Mask(((i, j) for i in range(h) for j in range(w) if grid[i][j]), h, w)


@pytest.fixture(scope="module")
def scenes(spark):
    from scenetrack.session import cut

    made = [shapes(seed) for seed in range(3)]
    texts = [t for t, _ in made]
    return cut(runs.runs_of(pixels(spark, *texts))), frame(spark, *texts), [m for _, m in made]


def by_scene(found):
    out = {}
    for x in runs.explode_runs(found.select("scene_id", "row", "c0", "c1")).collect():
        out.setdefault(x.scene_id, set()).add((x.row, x.col))
    return [out.get(k, set()) for k in range(3)]


def test_branches_and_bridges(scenes):
    found, bounds, want = scenes
    assert by_scene(cleaners.branched(found, bounds)) == [m.branched().on for m in want]
    assert by_scene(cleaners.branch_bridge(found, bounds)) == [m.branched().bridged().on for m in want]


def test_changes_by_opening(scenes):
    found, bounds, want = scenes
    kept = [m.large(20).h_broken() for m in want]
    out = [m.branched().bridged().eroded().dilated().filled() for m in kept]
    assert by_scene(cleaners.changed_by_opening(found, bounds, element=ELEMENT)) == [a.on ^ b.on for a, b in zip(kept, out)]
    assert by_scene(cleaners.with_changes(found, bounds, element=ELEMENT)) == [m.on | (a.on ^ b.on) for m, a, b in zip(want, kept, out)]


def test_finished_mask(scenes):
    found, bounds, want = scenes
    divide = found.where("row % 7 = 3")
    points = []
    for m in want:
        cut_out = m.h_broken().filled_in()
        cut_out = m.of(p for p in cut_out.on if not (p[0] % 7 == 3 and p in m.on))
        points.append(cut_out.filled().branched())
    assert by_scene(cleaners.finished(found, divide, bounds)) == [p.eroded().dilated().touched(p).on for p in points]


def test_split_along_leads(scenes):
    found, bounds, want = scenes
    cloud = found.where("row between 4 and 6")
    out = []
    for m in want:
        opened = m.h_broken().branched().large(2).large(4, m.EIGHT).branched()
        leads = m.of(opened.on - (opened.dilated(2).eroded(2).on - opened.on)).large(4, m.EIGHT)
        floes = m.of(p for p in leads.filled().on if not (4 <= p[0] <= 6 and p in m.on)).branched()
        out.append(floes.eroded().dilated().touched(floes).on)
    assert by_scene(cleaners.split_morphologically(found, cloud, bounds, least=4, element=ELEMENT)) == out


def test_case_names(spark):
    from scenetrack.sources import views

    rows = spark.sql("select 7 as case_number, 'bay' as region, date'2022-03-04' as start, 'aqua' as satellite, 0 as n union all select 12345, 'sea', date'2020-12-31', 'terra', 3")
    got = views.case_path(views.case_names(rows), "binary_floes", "path", objects="n").orderBy("case_number").collect()
    assert [x.name for x in got] == ["007-bay-100km-20220304-aqua-250m", "12345-sea-100km-20201231-terra-250m"]
    assert [x.path for x in got] == [None, "data/validation_dataset/binary_floes/12345-sea-20201231-terra-binary_floes.png"]
