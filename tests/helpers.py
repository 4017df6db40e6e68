"""Small rasters as text: '#' is set."""

from pyspark.sql import functions as F


def pixels(spark, *scenes: str):
    rows = [(k, r, c) for k, art in enumerate(scenes) for r, line in enumerate(art.split()) for c, ch in enumerate(line) if ch == "#"]
    return spark.createDataFrame(rows, "scene_id int, row int, col int")


def frame(spark, *scenes: str):
    return spark.createDataFrame([(k, len(a.split()), len(a.split()[0])) for k, a in enumerate(scenes)], "scene_id int, height int, width int")


def cells(runs) -> set:
    from scenetrack.operators.runs import explode_runs

    return {(r.row, r.col) for r in explode_runs(runs.select("scene_id", "row", "c0", "c1")).collect()}


def art(text: str) -> set:
    return {(r, c) for r, line in enumerate(text.split()) for c, ch in enumerate(line) if ch == "#"}


def values(df, *names):
    return {tuple(r) for r in df.select(*[F.col(n) for n in names]).collect()}


#: The eight directions, clockwise from up.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def outline(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Outer border of a connected set of cells, clockwise from its first cell in reading order, which also ends it.

    From each cell the next one is the first set cell clockwise after the unset cell that the walk came along. The walk is over when it
    would leave the first cell as it did at first, so cells of one-pixel bridges come twice.
    """
    first = min(cells)
    path, at, back = [first], first, 6  # nothing is set to the left of the first cell
    leaving = None
    while True:
        for turn in range(1, 9):
            way = (back + turn) % 8
            to = (at[0] + AROUND[way][0], at[1] + AROUND[way][1])
            if to in cells:
                break
        else:
            return path  # a single cell
        if (at, way) == leaving:
            return path
        leaving = leaving or (at, way)
        path.append(to)
        # the unset cell looked at last, as seen from the new one
        empty = (at[0] + AROUND[(way - 1) % 8][0], at[1] + AROUND[(way - 1) % 8][1])
        back = AROUND.index((empty[0] - to[0], empty[1] - to[1]))
        at = to
