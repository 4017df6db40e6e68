"""Table shapes shared by the operators.

px        (scene_id, row, col, bands ...)                      one row per pixel, 0-based
run       (scene_id, row, c0, c1)                              maximal stretches of a mask in a row, ends inclusive
labelled  run + label                                          label: least run id of the component
objpx     (scene_id, label, row, col)                          pixels of objects
objects   (scene_id, label, area, row_centroid, ...)           one row per object
pairs     (head_uuid, uuid, measures ...)                      candidate links between scenes
"""

RUN_ID_FACTOR = 1 << 31  # run id = row * factor + first column; unique within a scene

OBJECT_COLUMNS = (
    "area", "row_centroid", "col_centroid", "min_row", "max_row", "min_col", "max_col",
    "major_axis_length", "minor_axis_length", "orientation",
)
