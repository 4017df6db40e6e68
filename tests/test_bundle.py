"""Scene bundles: round trips, what files say of themselves, odd cases."""

import pyarrow as pa
import pytest
from pyarrow import ipc

from scenetrack.sources import bundle


def test_round_trip(spark, tmp_path):
    rows = [(k, i, j, i / 7 + k, (i + j) % 2 == 0, None if j == 3 else 2**40 + i) for k in (3, 11, 12) for i in range(9) for j in range(5)]
    px = spark.createDataFrame(rows, "scene_id int, row int, col int, b2 double, cloud boolean, label long").repartition(7)
    path = f"{tmp_path}/scenes"
    bundle.write_bundles(px, path, "EPSG:3413", {"b2": "1"}, {"b2": "image", "cloud": "mask", "label": "label"})
    back = bundle.read_bundles(spark, path)
    assert back.schema == px.schema and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert bundle.bundle_facts(path) == {f"scene={k}.arrow": {"version": "1", "crs": "EPSG:3413", "units": {"b2": "1"}, "kinds": {"b2": "image", "cloud": "mask", "label": "label"}} for k in (3, 11, 12)}
    bundle.write_bundles(px.where("scene_id = 11").selectExpr("scene_id", "row", "col", "b2 + 1 as b2", "cloud", "label"), path)
    again = bundle.read_bundles(spark, path)
    assert again.count() == len(rows) and again.where("scene_id = 11").agg({"b2": "min"}).first()[0] == 12.0
    bundle.write_bundles(px.where("scene_id = 3"), path, mode="overwrite")
    assert list(bundle.bundle_facts(path)) == ["scene=3.arrow"]


def test_unknown_versions_and_missing_scenes(spark, tmp_path):
    with pytest.raises(Exception, match="no scene"):
        (tmp_path / "none").mkdir()
        bundle.read_bundles(spark, f"{tmp_path}/none").count()
    schema = pa.schema([("scene_id", pa.int32())], metadata={bundle.KEY: b'{"version": "9"}'})
    with ipc.new_stream(f"{tmp_path}/scene=1.arrow", schema) as out:
        out.write_batch(pa.record_batch([pa.array([1], pa.int32())], schema=schema))
    with pytest.raises(Exception, match="version 9"):
        bundle.read_bundles(spark, str(tmp_path)).count()
